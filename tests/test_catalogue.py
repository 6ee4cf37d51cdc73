"""Every query of the catalogue against its SQL in DuckDB."""

import duckdb
import pytest

from graphloom.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem".split()


def plain(rows):
    return sorted(tuple(str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = con.execute(f"select {', '.join(columns)} from ({catalogue.ORACLES[name]})").fetchall()
    assert plain(df.select(*columns).collect()) == plain(want)
