"""Tables in a shared folder: intermediate ones of iterative operators, and surrogate numbers."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOTS: dict[str, str] = {}


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def shared_folder(spark: SparkSession) -> str:
    """This application's folder under spark.checkpoint.dir; a temporary folder only where that is unset and all tasks run on this
    machine."""
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        _ROOTS[app] = f"{(base or tempfile.mkdtemp(prefix='graphloom-')).rstrip('/')}/graph-{app}"

        def tidy(path=_ROOTS[app]):
            try:
                delete(spark, path)
            except Exception:  # noqa: BLE001  the JVM may be gone already
                pass

        atexit.register(tidy)
    return _ROOTS[app]


def settled(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, so that its lineage ends there and lost executors cost nothing."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._settled = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes a table made by settled() that nothing reads any more."""
    delete(df.sparkSession, df._settled)


def numbered(df: DataFrame, name: str, order: list[Column | str], above: int = 0) -> DataFrame:
    """Adds a column of successive numbers from above + 1 on, in the given order. Rows are sorted in ranges; the counts of
    the ranges (a row for each partition) give where each range begins, so no task sees more than its range."""
    mark = f"_{name}_mark"
    placed = settled(df.repartitionByRange(*[F.col(c) if isinstance(c, str) else c for c in order]).sortWithinPartitions(*order).withColumn(mark, F.monotonically_increasing_id()))
    part = F.shiftright(mark, 33)
    counts = sorted((r["p"], r["n"]) for r in placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    begins, total = {}, above
    for p, n in counts:
        begins[p] = total
        total += n
    if not begins:
        return placed.withColumn(name, F.lit(None).cast("long")).drop(mark)
    table = df.sparkSession.createDataFrame(sorted(begins.items()), "_part long, _first long")
    first = F.col("_first") + F.col(mark).bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.withColumn("_part", part).join(F.broadcast(table), "_part").withColumn(name, first).drop(mark, "_part", "_first")
