"""The shared test tables read as a code graph, and the same mapping as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import ingest
from graphloom.sources.tables import numbered, settled

FULL_ROW = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]


class Fixture:
    """Lazily built DataFrames; numbered ones are settled once per instance."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self._made = spark, sf_dir, {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def once(self, name: str, make) -> DataFrame:
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    def projects(self) -> DataFrame:
        return self.table("region").select((F.col("r_regionkey") + 1).cast("long").alias("project_id"), F.concat(F.lit("/proj/"), F.lower("r_name"), F.lit("/")).alias("project_root"))

    def filepaths(self) -> DataFrame:
        return self.table("orders").select(F.col("o_orderkey").alias("filepath_id"), F.concat(F.lit("src/c"), F.col("o_custkey"), F.lit(".cc")).alias("filepath"), F.col("o_orderdate").alias("create_time"))

    def names(self) -> DataFrame:
        return self.table("part").select(F.concat(F.lit("c:@F@p"), F.col("p_partkey")).alias("usr"), F.concat_ws("::", "p_name", "p_brand").alias("qualified"), (F.col("p_size") <= 2).alias("might_throw"))

    def n_parts(self) -> int:
        return self.once("n", lambda: self.table("part").count())

    def unnumbered_calls(self) -> DataFrame:
        line = self.table("lineitem")
        none = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F") & (F.col("l_linenumber") == 7)
        return line.select(
            *FULL_ROW,
            F.when(none, "").otherwise(F.concat(F.lit("c:@F@p"), F.col("l_partkey"))).alias("caller_usr"),
            F.concat(F.lit("c:@F@p"), F.col("l_orderkey") % self.n_parts()).alias("usr"),
            F.when(F.col("l_quantity") <= 3, F.col("l_orderkey")).otherwise(-1).alias("location_file_id"),
            F.col("l_linenumber").cast("long").alias("location_line"),
            F.col("l_shipdate").alias("create_time"),
            F.when(F.col("l_linestatus") == "F", F.concat(F.lit("R"), F.col("l_suppkey") % 5)).alias("catch_type"),
        )

    def calls_raw(self) -> DataFrame:
        return self.once("calls_raw", lambda: settled(numbered(self.unnumbered_calls(), "func_call_id", FULL_ROW).drop(*FULL_ROW)))

    def func_calls(self, ids: bool = True) -> DataFrame:
        """ids=False spares the numbering where call ids are not looked at."""
        rows = self.calls_raw() if ids else self.unnumbered_calls()
        kept = rows.where(ingest.call_fault(F.col("caller_usr"), F.col("location_file_id")).isNull())
        caller = self.names().select(F.col("usr").alias("caller_usr"), F.col("might_throw").alias("caller_might_throw"))
        return kept.join(self.names().select("usr", "qualified"), "usr").join(caller, "caller_usr")

    def defs_raw(self) -> DataFrame:
        def make():
            line = self.table("lineitem").where(F.col("l_linenumber") == 1)
            rows = line.join(self.table("orders"), line["l_orderkey"] == F.col("o_orderkey")).withColumn("usr", F.concat(F.lit("c:@F@p"), F.col("l_partkey"))).join(self.names(), "usr")
            rows = rows.select(*FULL_ROW, "usr", "qualified", "might_throw", F.when(F.col("l_quantity") <= 40, F.col("l_orderkey")).otherwise(-1).alias("location_file_id"), F.col("l_linenumber").cast("long").alias("location_line"), F.col("o_orderdate").alias("create_time"))
            return settled(numbered(rows, "func_def_id", FULL_ROW).drop(*FULL_ROW))

        return self.once("defs_raw", make)

    def func_definitions(self) -> DataFrame:
        fault = ingest.definition_fault(F.col("usr"), F.col("qualified"), F.col("location_file_id"))
        return self.once("definitions", lambda: settled(ingest.first_writers(self.defs_raw().where(fault.isNull()))))

    def units(self) -> DataFrame:
        day = F.expr("interval 1 day")
        last = F.when(F.col("o_orderstatus") == "P", F.lit(None)).when(F.col("o_custkey") % 10 == 0, F.col("o_orderdate") - day).otherwise(F.col("o_orderdate") + 60 * day)
        return self.table("orders").select(F.col("o_orderkey").alias("tu"), F.col("o_orderdate").alias("own_mtime"), last.alias("last_index"), F.lit(True).alias("analysed"))

    def includes(self) -> DataFrame:
        return self.table("lineitem").select(F.col("l_orderkey").alias("tu"), F.col("l_shipdate").alias("include_mtime"))

    def class_bases(self) -> DataFrame:
        return self.table("nation").select(F.concat(F.lit("N"), F.col("n_nationkey")).alias("derived"), F.concat(F.lit("R"), F.col("n_regionkey")).alias("base"))

    def throws(self) -> DataFrame:
        line = self.table("lineitem").where((F.col("l_quantity") == 4) & (F.col("l_discount") == 0.1))
        return line.join(self.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.concat(F.lit("c:@F@p"), F.col("l_partkey")).alias("usr"), F.concat(F.lit("N"), F.col("s_nationkey")).alias("type")).distinct()

    def occurrences(self) -> DataFrame:
        kinds = F.array(*(F.lit(k) for k in ("Function", "CXXMethod", "Constructor", "Destructor", "Conversion", "Variable", "Macro")))
        kind = F.get(kinds, F.col("l_linenumber") - 1)
        return self.table("lineitem").select(
            F.concat(F.lit("tu"), F.col("l_suppkey")).alias("tu"),
            (F.col("l_suppkey") % 10 != 0).alias("tu_ok"),
            kind.alias("kind"),
            (F.col("l_returnflag") == "A").alias("is_decl"),
            (F.col("l_linestatus") == "F").alias("is_def"),
            (F.col("l_linenumber") == 7).alias("is_macro"),
            (F.col("l_quantity") > 45).alias("is_builtin"),
            F.concat(F.lit("c:@F@p"), F.col("l_partkey")).alias("usr"),
            F.concat(F.lit("(anonymous namespace)::p"), F.col("l_partkey")).alias("qualified"),
            F.concat(F.lit("c:@F@p"), F.col("l_suppkey")).alias("container_usr"),
            F.when(F.col("l_tax") > 0.04, "Function").otherwise("Namespace").alias("container_kind"),
            (F.col("l_quantity") < 10).alias("might_throw"),
        )


#: The same mapping as common table expressions.
SQL = """
names as (select 'c:@F@p' || p_partkey as usr, p_name || '::' || p_brand as qualified, p_size <= 2 as might_throw from part),
calls_raw as (select row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) as func_call_id,
  case when l_returnflag = 'R' and l_linestatus = 'F' and l_linenumber = 7 then '' else 'c:@F@p' || l_partkey end as caller_usr,
  'c:@F@p' || (l_orderkey % (select count(*) from part)) as usr, case when l_quantity <= 3 then l_orderkey else -1 end as location_file_id,
  l_linenumber::bigint as location_line, l_shipdate as create_time, case when l_linestatus = 'F' then 'R' || (l_suppkey % 5) end as catch_type from lineitem),
func_calls as (select c.*, n.qualified, m.might_throw as caller_might_throw from calls_raw c join names n on n.usr = c.usr join names m on m.usr = c.caller_usr where c.caller_usr <> '' and c.location_file_id >= 0),
defs_raw as (select row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) as func_def_id,
  n.usr, n.qualified, n.might_throw, case when l_quantity <= 40 then l_orderkey else -1 end as location_file_id, l_linenumber::bigint as location_line, o_orderdate as create_time
  from lineitem join orders on l_orderkey = o_orderkey join names n on n.usr = 'c:@F@p' || l_partkey where l_linenumber = 1),
func_definitions as (select * from (select *, row_number() over (partition by usr order by func_def_id) as rn from defs_raw where location_file_id >= 0) where rn = 1),
edges as (select distinct caller_usr as a, usr as b from func_calls)
"""
