"""The engine: one project's index and the questions about it."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import incremental, ingest, onehop, paths
from graphloom.sources.store import Store
from graphloom.sources.tables import numbered, settled


class Engine:
    """``Engine(spark, base, root)`` opens the project at root in the store under base."""

    def __init__(self, spark: SparkSession, base: str, root: str):
        self.spark, self.root, self.store = spark, root, Store(spark, base)
        self.project_id = self.store.project(root)

    def table(self, name: str) -> DataFrame:
        return self.store.read(name, self.project_id)

    def index(self, occurrences: DataFrame, at: datetime, diagnostics: DataFrame | None = None, only_file: str | None = None) -> dict[str, int]:
        """Adds the facts of all TUs of ``occurrences`` (schema.OCCURRENCES) with ``at`` as their version. Definitions come first,
        then calls, then the rows that mark the TUs as done. Gives the numbers of rows added."""
        facts = occurrences if only_file is None else occurrences.where(F.col("tu") == only_file)
        facts = ingest.usable_units(facts, diagnostics)
        done = facts.select(F.col("tu").alias("file")).distinct()
        rows = settled(ingest.classified(facts))
        known, stamp = self.table("filepaths"), F.lit(at).cast("timestamp")
        wanted = ingest.located(rows.select("file").unionByName(done).distinct(), self.root, known.select("filepath", "filepath_id").limit(0)).where(F.col("filepath").isNotNull())
        files = settled(ingest.assigned_file_ids(wanted, known, self.store.greatest("filepaths", "filepath_id", self.project_id)))
        placed = ingest.located(rows, self.root, files).withColumns({"project_id": F.lit(self.project_id), "create_time": stamp, "location_line": F.col("line").cast("long")})
        defs = placed.where("fact = 'def'").where(ingest.definition_fault(F.col("usr"), F.col("qualified"), F.col("location_file_id")).isNull())
        order = ["tu", "location_file_id", "location_line", "usr", "qualified"]
        defs = numbered(defs, "func_def_id", order, self.store.greatest("func_definitions", "func_def_id", self.project_id))
        defs = settled(ingest.first_writers(defs.drop("caller_usr", "fact"), self.table("func_definitions")))
        throws = self.table("func_definitions").select("usr", "might_throw").unionByName(defs.select("usr", "might_throw")).groupBy(F.col("usr").alias("caller_usr")).agg(F.max("might_throw").alias("caller_might_throw"))
        calls = placed.where("fact = 'call'").where(ingest.call_fault(F.col("caller_usr"), F.col("location_file_id")).isNull())
        calls = calls.join(throws, "caller_usr", "left").withColumn("caller_might_throw", F.coalesce("caller_might_throw", F.lit(False)))
        calls = settled(numbered(calls, "func_call_id", ["tu", "location_file_id", "location_line", "caller_usr", "usr"], self.store.greatest("func_calls", "func_call_id", self.project_id)))
        marks = ingest.located(done, self.root, files).where("location_file_id >= 0")
        marks = settled(marks.select(F.lit(self.project_id).alias("project_id"), F.col("location_file_id").alias("filepath_id"), "filepath", stamp.alias("create_time")))
        others = files.join(marks.select("filepath"), "filepath", "left_anti").join(known.select("filepath").distinct(), "filepath", "left_anti")
        others = settled(others.select(F.lit(self.project_id).alias("project_id"), "filepath_id", "filepath", F.timestamp_seconds(F.lit(0)).alias("create_time")))
        for name, df in (("func_definitions", defs), ("func_calls", calls), ("filepaths", others.unionByName(marks))):
            self.store.append(name, df)
        return {"func_definitions": defs.count(), "func_calls": calls.count(), "filepaths": marks.count()}

    def stale(self, units: DataFrame, includes: DataFrame, only_file: str | None = None) -> DataFrame:
        return incremental.to_index(units, includes, only_file)

    def callers_of(self, name) -> DataFrame:
        return onehop.callers_of(self.table("func_definitions"), self.table("func_calls"), name)

    def callees_of(self, name) -> DataFrame:
        return onehop.callees_of(self.table("func_definitions"), self.table("func_calls"), name)

    def dangling_callers(self) -> DataFrame:
        return onehop.dangling_callers(self.table("func_definitions"), self.table("func_calls"))

    def reachable(self, source: str, most: int | None = None) -> DataFrame:
        return paths.reachable(self.table("func_definitions"), self.table("func_calls"), source, most)

    def call_path(self, source: str, target: str, compat: bool = False) -> DataFrame:
        return paths.call_path(self.table("func_definitions"), self.table("func_calls"), source, target, compat)

    def throw_path(self, source: str, compat: bool = False) -> DataFrame:
        return paths.throw_path(self.table("func_definitions"), self.table("func_calls"), source, compat)
