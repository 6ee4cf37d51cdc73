"""The four tables of a project store as Parquet, partitioned by project."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.sources import schema, tables


class Store:
    """Tables under a base folder, with a single writer. A TU's row in ``filepaths`` is written last and marks it as done, so that a
    TU without it is indexed again; readers do not look at the marks."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def read(self, table: str, project_id: int | None = None) -> DataFrame:
        path, kind = f"{self.base}/{table}", schema.TABLES[table]
        if not tables.exists(self.spark, path):
            return self.spark.createDataFrame([], kind)
        df = self.spark.read.schema(kind).parquet(path)
        return df if project_id is None or table == "projects" else df.where(F.col("project_id") == project_id)

    def append(self, table: str, df: DataFrame) -> None:
        kind = schema.TABLES[table]
        df = df.select(*(F.col(f.name).cast(f.dataType) for f in kind))
        if table == "projects":
            df.write.mode("append").parquet(f"{self.base}/{table}")
            return
        sort = {"func_calls": ["project_id", "caller_usr", "usr"], "func_definitions": ["project_id", "usr"], "filepaths": ["project_id", "filepath"]}[table]
        df.repartitionByRange(*sort).sortWithinPartitions(*sort).write.mode("append").partitionBy("project_id").parquet(f"{self.base}/{table}")

    def greatest(self, table: str, column: str, project_id: int | None = None) -> int:
        """MAX(column), 0 of an empty table."""
        return self.read(table, project_id).agg(F.coalesce(F.max(column), F.lit(0))).first()[0]

    def project(self, root: str) -> int:
        """The id of the project at root; a new project gets the greatest id + 1."""
        found = self.read("projects").where(F.col("project_root") == root).agg(F.min("project_id")).first()[0]
        if found is not None:
            return found
        new = self.greatest("projects", "project_id") + 1
        self.append("projects", self.spark.createDataFrame([(new, root)], schema.PROJECTS))
        return new
