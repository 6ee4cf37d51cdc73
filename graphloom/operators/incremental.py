"""What has to be indexed again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_index_times(filepaths: DataFrame) -> DataFrame:
    """filepath, last_index: epoch seconds of its newest version, 0 without a time."""
    return filepaths.groupBy("filepath").agg(F.coalesce(F.unix_timestamp(F.max("create_time")), F.lit(0)).alias("last_index"))


def last_index_time(filepaths: DataFrame, path: str) -> int:
    return filepaths.where(F.col("filepath") == path).agg(F.coalesce(F.unix_timestamp(F.max("create_time")), F.lit(0))).first()[0]


def file_known(filepaths: DataFrame, path: str) -> bool:
    return not filepaths.where(F.col("filepath") == path).isEmpty()


def file_obsolete(filepaths: DataFrame, path: str, seconds: int) -> bool:
    """Whether a file of this time is newer than every version of the path."""
    return seconds > last_index_time(filepaths, path)


def staleness(units: DataFrame, includes: DataFrame) -> DataFrame:
    """units: tu, own_mtime, last_index (timestamps; null: missing on disk, never indexed), analysed (false: the include scan
    failed). includes: tu, include_mtime (null: missing). Adds newest_include, reason and need_reindex, by the first that fits:
    missing (no), never_indexed, own_newer, scan_failed, include_missing, include_newer, fresh (no)."""
    newest = includes.groupBy("tu").agg(F.max("include_mtime").alias("newest_include"), F.max(F.col("include_mtime").isNull()).alias("_lost"))
    out = units.join(newest, "tu", "left")
    reason = (
        F.when(F.col("own_mtime").isNull(), "missing")
        .when(F.col("last_index").isNull(), "never_indexed")
        .when(F.col("own_mtime") > F.col("last_index"), "own_newer")
        .when(~F.coalesce(F.col("analysed"), F.lit(True)), "scan_failed")
        .when(F.coalesce(F.col("_lost"), F.lit(False)), "include_missing")
        .when(F.col("newest_include") > F.col("last_index"), "include_newer")
        .otherwise("fresh")
    )
    return out.withColumn("reason", reason).drop("_lost").withColumn("need_reindex", ~F.col("reason").isin("missing", "fresh"))


def to_index(units: DataFrame, includes: DataFrame, only: str | None = None) -> DataFrame:
    stale = staleness(units, includes).where("need_reindex").select("tu")
    return stale if only is None else stale.where(F.col("tu") == only)
