"""From symbol occurrences to definition and call rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions import scalars
from graphloom.sources import schema
from graphloom.sources.tables import numbered


def is_function(kind: Column) -> Column:
    return F.coalesce(kind.isin(*schema.FUNCTION_KINDS), F.lit(False))


def role(is_def: Column, is_decl: Column) -> Column:
    """'def' with the definition role, else null with the declaration role, else 'call': any reference counts as a call."""
    return F.when(is_def, "def").when(is_decl, F.lit(None)).otherwise("call")


def usable_units(occurrences: DataFrame, diagnostics: DataFrame | None = None) -> DataFrame:
    """Occurrences without those of failed TUs. diagnostics: tu, level; a TU with an error is dropped as a whole."""
    bad = occurrences.where(~F.col("tu_ok")).select("tu")
    if diagnostics is not None:
        bad = bad.unionByName(diagnostics.where(F.col("level").isin("error", "fatal")).select("tu"))
    return occurrences.join(bad.distinct(), "tu", "left_anti")


def classified(occurrences: DataFrame) -> DataFrame:
    """Functions and non-builtin macros with fact ('def' or 'call'), caller_usr, usr and qualified; the rest is dropped."""
    macro = F.col("is_macro")
    kept = occurrences.where((macro & ~F.col("is_builtin")) | (~macro & is_function(F.col("kind"))))
    caller = F.when(~macro & is_function(F.col("container_kind")), F.coalesce("container_usr", F.lit(""))).otherwise(F.lit(""))
    out = kept.withColumns({"fact": role(F.col("is_def"), F.col("is_decl")), "caller_usr": caller})
    named = {c: F.when(macro, scalars.macro_key(F.col("qualified"))).otherwise(scalars.simplify_anonymous(F.col(c)) if c == "qualified" else F.col(c)) for c in ("usr", "qualified")}
    return out.where(F.col("fact").isNotNull()).withColumns(named).withColumn("might_throw", F.when(macro, F.lit(False)).otherwise(F.col("might_throw")))


def definition_fault(usr: Column, qualified: Column, file_id: Column) -> Column:
    """Why a definition row is rejected; null: accepted."""
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    return F.when(blank(usr), "no_usr").when(blank(qualified), "no_name").when(F.coalesce(file_id, F.lit(-1)) < 0, "out_of_project")


def call_fault(caller_usr: Column, file_id: Column) -> Column:
    return F.when(F.coalesce(caller_usr, F.lit("")) == "", "no_caller").when(F.coalesce(file_id, F.lit(-1)) < 0, "out_of_project")


def first_writers(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The row with the smallest func_def_id for each usr; usrs that are known already give none."""
    if known is not None:
        rows = rows.join(known.select("usr").distinct(), "usr", "left_anti")
    rest = [c for c in rows.columns if c != "usr"]
    least = rows.groupBy("usr").agg(F.min_by(F.struct(*rest), F.struct("func_def_id", *(c for c in rest if c != "func_def_id"))).alias("r"))
    return least.select("usr", "r.*").select(*rows.columns)


def assigned_file_ids(paths: DataFrame, known: DataFrame, above: int | None = None) -> DataFrame:
    """filepath, filepath_id for each distinct path: the smallest known id, new paths get successive ids by path."""
    least = known.groupBy("filepath").agg(F.min("filepath_id").alias("filepath_id"))
    top = above if above is not None else known.agg(F.coalesce(F.max("filepath_id"), F.lit(0))).first()[0]
    distinct = paths.select("filepath").distinct()
    old = distinct.join(least, "filepath")
    new = numbered(distinct.join(least, "filepath", "left_anti"), "filepath_id", ["filepath"], top)
    return old.unionByName(new)


def located(rows: DataFrame, root: str, files: DataFrame) -> DataFrame:
    """Adds location_file_id: of the file's normal path below root; -1 outside the project."""
    path = scalars.clamp_path(scalars.relative_path(scalars.normal_path(F.col("file")), F.lit(root)))
    with_path = rows.withColumn("filepath", F.when(path != "", path))
    out = with_path.join(files, "filepath", "left")
    return out.withColumn("location_file_id", F.coalesce("filepath_id", F.lit(schema.INVALID_FILE_ID)).cast("long")).drop("filepath_id")


def latest_versions(filepaths: DataFrame) -> DataFrame:
    """The newest row of each path (of equally new ones the one with the greatest id)."""
    w = Window.partitionBy("filepath").orderBy(F.desc("create_time"), F.desc("filepath_id"))
    return filepaths.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upserted(filepaths: DataFrame, new: DataFrame) -> DataFrame:
    """REPLACE by filepath_id."""
    return filepaths.join(new.select("filepath_id"), "filepath_id", "left_anti").unionByName(new)
