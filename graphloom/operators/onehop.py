"""Point queries and one-hop joins over definitions and calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def named(df: DataFrame, names) -> DataFrame:
    names = [names] if isinstance(names, str) else list(names)
    return df.where(F.col("qualified").isin(names))


def overloads_of(definitions: DataFrame, name) -> DataFrame:
    return named(definitions, name).select("qualified", "usr").distinct()


def callers_of(definitions: DataFrame, calls: DataFrame, name) -> DataFrame:
    """A row for each call site of name in a defined function."""
    sites = named(calls, name).where(F.col("caller_usr") != "").select("caller_usr", F.col("qualified").alias("callee"))
    who = definitions.select(F.col("usr").alias("caller_usr"), F.col("qualified").alias("caller"))
    return sites.join(who, "caller_usr").select("callee", "caller_usr", "caller")


def callees_of(definitions: DataFrame, calls: DataFrame, name) -> DataFrame:
    """A row for each call in each overload of name; overloads without calls give none."""
    own = overloads_of(definitions, name).select(F.col("usr").alias("caller_usr"), F.col("qualified").alias("caller"))
    return calls.select("caller_usr", F.col("usr").alias("callee_usr"), F.col("qualified").alias("callee")).join(own, "caller_usr").select("caller", "caller_usr", "callee_usr", "callee")


def callee_counts(definitions: DataFrame, calls: DataFrame) -> DataFrame:
    per = calls.groupBy(F.col("caller_usr").alias("usr")).agg(F.count(F.lit(1)).alias("n_calls"), F.countDistinct("usr").alias("n_callees"))
    return definitions.select("usr", "qualified").join(per, "usr")


def dangling_callers(definitions: DataFrame, calls: DataFrame) -> DataFrame:
    """Callers without a definition, with their numbers of call rows."""
    return calls.where(F.col("caller_usr") != "").groupBy("caller_usr").agg(F.count(F.lit(1)).alias("n_calls")).join(definitions.select(F.col("usr").alias("caller_usr")), "caller_usr", "left_anti")


def latest_names(definitions: DataFrame) -> DataFrame:
    """The qualified name of each usr by the newest row (of equally new ones the greatest name)."""
    return definitions.groupBy("usr").agg(F.max(F.struct("create_time", "qualified")).alias("m")).select("usr", F.col("m.qualified").alias("qualified"))


def definition_ids(definitions: DataFrame, usr: str) -> DataFrame:
    return definitions.where(F.col("usr") == usr).select("func_def_id")


def calls_with_throw(calls: DataFrame, usr: str) -> DataFrame:
    return calls.where(F.col("caller_usr") == usr).select("usr", "qualified", "caller_might_throw")
