"""The compilation database: a JSON array of compile commands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.sources import schema

KIND = "directory string, file string, command string, arguments array<string>, output string"


def read_compile_commands(spark: SparkSession, path: str) -> DataFrame:
    """position, directory, file, arguments of each entry, in the order of the array; an absent or empty file is an error."""
    raw = spark.read.option("wholetext", True).text(path)
    parsed = raw.select(F.posexplode(F.from_json("value", f"array<struct<{', '.join(c.replace(' ', ': ', 1) for c in KIND.split(', '))}>>")).alias("position", "entry"))
    out = parsed.select("position", "entry.*").withColumn("arguments", F.coalesce("arguments", F.split(F.trim("command"), " +"))).drop("command")
    if out.isEmpty():
        raise ValueError(f"no compile commands in {path}")
    return out


def compiler_accepted(arguments: Column) -> Column:
    """Whether the tool is one of the known compilers and exactly one source is compiled."""
    tool = F.element_at(F.split(F.element_at(arguments, 1), "/"), -1)
    sources = F.size(F.filter(F.slice(arguments, 2, 1 << 30), lambda a: ~F.startswith(a, F.lit("-")) & a.rlike(r"\.(c|cc|cpp|cxx|m|mm)$")))
    return tool.isin(*schema.COMPILERS) & (sources == 1)


def file_times(spark: SparkSession, path: str) -> DataFrame:
    """path, mtime in whole seconds, from the files' metadata; contents are not read."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.unix_timestamp("modificationTime").alias("mtime"))
