"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.sources import schema


def starts_with(c: Column, prefix: str) -> Column:
    return F.startswith(c, F.lit(prefix))


def ends_with(c: Column, suffix: str) -> Column:
    return F.endswith(c, F.lit(suffix))


def split_parts(c: Column, delimiter: str) -> Column:
    """Parts between delimiters; an empty last part is dropped, inner empty ones stay."""
    parts = F.split(c, rf"\Q{delimiter}\E")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def path_request(c: Column) -> Column:
    """struct<source, target> of a request of exactly two non-empty, different parts around ``;``, else null."""
    p = split_parts(c, ";")
    fits = (F.size(p) == 2) & (F.get(p, F.lit(0)) != "") & (F.get(p, F.lit(1)) != "") & (F.get(p, F.lit(0)) != F.get(p, F.lit(1)))
    return F.when(fits, F.struct(F.get(p, F.lit(0)).alias("source"), F.get(p, F.lit(1)).alias("target")))


def replace_all(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def relative_path(c: Column, root: Column, boundary: bool = True) -> Column:
    """The path below the project root; '' for the root itself; null outside. With boundary, /a/b is no root of /a/bc."""
    base = F.regexp_replace(root, "/+$", "") if boundary else root
    below = F.regexp_replace(F.substring(c, F.length(base) + 1, F.length(c)), "^/+", "")
    inside = F.startswith(c, F.concat(base, F.lit("/"))) if boundary else F.startswith(c, base)
    return F.when((c == root) | (c == base), F.lit("")).when(inside, below)


def normal_path(c: Column) -> Column:
    """The path without ``.``, empty parts and ``x/..``, so that one file has one path; ``..`` in front of all else stays in a
    relative path. Links are not followed."""
    rooted = F.startswith(c, F.lit("/"))
    parts = F.filter(F.split(c, "/"), lambda p: (p != "") & (p != "."))

    def step(done, p):
        up = (p == "..") & (F.size(done) > 0) & (F.coalesce(F.element_at(done, -1), F.lit("")) != "..")
        kept = F.when((p == "..") & rooted, done).otherwise(F.concat(done, F.array(p)))
        return F.when(up, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(kept)

    done = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return F.when(rooted, F.concat(F.lit("/"), done)).when(done == "", F.lit(".")).otherwise(done)


def clamp_path(c: Column) -> Column:
    return F.when(F.length(c) > schema.LONGEST_PATH, F.lit(schema.LONG_PATH)).otherwise(c)


def simplify_anonymous(c: Column) -> Column:
    c = F.replace(c, F.lit("(anonymous namespace)"), F.lit("(anon ns)"))
    return F.replace(c, F.lit("(anonymous "), F.lit("(anon "))


def short_name(qualified: Column) -> Column:
    """What follows the last ``::`` that stands outside of parentheses and template arguments."""
    bare = F.regexp_replace(F.regexp_replace(qualified, r"\([^()]*\)", ""), r"<[^<>]*>$", "")
    return F.element_at(F.split(bare, "::"), -1)


def location(file_id: Column, line: Column, column: Column) -> Column:
    """A place in a file; an unknown file is INVALID_FILE_ID, an unknown line or column null."""
    return F.struct(F.coalesce(file_id, F.lit(schema.INVALID_FILE_ID)).cast("long").alias("file_id"), line.cast("long").alias("line"), column.cast("long").alias("column"))


def body_range(begin: Column, end: Column) -> Column:
    """From one location to another in the same file, else null."""
    return F.when(begin["file_id"] == end["file_id"], F.struct(begin.alias("begin"), end.alias("end")))


def macro_key(name: Column) -> Column:
    return F.concat(F.lit(schema.MACRO_PREFIX), name)


def is_macro(usr: Column) -> Column:
    return F.startswith(usr, F.lit(schema.MACRO_PREFIX))


def from_epoch(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def to_epoch(time: Column) -> Column:
    return F.unix_timestamp(time)


def stable_hash(usr: Column) -> Column:
    return F.xxhash64(usr)


def indent(depth: Column) -> Column:
    return F.repeat(F.lit("    "), depth)
