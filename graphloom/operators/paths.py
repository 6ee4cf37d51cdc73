"""Graph search over calls: one bounded join for each level, results in tables of the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.onehop import overloads_of
from graphloom.sources.tables import forget, settled

MOST_LEVELS = 10_000


class UnknownFunction(ValueError):
    """The function a search starts from is not defined."""


def edges_of(calls: DataFrame) -> DataFrame:
    """Distinct edges: caller, callee."""
    return calls.where(F.col("caller_usr") != "").select(F.col("caller_usr").alias("caller"), F.col("usr").alias("callee")).distinct()


def levels(edges: DataFrame, start: DataFrame, done=None, most: int | None = None, pieces: list | None = None) -> DataFrame:
    """usr, hops, parent of every node reached from start (column usr): breadth first, the parent is the smallest caller one
    hop nearer. ``done(frontier)`` may end the search after a level; ``most`` bounds the hops."""
    edges = settled(edges)
    frontier = settled(start.select("usr", F.lit(0).alias("hops"), F.lit(None).cast("string").alias("parent")).distinct())
    found, parts, hops = frontier, [frontier], 0
    while not (done and done(frontier)) and (most is None or hops < most):
        hops += 1
        step = frontier.join(edges, frontier["usr"] == edges["caller"]).groupBy(F.col("callee").alias("usr")).agg(F.min("caller").alias("parent"))
        new = settled(step.join(found.select("usr"), "usr", "left_anti").select("usr", F.lit(hops).alias("hops"), "parent"))
        if new.isEmpty():
            forget(new)
            break
        if hops > MOST_LEVELS:
            raise RuntimeError(f"the search is deeper than {MOST_LEVELS} levels")
        frontier = new
        parts.append(new)
        if len(parts) >= 16:  # few files to scan, however deep the graph
            merged = settled(_union(parts))
            parts = [merged]
        found = _union(parts)
    return found


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def starts(definitions: DataFrame, source: str) -> DataFrame:
    own = overloads_of(definitions, source).select("usr").distinct()
    if own.isEmpty():
        raise UnknownFunction(source)
    return own


def reachable(definitions: DataFrame, calls: DataFrame, source: str, most: int | None = None) -> DataFrame:
    """usr, hops, parent of everything that source can reach."""
    return levels(edges_of(calls), starts(definitions, source), most=most)


def back_trace(found: DataFrame, end: str) -> list[str]:
    """From the node that a search ended in back to its start: a lookup for each step of the path."""
    path = [end]
    while (parent := found.where(F.col("usr") == path[-1]).first()["parent"]) is not None:
        path.append(parent)
    return path[::-1]


def _rows(definitions: DataFrame, usrs: list[str], names: dict[str, str]) -> DataFrame:
    spark = definitions.sparkSession
    known = dict(names)
    missing = [u for u in usrs if u not in known]
    if missing:
        known |= {r["usr"]: r["q"] for r in definitions.where(F.col("usr").isin(missing)).groupBy("usr").agg(F.max_by("qualified", F.struct("create_time", "qualified")).alias("q")).collect()}
    return spark.createDataFrame([(i, u, known.get(u)) for i, u in enumerate(usrs)], "step int, usr string, qualified string")


def call_path(definitions: DataFrame, calls: DataFrame, source: str, target: str, compat: bool = False) -> DataFrame:
    """step, usr, qualified along a shortest path; no rows if there is none. The target need not be defined. compat leaves out
    the target's caller, as some tools do."""
    if source == target or not source or not target:
        raise ValueError("a path leads from one function to another")
    begin = starts(definitions, source)
    spots = settled(calls.where((F.col("qualified") == target) & (F.col("caller_usr") != "")).select(F.col("caller_usr").alias("caller"), F.col("usr").alias("goal")).distinct())

    def meets(frontier: DataFrame):
        return frontier.join(spots, frontier["usr"] == spots["caller"])

    found = levels(edges_of(calls), begin, done=lambda f: not meets(f).isEmpty())
    hit = meets(found).groupBy("goal", "hops").agg(F.min("caller").alias("last")).orderBy("hops", "goal").first()
    if hit is None:
        return _rows(definitions, [], {})
    usrs = [*back_trace(found, hit["last"]), hit["goal"]]
    if compat:
        usrs = usrs[:-2] + usrs[-1:]
    return _rows(definitions, usrs, {hit["goal"]: target})


def throwers(definitions: DataFrame, calls: DataFrame, compat: bool = False) -> DataFrame:
    """usr of functions that may throw: by their definition; with compat by their first call row, so leaves are not seen."""
    if not compat:
        return definitions.where("might_throw").select("usr").distinct()
    first = calls.groupBy(F.col("caller_usr").alias("usr")).agg(F.min_by("caller_might_throw", "func_call_id").alias("t"))
    return first.where("t").select("usr")


def throw_path(definitions: DataFrame, calls: DataFrame, source: str, compat: bool = False) -> DataFrame:
    """step, usr, qualified along a shortest path to a function that may throw; no rows if there is none."""
    begin = starts(definitions, source)
    ends = settled(throwers(definitions, calls, compat))
    found = levels(edges_of(calls), begin, done=lambda f: not f.join(ends, "usr", "left_semi").isEmpty())
    hit = found.join(ends, "usr", "left_semi").orderBy("hops", "usr").first()
    return _rows(definitions, back_trace(found, hit["usr"]) if hit else [], {})
