"""Connected components by alternating large and small stars, until only stars are left; every round is a table in the
shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import drop, written

MOST_ROUNDS, SALTS = 60, 64


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its smallest reachable node) for every node of the edges; rows with a null or a loop add nothing.

    Each round maps a node's neighbours to the smallest of them; the stars it ends in are the components. A hot node is
    pre-aggregated by min(), and its join is dealt to SALTS tasks by neighbour; no group is gathered."""
    now = written(edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).where("lo < hi").distinct(), "edges")
    for _ in range(MOST_ROUNDS):
        if all_stars(now):
            break
        done = written(small_star(large_star(now)), "edges")
        drop(now)
        now = done
    else:
        raise RuntimeError("the components did not settle")
    lows = now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(lows)


def all_stars(e: DataFrame) -> bool:
    """Whether every node is either the smallest of its edges or the larger end of a single one."""
    ends = e.select(F.col("lo").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down")).unionByName(e.select(F.col("hi").alias("u"), F.lit(1).alias("up"), F.lit(0).alias("down")))
    ups, downs = F.sum("up"), F.max("down")
    return ends.groupBy("u").agg(ups.alias("ups"), downs.alias("downs")).where("ups > 1 or (ups > 0 and downs > 0)").isEmpty()


def least_of(e: DataFrame, node: str, neighbour: str) -> tuple[DataFrame, DataFrame]:
    """e with a salt made of the neighbour, and each node's smallest neighbour m, a row for each of its salts."""
    salted = e.withColumn("salt", F.pmod(F.xxhash64(neighbour), F.lit(SALTS)).cast("int"))
    each = salted.groupBy(node, "salt").agg(F.min(neighbour).alias("m"))
    least = each.groupBy(node).agg(F.min("m").alias("m"), F.collect_list("salt").alias("salts"))
    return salted, least.select(node, "m", F.explode("salts").alias("salt"))


def large_star(e: DataFrame) -> DataFrame:
    """Larger neighbours of a node go to the smallest node of its neighbourhood."""
    both = e.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(e.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
    salted, least = least_of(both, "u", "v")
    joined = salted.where(F.col("v") > F.col("u")).join(least, ["u", "salt"])
    return joined.select(F.least("m", "u").alias("lo"), F.col("v").alias("hi")).where("lo < hi").distinct()


def small_star(e: DataFrame) -> DataFrame:
    """Smaller neighbours of a node, and the node, go to the smallest of them."""
    salted, least = least_of(e, "hi", "lo")
    other = F.when(F.col("lo") == F.col("m"), F.col("hi")).otherwise(F.col("lo"))
    return salted.join(least, ["hi", "salt"]).select(F.col("m").alias("lo"), other.alias("hi")).where("lo < hi").distinct()
