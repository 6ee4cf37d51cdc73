"""Mixing sources to target weights by cube-method balanced sampling.

Every document of a source is expected ``target / source size`` times (3 at most). The whole part is certain; the rest is an
inclusion probability, settled by the cube method: among three undecided documents, the probabilities move along the null
space of the constraints (sum of documents, sum of words) until one is decided, so both totals of the source stay as they
are. A source is dealt at random into blocks of about BLOCK documents, each leaves two undecided ones or so, which meet in the
next round's blocks; the last block of a source lands by the choice, and one exchange, that miss the word total least.

Defined cases: null and blank texts have size 0 and take nothing; a null source comes last; an empty source (size 0) has
target 0; without words all targets are 0; repeated rows and rows that share an id are drawn one by one; an empty table gives
none. Only the id, text and source columns are read. Sources are few by nature: one row for each goes to the driver.
"""

from __future__ import annotations

import math
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import n_words, read, with_row_ids, written

WEIGHTS, MOST_TIMES, BLOCK, TINY, SEED, MOST_LEVELS = (1, 2, 3), 3, 2000, 1e-9, 11, 60


def targets(sizes: dict, weights=WEIGHTS, most: float = MOST_TIMES) -> dict:
    """The target of each source: shares of all sizes by weight; what lies above most times a source's size goes to the
    others by weight, until none is above."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full: dict = {}
    while True:
        rest = [s for s in order if s not in full]
        left, total = sum(sizes.values()) - sum(full.values()), sum(weight[s] for s in rest)
        over = [s for s in rest if left * weight[s] / total > most * sizes[s]]
        if not over:
            return full | {s: left * weight[s] / total for s in rest}
        full |= {s: most * sizes[s] for s in over}


def flight(size: list[float], p: list[float], random) -> list[float]:
    """Moves probabilities until at most two can move no further; keeps sum(p) and sum(p * size)."""
    p = list(p)
    waiting = [i for i in range(len(p)) if TINY < p[i] < 1 - TINY][::-1]
    active: list[int] = []
    while True:
        while waiting and len(active) < 3:
            active.append(waiting.pop())
        if len(active) == 3:
            a, b, c = (size[i] for i in active)
            u = (b - c, c - a, a - b)
            if u == (0, 0, 0):
                u = (1.0, -1.0, 0.0)
        elif len(active) == 2 and size[active[0]] == size[active[1]]:
            u = (1.0, -1.0)
        else:
            return p
        ahead = min((1 - p[i]) / d if d > 0 else p[i] / -d for i, d in zip(active, u, strict=True) if d)
        back = min(p[i] / d if d > 0 else (1 - p[i]) / -d for i, d in zip(active, u, strict=True) if d)
        step = ahead if random() * (ahead + back) < back else -back
        for i, d in zip(active, u, strict=True):
            v = p[i] + step * d
            p[i] = 0.0 if v < TINY else 1.0 if v > 1 - TINY else v
        active = [i for i in active if 0 < p[i] < 1]


def landing(size: list[float], start: list[float], p: list[float]) -> list[float]:
    """Decides the few undecided: of all choices, the one that misses the words least, then the documents. What it still
    misses is made up by the best exchange of one document taken for one not taken, so the number of documents stays."""
    open_ = [i for i in range(len(p)) if 0 < p[i] < 1]
    best = min(product((0.0, 1.0), repeat=len(open_)), key=lambda c: (abs(sum((x - p[i]) * size[i] for x, i in zip(c, open_, strict=True))), abs(sum(x - p[i] for x, i in zip(c, open_, strict=True))), c))
    p = list(p)
    for x, i in zip(best, open_, strict=True):
        p[i] = x
    over = sum((x - y) * s for x, y, s in zip(p, start, size, strict=True))
    taken, spare = ([i for i in range(len(p)) if p[i] == v] for v in (1.0, 0.0))
    if taken and spare:
        spare.sort(key=lambda i: size[i])
        sizes = np.array([size[i] for i in spare])
        want = np.array([size[i] for i in taken]) - over
        at = np.searchsorted(sizes, want)
        miss, i, j = min((abs(float(sizes[j] - want[k])), i, spare[j]) for k, i in enumerate(taken) for j in (max(0, at[k] - 1), min(at[k], len(spare) - 1)))
        if miss < abs(over):
            p[i], p[j] = 0.0, 1.0
    return p


def settle(rows: DataFrame) -> DataFrame:
    """One round: rows (rid, rank, size, p, r, block, last) with p moved to 0 or 1 but for a few in each block."""

    def run(table: pa.Table) -> pa.Table:
        order = np.lexsort((table.column("rid").to_numpy(), table.column("r").to_numpy()))
        table = table.take(pa.array(order))
        size, p, r = table.column("size").to_numpy().astype(float).tolist(), table.column("p").to_numpy().tolist(), table.column("r").to_numpy()
        start, random = p, np.random.default_rng([SEED, len(p), int(r[0]) & 0xFFFFFFFF]).random
        p = flight(size, p, random)
        if table.column("last")[0].as_py():
            p = landing(size, start, p)
        return table.select(["rid", "rank", "size", "r"]).append_column("p", pa.array(p, pa.float64()))

    return rows.groupBy("rank", "block").applyInArrow(run, "rid long, rank int, size long, r long, p double")


def mix(docs: DataFrame, weights=WEIGHTS, most: float = MOST_TIMES, block: int = BLOCK) -> DataFrame:
    """rid, doc_id, size, source_size, target, copies for every row of docs (rid, doc_id, text, source)."""
    spark = docs.sparkSession
    sized = written(docs.select("rid", "doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")
    facts = {r["source"]: (r["size"] or 0, r["n"]) for r in sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()}
    wanted = targets({s: v[0] for s, v in facts.items()}, weights, most) if facts else {}
    table = []
    for rank, s in enumerate(wanted):
        words, n = facts[s]
        times = min(wanted[s] / words, most) if words else 0.0
        whole = math.floor(times + TINY)
        table.append((s, rank, words, float(wanted[s]), whole, max(0.0, times - whole), max(1, math.ceil(n / block))))
    plan = spark.createDataFrame(table, "s string, rank int, source_size long, target double, whole int, p double, blocks int")
    rows = sized.join(plan, F.col("source").eqNullSafe(F.col("s"))).withColumn("r", F.xxhash64("rid", F.lit(SEED)))
    open_ = rows.where(f"p > {TINY}").select("rid", "rank", "size", "p", "r", F.pmod(F.xxhash64("r"), "blocks").cast("int").alias("block"), (F.col("blocks") == 1).alias("last"))
    settled = []
    for level in range(1, MOST_LEVELS + 1):
        done = written(settle(open_), "settled")
        settled.append(done.where("p = 0 or p = 1").select("rid", "p"))
        rest = done.where("p > 0 and p < 1")
        counts = {r["rank"]: r["n"] for r in rest.groupBy("rank").agg(F.count(F.lit(1)).alias("n")).collect()}
        if not counts:
            break
        if level == MOST_LEVELS:
            raise RuntimeError("the sampling did not settle")
        blocks = spark.createDataFrame([(k, math.ceil(n / block)) for k, n in counts.items()], "rank int, blocks int")
        open_ = rest.join(blocks, "rank").select("rid", "rank", "size", "p", "r", F.pmod(F.xxhash64("r", F.lit(level)), "blocks").cast("int").alias("block"), (F.col("blocks") == 1).alias("last"))
    chosen = settled[0]
    for more in settled[1:]:
        chosen = chosen.unionByName(more)
    out = rows.select("rid", "doc_id", "size", "source_size", "target", "whole").join(chosen.withColumnRenamed("p", "more"), "rid", "left")
    return out.select("rid", "doc_id", "size", "source_size", "target", (F.col("whole") + F.coalesce("more", F.lit(0.0)).cast("int")).alias("copies"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_row_ids(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies")


QUERIES = {"op8_source_mixing": op8_source_mixing}
