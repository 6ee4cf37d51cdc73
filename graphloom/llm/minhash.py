"""MinHash near-dedup with min-max hashing.

A text's set is its distinct runs of K words (a shorter text is one run; A-Z are lower-cased; a text without words has an
empty set and is linked with nothing). Two documents are linked if 100 * |intersection| >= SIMILAR * |union|.

1. Each of PERMUTATIONS hash functions gives a signature its minimum and its maximum over the set, so half as many hashes
   are evaluated. ROWS values make a band (both values of ROWS / 2 functions). At similarity 0.8 a pair is missed by all bands with
   probability (1 - 0.8**ROWS)**bands, 5e-8 for the defaults.
2. Documents with equal sets are one class, named by its smallest id. Only classes go on, so groups of copies cost nothing.
3. In each bucket of a band, the classes are tied to the smallest one (never to each other); the components of these ties
   are the clusters in which all links of the bands lie.
4. A cluster's texts meet in blocks of about BLOCK classes or BLOCK * UNIT bytes, whichever is less (a longer text counts for
   more). A block's full sets are intersected at once (one sparse
   matrix product), which confirms links exactly. From each part of a block that hangs together, if not of one class, its member with
   most links goes to the next level, until a cluster fits one block or blocks stop shrinking.
5. What blocks kept apart: in each bucket that still holds different parts, the signatures (a byte of each value) are
   compared across parts. A link at the wanted similarity is estimated SIGMAS deviations lower with probability 2e-8. Classes with such
   a neighbour form groups by the components of these estimates, so a cluster of classes that only share buckets by chance
   falls apart. Each two slices of BLOCK classes of a group meet in one task, which intersects full sets again and returns
   no pairs but the links along which parts hang together. The components of the confirmed links are the result.

Defined cases: null, empty and blank texts have n_shingles 0, are their own component and are kept; rows that share an
id are each compared and counted by their own text, and share the smallest id that any of them reaches; rows with a null id are kept and
never linked; an empty table gives none. Only the id and text columns are read, so further columns may have any name. No cap is set on bucket or cluster sizes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import LOWER, Prefix, batches_of, chunks, drop, mix, read, shingles, text_bytes, tokens, with_row_ids, written
from graphloom.llm.components import components

PERMUTATIONS, ROWS, BLOCK, SIMILAR, SIGMAS, UNIT = 64, 4, 512, 80, 5.5, 1 << 16
_RNG = np.random.default_rng(7)
_XOR = _RNG.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
_MUL = _RNG.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) | np.uint64(1)


def shingle_sets(data: np.ndarray, starts: np.ndarray, k: int) -> list[np.ndarray]:
    """For each text its sorted distinct shingle hashes."""
    data = LOWER[data]
    begin, end, first = tokens(data, starts)
    h = Prefix(data).of(begin, end) if len(begin) else np.zeros(0, np.uint64)
    runs = shingles(h, k)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        n = b - a
        if n >= k:
            out.append(np.unique(runs[a : b - k + 1]))
        elif n:
            s = h[a:a + 1]
            for j in range(a + 1, b):
                s = mix(s * np.uint64(0x9E3779B97F4A7C15) + h[j : j + 1])
            out.append(mix(s ^ np.uint64(n)))
        else:
            out.append(h[:0])
    return out


def signatures(sets: list[np.ndarray], permutations: int = PERMUTATIONS) -> np.ndarray:
    """Minimum and maximum of each hash function over each (not empty) set: one row for each set."""
    flat = np.concatenate(sets)
    at = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((len(sets), 2 * permutations), np.uint64)
    for j in range(permutations):
        v = (flat ^ _XOR[j]) * _MUL[j]
        out[:, 2 * j] = np.minimum.reduceat(v, at)
        out[:, 2 * j + 1] = np.maximum.reduceat(v, at)
    return out


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    cut = sig[:, : sig.shape[1] // rows * rows].reshape(len(sig), -1, rows)
    key = np.broadcast_to(np.arange(1, cut.shape[1] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), cut.shape[:2]).copy()
    for r in range(rows):
        key = mix(key ^ cut[:, :, r]) * np.uint64(0xD6E8FEB86659FD93)
    return key


def sketch(docs: DataFrame, k: int, permutations: int = PERMUTATIONS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, set_a, set_b (128 bits that tell sets apart), bands, short (a byte of each value of the signature)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = text_bytes(batch.column(1))
            for i, j in chunks(starts):
                part = starts[i : j + 1]
                sets = shingle_sets(data[part[0] : part[-1]], part - part[0], k)
                n = np.array([len(s) for s in sets])
                full = np.flatnonzero(n)
                a, b = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
                bands, short = [None] * len(sets), [None] * len(sets)
                if len(full):
                    own = [sets[x] for x in full]
                    flat, at = np.concatenate(own), np.cumsum([0, *(len(s) for s in own[:-1])])
                    a[full] = mix(np.add.reduceat(mix(flat ^ np.uint64(0xA5A5A5A5)), at))
                    b[full] = mix(np.bitwise_xor.reduceat(mix(flat + np.uint64(0x5851F42D4C957F2D)), at) + n[full].astype(np.uint64))
                    sig = signatures(own, permutations)
                    for x, keys, low in zip(full, band_keys(sig, rows).view(np.int64), sig.astype(np.uint8), strict=True):
                        bands[x], short[x] = keys, low.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(bands, pa.list_(pa.int64())), pa.array(short, pa.binary())], ["doc_id", "n_shingles", "set_a", "set_b", "bands", "short"])

    batches_of(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, short binary")


def links_of(sets: list[np.ndarray], similar: int) -> np.ndarray:
    """Which sets of a block are linked: a square boolean matrix, from full intersections."""
    n = np.array([len(s) for s in sets], np.int64)
    flat, who = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    order = np.argsort(flat, kind="stable")
    flat, who = flat[order], who[order]
    new = np.concatenate(([True], flat[1:] != flat[:-1]))
    group = np.cumsum(new) - 1
    shared = np.bincount(group) > 1
    keep = shared[group]
    column, who = (np.cumsum(shared) - 1)[group[keep]], who[keep]
    both = np.zeros((len(sets), len(sets)), np.float64)
    for c in range(0, int(shared.sum()), 8192):
        lo, hi = np.searchsorted(column, (c, c + 8192))
        m = np.zeros((len(sets), 8192), np.float32)
        m[who[lo:hi], column[lo:hi] - c] = 1
        both += m @ m.T
    both = both.astype(np.int64)
    out = 100 * both >= similar * (n[:, None] + n[None, :] - both)
    np.fill_diagonal(out, False)
    return out


def parts_of(linked: np.ndarray) -> np.ndarray:
    """For each member of a block the first member of its part."""
    part = np.full(len(linked), -1)
    for i in range(len(linked)):
        if part[i] < 0:
            front = np.zeros(len(linked), bool)
            front[i] = True
            seen = front
            while front.any():
                front = linked[front].any(axis=0) & ~seen
                seen = seen | front
            part[seen] = i
    return part


def confirm_blocks(members: DataFrame, k: int, similar: int) -> DataFrame:
    """members: block, block2, cid, text. Gives cid, low, center: the smallest class of the part of a
    block, along its links, and the one with most links."""

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("cid").to_numpy())
        table = table.take(pa.array(order))
        ids = table.column("cid").to_numpy()
        data, starts = text_bytes(table.column("text"))
        sets = [s for i, j in chunks(starts) for s in shingle_sets(data[starts[i] : starts[j]], starts[i : j + 1] - starts[i], k)]
        linked = links_of(sets, similar)
        part, degree = parts_of(linked), linked.sum(axis=1)
        center = part.copy()
        for p in np.unique(part):
            own = np.flatnonzero(part == p)
            center[own] = own[np.argmax(degree[own])]
        return pa.table({"cid": ids, "low": ids[part], "center": ids[center]})

    return members.groupBy("block", "block2").applyInArrow(run, "cid long, low long, center long")


def near_duplicates(docs: DataFrame, k: int = 4, similar: int = SIMILAR, block: int = BLOCK, permutations: int = PERMUTATIONS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if docs.groupBy("doc_id").count().where("doc_id is not null and count > 1").limit(1).count():
        return by_rows(docs, k, similar, block, permutations, rows)
    sig = written(sketch(docs, k, permutations, rows), "sketch")
    named = sig.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = written(named.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("cid")), "classes")
    banded = named.join(classes.select(F.col("cid").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("cid"), "bands", "short")
    entries = banded.select("cid", F.explode("bands").alias("key"))
    least = entries.groupBy("key").agg(F.min("cid").alias("center"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    ties = written(entries.join(least.hint("merge"), "key").where(F.col("cid") != F.col("center")).select("center", "cid").distinct(), "ties")
    clusters = written(components(ties, "center", "cid").select(F.col("node").alias("cid"), F.col("component").alias("cluster")), "clusters")
    drop(ties)
    # the texts of cluster members, moved once for all levels
    members = written(clusters.hint("merge").join(docs.withColumnRenamed("doc_id", "cid"), "cid").select("cid", "cluster", "text", units(F.col("text")).alias("units")), "members")
    links, active, apart = [], members.select("cid", "cluster", "units"), False
    for level in range(20):
        sizes = active.groupBy("cluster").agg(F.sum("units").alias("size"))
        dealt = active.join(sizes, "cluster").withColumn("block2", F.pmod(F.xxhash64("cid", F.lit(level)), F.ceil(F.col("size") / block)).cast("int"))
        found = written(confirm_blocks(dealt.join(members.select("cid", "text"), "cid").select(F.col("cluster").alias("block"), "block2", "cid", "text"), k, similar), "links")
        links.append(found)
        large = sizes.where(F.col("size") > block).select("cluster")
        if not large.limit(1).count():
            break
        apart = True
        before = active.join(large, "cluster", "left_semi")
        tops = found.groupBy(F.col("center").alias("cid")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("cid")
        after = written(before.join(tops, "cid", "left_semi").select("cid", "cluster", "units"), "active")
        shrunk = after.count() < 0.7 * before.count()
        active = after
        if not shrunk:
            break
    edges = links[0]
    for more in links[1:]:
        edges = edges.unionByName(more)
    if apart:
        edges = edges.unionByName(across(edges, banded, members, k, similar, block))
    parts = components(edges, "low", "cid")
    result = named.select("doc_id", "set_a", "set_b").join(classes, ["set_a", "set_b"]).join(parts.withColumnRenamed("node", "cid"), "cid", "left").select("doc_id", F.coalesce("component", "cid").alias("component_id"))
    out = sig.select("doc_id", "n_shingles").join(result, "doc_id", "left")
    out = out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("component_id").eqNullSafe(F.col("doc_id")).alias("kept"))


def units(text: Column) -> Column:
    """What a class counts for in a block: one, and one more for each UNIT bytes of its text, so that a block is bounded in bytes."""
    return F.lit(1) + F.floor(F.octet_length(text) / UNIT).cast("long")


def by_rows(docs: DataFrame, *how: int) -> DataFrame:
    """The same where rows share ids: each row is a document of its own, named by its row number while links are searched; the rows
    of one id and of the components they lie in then share the smallest id."""
    numbered = with_row_ids(docs.where("doc_id is not null"))
    found = near_duplicates(numbered.select(F.col("rid").alias("doc_id"), "text"), *how)
    named = found.select(F.col("doc_id").alias("rid"), "n_shingles", F.col("component_id").alias("part")).join(numbered.select("rid", "doc_id"), "rid")
    named = written(named, "named")
    # ids whose rows lie in one part hang together, each tied to the smallest of them
    firsts = named.groupBy("part").agg(F.min("doc_id").alias("first"))
    ties = named.where("n_shingles > 0").join(firsts, "part").select("first", "doc_id").distinct()
    whole = components(ties, "first", "doc_id").select(F.col("node").alias("doc_id"), "component")
    out = named.join(whole, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    out = out.withColumn("kept", F.col("component_id") == F.col("doc_id"))
    return out.unionByName(near_duplicates(docs.where("doc_id is null"), *how))


def slices(size: Column, most: int) -> Column:
    """The slice of a class (column cid) of a group, and how many there are: one, or as many as hold about ``most`` classes."""
    m = F.ceil(size / most).cast("int")
    return F.struct(F.pmod(F.xxhash64("cid", F.lit(-1)), m).cast("int").alias("s"), m.alias("m"))


def meetings(of: Column) -> Column:
    """The tasks where a slice meets each other one; a number for each two slices."""
    other = F.filter(F.sequence(F.lit(0), of["m"] - 1), lambda t: t != of["s"])
    return F.when(of["m"] == 1, F.array(F.lit(0))).otherwise(F.transform(other, lambda t: F.least(t, of["s"]) * of["m"] + F.greatest(t, of["s"])))


def estimated_links(rows: DataFrame, similar: int, sigmas: float = SIGMAS) -> DataFrame:
    """rows: key, block2, cid, part, short. Gives cid, center: the classes whose signature agrees with one of another part as
    that of a link may, and the smallest class that they hang together with along such pairs."""

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(table.column("cid").to_numpy())))
        ids, part = table.column("cid").to_numpy(), table.column("part").to_numpy()
        values = np.frombuffer(b"".join(table.column("short").to_pylist()), np.uint8).reshape(len(ids), -1)
        n, p = values.shape[1], similar / 100
        least = n * p - sigmas * (n * p * (1 - p)) ** 0.5
        near = np.zeros((len(ids), len(ids)), bool)
        for i in range(len(ids)):
            near[i] = (np.count_nonzero(values == values[i], axis=1) >= least) & (part != part[i])
        some, first = near.any(axis=1), parts_of(near)
        return pa.table({"cid": ids[some], "center": ids[first[some]]})

    return rows.groupBy("key", "block2").applyInArrow(run, "cid long, center long")


def across(edges: DataFrame, banded: DataFrame, members: DataFrame, k: int, similar: int, block: int) -> DataFrame:
    """What confirm_blocks gives for parts of clusters that did not fit one block; each task gives at most a row for each member."""
    parts = components(edges, "low", "cid").withColumnRenamed("node", "cid")
    held_by = members.select("cid", "cluster", "units")
    large = held_by.groupBy("cluster").agg(F.sum("units").alias("n")).where(F.col("n") > block).select("cluster")
    here = held_by.join(large, "cluster", "left_semi").join(parts, "cid", "left").select("cid", F.coalesce("component", "cid").alias("part"))
    held = written(banded.join(here, "cid").select("cid", "part", F.explode("bands").alias("key")), "held")
    mixed = held.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo < hi").select("key", "size")
    met = held.join(mixed, "key").select("key", "cid", "part", F.explode(meetings(slices(F.col("size"), 4 * block))).alias("block2"))
    near = estimated_links(met.join(banded.select("cid", "short"), "cid"), similar)
    groups = written(components(near, "center", "cid").withColumnRenamed("node", "cid"), "groups")
    drop(held)
    sizes = groups.join(held_by, "cid").groupBy("component").agg(F.sum("units").alias("size"))
    dealt = groups.join(sizes, "component").select("cid", F.col("component").alias("block"), F.explode(meetings(slices(F.col("size"), block))).alias("block2"))
    return written(confirm_blocks(dealt.join(members.select("cid", "text"), "cid").select("block", "block2", "cid", "text"), k, similar), "across")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


ORACLE = """
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')] else [array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)] end) as g from w),
c as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as n_both from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select a, b from p join c x on a = x.doc_id join c y on b = y.doc_id where 100 * n_both >= 80 * (x.n + y.n - n_both)),
e as (select a, b from l union all select b, a from l),
r(a, b) as (select a, b from e union select r.a, e.b from r join e on r.b = e.a),
m as (select a, least(a, min(b)) as component_id from r group by a)
select w.doc_id, coalesce(c.n, 0)::bigint as n_shingles, coalesce(m.component_id, w.doc_id) as component_id, coalesce(m.component_id, w.doc_id) = w.doc_id as kept
from w left join c using (doc_id) left join m on m.a = w.doc_id
"""

QUERIES = {"op10_minhash": op10_minhash}
ORACLES = {"op10_minhash": ORACLE}
