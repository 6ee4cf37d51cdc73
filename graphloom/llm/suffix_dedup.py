"""Suffix-array dedup: removes each byte covered by a LENGTH-byte string that starts anywhere else in the corpus too.

Every window of LENGTH bytes has an anchor: the leftmost of its SEED-byte substrings with the smallest hash. Equal windows
have equal anchors at equal offsets, so only suffixes that start at anchors are indexed (a sparse suffix array), and each
anchor answers for the run of windows that chose it.

1. ``anchors`` gives for each anchor a hash of its seed, and a hash of the text around it that its windows span. Seeds that
   occur once are dropped. Spans that occur twice are duplicates as a whole, which settles groups of copies with no text moved.
2. Of seeds with several different spans, one text per span goes to the task of the seed's bucket. There a logarithmic
   family of suffix arrays (``Family``) takes the spans in batches: a batch is sorted by its suffixes from the anchor on
   and by its reversed prefixes, is merge-scanned against every existing level for long matches, and becomes a level;
   levels of equal size merge, so their sizes grow geometrically.
   A window with ``a`` bytes before the anchor is a duplicate if another span agrees in the suffix order to LENGTH - a bytes
   and in the prefix order to a bytes; both are read from the common-prefix lengths of neighbours.
   A seed with more than HOT different spans is split first: its windows by the bytes ``a`` before the anchor, in two halves.
   All windows of a half hold the same longer stretch around the anchor, which is the half's seed; what is left of the spans is
   treated like spans of that seed, and split again while it is hot. A half of one window has nothing but copies.
3. Each span's duplicate windows go back to all its anchors, and each document's bytes are cut.

``word_runs`` does the same for runs of words, whatever white space is between them: anchors are chosen among runs of WORD_SEED
words, and of the spans of repeated seeds all windows are compared by hash. ``cut_duplicates`` cuts these runs too when ``words``
is given (the pipeline), or counts their words only (op5, whose cuts are about bytes: a run of over 50 words may be shorter than
LENGTH bytes).

Defined cases: a null text is an empty text; texts shorter than LENGTH bytes keep all their bytes; matches never cross
documents, but may lie, also overlapping, within one; rows that share an id or have none are documents of their own; an empty
table gives none. Only the id and text columns are read. A text of any length is worked through in pieces of PIECE windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import Prefix, batches_of, chunks, drop, mix, powers, read, release, text_bytes, tokens, with_row_ids, written

LENGTH, SEED, PIECE, BATCH, BUCKET_BYTES, HOT = 400, 100, 1 << 20, 4096, 8 << 20, 8192
WORD_SEED, SALTS = 13, 16

#: A repeated run of so many words is a passage.
PASSAGE = 51


class Sums(Prefix):
    """Hashes of any runs of numbers."""

    def __init__(self, values: np.ndarray):
        self.pow, self.inv = powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(mix(values) * self.pow[: len(values)], out=self.sums[1:])


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w successive values, from running minima forwards and backwards in blocks of w."""
    n = len(v) - w + 1
    padded = np.full(-(-len(v) // w) * w, np.iinfo(v.dtype).max, v.dtype)
    padded[: len(v)] = v
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def anchors_in(data: np.ndarray, starts: np.ndarray, length: int, seed: int, kind: type[Prefix] = Prefix) -> tuple[np.ndarray, ...]:
    """For texts one behind the other: text number, first window, windows, offset of the anchor in the first, seed hash, span hash."""
    n = len(data) - length + 1
    if n <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    prefix = kind(data)
    h = (prefix.sums[seed:] - prefix.sums[:-seed]) * prefix.inv[: len(data) - seed + 1]
    low = np.uint64((1 << len(data).bit_length()) - 1)
    best = sliding_min((mix(h) & ~low) | np.arange(len(h), dtype=np.uint64), length - seed + 1)
    place = (best & low).astype(np.int64)
    step = np.zeros(n + 1, np.int64)
    sizes = np.diff(starts)
    long_enough = np.flatnonzero(sizes >= length)
    np.add.at(step, starts[long_enough], 1)
    np.add.at(step, starts[long_enough] + sizes[long_enough] - length + 1, -1)
    fine = np.cumsum(step[:-1]) > 0
    edge = np.ones(n, bool)
    edge[1:] = place[1:] != place[:-1]
    edge[starts[long_enough]] = True
    first = np.flatnonzero(edge & fine)
    stop = np.concatenate((np.flatnonzero((edge | ~fine)[1:]) + 1, [n]))
    last = stop[np.searchsorted(stop, first, "right")] - 1
    place = place[first]
    own = np.searchsorted(starts, first, "right") - 1
    offset = place - first
    a = mix(prefix.raw(place, place + seed) ^ np.uint64(0x5BD1E9955BD1E995))
    t = mix(prefix.of(first, last + length) + offset.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return own, first - starts[own], last - first + 1, offset, a.view(np.int64), t.view(np.int64)


def pieces(data: np.ndarray, starts: np.ndarray, i: int, j: int, length: int):
    """Of texts i to j: first text, place of the piece in it, and the data and starts of the piece."""
    if starts[j] - starts[i] <= PIECE + length:
        yield i, 0, data[starts[i] : starts[j]], starts[i : j + 1] - starts[i]
        return
    for k in range(i, j):
        for s in range(0, int(starts[k + 1] - starts[k]) - length + 1, PIECE):  # one long text
            e = min(int(starts[k + 1]), int(starts[k]) + s + PIECE + length - 1)
            yield k, s, data[starts[k] + s : e], np.array([0, e - int(starts[k]) - s])


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts one behind the other, and the first word of each text (and the end)."""
    begin, end, first = tokens(data, starts)
    h, i = np.zeros(len(begin), np.uint64), 0
    while i < len(begin):
        j = max(i + 1, int(np.searchsorted(end, begin[i] + PIECE, "right")))
        h[i:j] = Prefix(data[begin[i] : end[j - 1]]).of(begin[i:j] - begin[i], end[i:j] - begin[i])
        i = j
    return h, first


def anchors(docs: DataFrame, length: int, seed: int, words: bool = False) -> DataFrame:
    """rid, s (first window), n (windows), o (offset of the anchor in the first window), a (seed hash), t (span hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, starts = text_bytes(batch.column(1))
            for i, j in chunks(starts):
                units, first = word_hashes(data[starts[i] : starts[j]], starts[i : j + 1] - starts[i]) if words else (data[starts[i] : starts[j]], starts[i : j + 1] - starts[i])
                for base, at, part, cut in pieces(units, first, 0, j - i, length):
                    own, s, n, o, a, t = anchors_in(part, cut, length, seed, Sums if words else Prefix)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i + base + own], pa.int64()), pa.array(s + at, pa.int64()), pa.array(n, pa.int32()), pa.array(o, pa.int32()), pa.array(a), pa.array(t)], ["rid", "s", "n", "o", "a", "t"])

    batches_of(docs.sparkSession)
    return docs.select("rid", "text").mapInArrow(run, "rid long, s long, n int, o int, a long, t long")


class Family:
    """A logarithmic family of sparse suffix arrays over spans; ``hit[k]`` tells which windows of span k are duplicates."""

    def __init__(self, length: int, seed: int):
        self.length, self.left = length, length - seed
        self.levels: list[dict] = []
        self.hit: list[np.ndarray] = []

    def add(self, seeds: np.ndarray, offsets: np.ndarray, spans: list[bytes]) -> None:
        first = len(self.hit)
        n = np.array([len(s) - self.length + 1 for s in spans])
        self.hit += [np.zeros(k, bool) for k in n]
        after, before = np.zeros((len(spans), self.length), np.uint8), np.zeros((len(spans), self.left), np.uint8)
        for k, (o, s) in enumerate(zip(offsets.tolist(), spans, strict=True)):
            b = np.frombuffer(s, np.uint8)
            x, y = b[o : o + self.length], b[max(0, o - self.left) : o][::-1]
            after[k, : len(x)], before[k, : len(y)] = x, y
        batch = self.sort({"seed": seeds, "o": offsets, "n": n, "k": np.arange(first, first + len(spans)), "after": after, "before": before})
        self.scan([batch])
        for level in self.levels:
            near = np.isin(level["seed"], batch["seed"])
            if near.any():
                self.scan([{f: v[near] for f, v in level.items()}, batch])
        while self.levels and len(self.levels[-1]["k"]) <= len(batch["k"]):
            batch = self.sort(self.joined([self.levels.pop(), batch]))
        self.levels.append(batch)

    @staticmethod
    def joined(parts: list[dict]) -> dict:
        return {f: np.concatenate([p[f] for p in parts]) for f in parts[0]}

    @staticmethod
    def order(seed: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Of suffixes by seed, then bytes; a stable sort merges the runs of sorted parts."""
        key = np.concatenate((seed.astype(">i8").view(np.uint8).reshape(-1, 8), text), axis=1)
        return np.argsort(np.ascontiguousarray(key).view(f"S{key.shape[1]}").ravel(), kind="stable")

    def sort(self, part: dict) -> dict:
        o = self.order(part["seed"], part["after"])
        return {f: v[o] for f, v in part.items()}

    @staticmethod
    def common(seed: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Length of the prefix that each row shares with the row before; -1 behind another seed."""
        out = np.full(len(seed), -1, np.int32)
        for c in range(1, len(seed), 8192):
            d = text[c : c + 8192] != text[c - 1 : c - 1 + len(text[c : c + 8192])]
            out[c : c + 8192] = np.where(d.any(axis=1), d.argmax(axis=1), text.shape[1])
        out[1:][seed[1:] != seed[:-1]] = -1
        return out

    def scan(self, parts: list[dict]) -> None:
        rows = self.sort(self.joined(parts)) if len(parts) > 1 else parts[0]
        ahead = self.common(rows["seed"], rows["after"])
        turned = self.order(rows["seed"], rows["before"])
        behind = self.common(rows["seed"][turned], rows["before"][turned])
        least, most = rows["o"] - rows["n"] + 1, rows["o"]
        back = np.empty(len(turned), np.int64)
        for a in range(int(least.min()), int(most.max()) + 1):
            live = np.flatnonzero((least <= a) & (a <= most))
            if len(live) < 2:
                continue
            back[turned] = np.cumsum(behind < a)
            key = np.cumsum(ahead < self.length - a)[live] * (len(turned) + 1) + back[live]
            o = np.argsort(key)
            same = key[o[1:]] == key[o[:-1]]
            twice = np.zeros(len(live), bool)
            twice[o[1:][same]] = True
            twice[o[:-1][same]] = True
            for x in live[twice]:
                self.hit[rows["k"][x]][rows["o"][x] - a] = True


def runs_of(hit: np.ndarray, length: int) -> list[tuple[int, int]]:
    """The byte ranges that the marked windows cover."""
    edge = np.diff(np.concatenate(([0], hit.view(np.int8), [0])))
    return [(int(b), int(e) - 1 + length) for b, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]


def matched_spans(spans: DataFrame, length: int, seed: int) -> DataFrame:
    """spans: bucket, a, t, o, span. Gives a, t, cover: the byte ranges of the span that are duplicates, if any."""

    def run(table: pa.Table) -> pa.Table:
        family = Family(length, seed)
        for c in range(0, table.num_rows, BATCH):
            part = table.slice(c, BATCH)
            family.add(part.column("a").to_numpy(), part.column("o").to_numpy().astype(np.int64), part.column("span").to_pylist())
        some = [k for k, h in enumerate(family.hit) if h.any()]
        cover = [[{"b": b, "e": e} for b, e in runs_of(family.hit[k], length)] for k in some]
        kept = table.select(["a", "t"]).take(pa.array(some, pa.int64()))
        return kept.append_column("cover", pa.array(cover, pa.list_(pa.struct([("b", pa.int32()), ("e", pa.int32())]))))

    return spans.groupBy("bucket").applyInArrow(run, "a long, t long, cover array<struct<b:int,e:int>>")


def short_hash(*parts: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b"".join(parts), digest_size=8).digest(), "little", signed=True)


def halves(spans: DataFrame, length: int) -> DataFrame:
    """spans: a, t, o, lo, hi, span; their windows have lo to hi bytes before the anchor. Gives the same of each half that has
    windows, with the seed and span it came from (a0, t0) and its begin in that span (at)."""
    names = ["a0", "t0", "at", "a", "t", "o", "lo", "hi", "span"]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a0, t0, o, lo, hi, span in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
                for l, h in ((lo, (lo + hi) // 2), ((lo + hi) // 2 + 1, hi)):
                    least, most = max(l, o - len(span) + length), min(h, o)
                    if least <= most:
                        part, core = span[o - most : o - least + length], span[o - l : o + length - h]
                        own = b"%d %d " % (l, h)
                        rows.append((a0, t0, o - most, short_hash(own, core), short_hash(b"%d " % most, part), most, l, h, part))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    return spans.select("a", "t", "o", "lo", "hi", "span").mapInArrow(run, "a0 long, t0 long, at int, a long, t long, o int, lo int, hi int, span binary")


def partial_covers(spans: DataFrame, facts: DataFrame, length: int, seed: int) -> DataFrame:
    """spans: a, t, o, lo, hi, span, one row for each different span of a seed; facts: the same rows, a and size in bytes.
    Gives a, t, cover: the byte ranges of the span that are duplicates; a span may have several rows."""
    spark = spans.sparkSession
    hot = facts.groupBy("a").agg(F.count(F.lit(1)).alias("kinds")).where(F.col("kinds") > HOT).select("a")
    some = bool(hot.limit(1).count())
    if some:
        hot = written(hot, "hot")
        facts = facts.join(hot, "a", "left_anti")
    buckets = max(1, -(-int(facts.agg(F.sum("size")).first()[0] or 0) // BUCKET_BYTES))
    cool = spans.join(hot, "a", "left_anti") if some else spans
    found = written(matched_spans(cool.select(F.pmod("a", F.lit(buckets)).alias("bucket"), "a", "t", "o", "span"), length, seed), "matches")
    release(spark)
    if not some:
        return found
    parts = written(halves(spans.join(hot, "a", "left_semi"), length), "halves")
    own = parts.groupBy("a", "t").agg(F.count(F.lit(1)).alias("times"), *(F.first(c).alias(c) for c in ("o", "lo", "hi", "span")))
    own = written(own, "spans")
    several = own.join(own.groupBy("a").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("a"), "a", "left_semi")
    inner = partial_covers(several, several.select("a", F.length("span").alias("size")), length, seed)
    whole = own.where("times > 1").select("a", "t", F.array(F.struct(F.lit(0).alias("b"), F.length("span").alias("e"))).alias("cover"))
    back = parts.select("a0", "t0", "at", "a", "t").join(whole.unionByName(inner), ["a", "t"])
    moved = F.transform("cover", lambda c: F.struct((c["b"] + F.col("at")).alias("b"), (c["e"] + F.col("at")).alias("e")))
    return found.unionByName(back.select(F.col("a0").alias("a"), F.col("t0").alias("t"), moved.alias("cover")))


def duplicate_ranges(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """rid and spans (array<struct<b, e>> of byte ranges, in any order, possibly overlapping) of each text with duplicates."""
    spark = docs.sparkSession
    every = written(anchors(docs, length, seed), "anchors")
    seeds = every.groupBy("a").agg(F.count(F.lit(1)).alias("all"), (F.min("t") < F.max("t")).alias("several")).where(F.col("all") > 1)
    seeds = written(seeds.select("a", "several"), "seeds")
    found = written(every.join(seeds.hint("merge"), "a"), "repeats")
    release(spark)
    drop(every)
    drop(seeds)
    variants = found.groupBy("a", "t").agg(F.count(F.lit(1)).alias("times"), F.min("rid").alias("rid"), F.min_by("s", "rid").alias("s"), *(F.first(c).alias(c) for c in ("n", "o", "several")))
    variants = written(variants, "variants")
    several = variants.where("several")
    cut = F.substring(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), (F.col("s") + 1).cast("int"), F.col("n") + length - 1)
    texts = several.hint("merge").join(docs.select("rid", "text"), "rid").select("a", "t", "o", F.lit(0).alias("lo"), F.lit(length - seed).alias("hi"), cut.alias("span"))
    partial = partial_covers(texts, several.select("a", (F.col("n") + length).alias("size")), length, seed)
    whole = F.array(F.struct(F.lit(0).alias("b"), (F.col("n") + length - 1).alias("e")))
    covered = variants.where("times > 1").select("a", "t", whole.alias("cover"))
    once = variants.where("times = 1").select("a", "t").join(partial, ["a", "t"])
    hits = found.join(covered.unionByName(once).hint("merge"), ["a", "t"]).select("rid", F.transform("cover", lambda c: F.struct((c["b"] + F.col("s")).alias("b"), (c["e"] + F.col("s")).alias("e"))).alias("cover"))
    out = written(hits.groupBy("rid").agg(F.flatten(F.collect_list("cover")).alias("spans")), "ranges")
    release(spark)
    for df in (found, variants):
        drop(df)
    return out


def repeated(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows (with column rid) whose keys occur more than once; a hot key is dealt to SALTS joins."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(SALTS)))
    some = salted.groupBy(*keys, "salt").agg(F.count(F.lit(1)).alias("times")).groupBy(*keys).agg(F.sum("times").alias("times"), F.collect_list("salt").alias("salts"))
    some = some.where("times > 1").select(*keys, F.explode("salts").alias("salt"))
    return salted.join(some.hint("merge"), [*keys, "salt"]).drop("salt")


def word_windows(spans: DataFrame, length: int) -> DataFrame:
    """spans: rid, text, parts (array of s, n, a). Gives rid, s, a, h: each window of the spans with its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = text_bytes(batch.column(1))
            at, begin, sizes, seeds = struct_lists(batch.column(2))
            for k, rid in enumerate(batch.column(0).to_pylist()):
                h, _ = word_hashes(data[starts[k] : starts[k + 1]], np.array([0, starts[k + 1] - starts[k]]))
                own = slice(at[k], at[k + 1])
                n = sizes[own].astype(np.int64)
                s = np.repeat(begin[own], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                sums = Sums(h)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), rid), pa.int64()), pa.array(s, pa.int64()), pa.array(np.repeat(seeds[own], n)), pa.array(sums.of(s, s + length).view(np.int64))], ["rid", "s", "a", "h"])

    return spans.select("rid", "text", "parts").mapInArrow(run, "rid long, s long, a long, h long")


def word_runs(docs: DataFrame, length: int, seed: int = WORD_SEED) -> DataFrame:
    """rid and runs (array<struct<b, e>> of ranges of words, in any order, possibly overlapping) of each text with runs of length
    words that start anywhere else too."""
    spark = docs.sparkSession
    every = written(anchors(docs, length, min(seed, length), words=True), "anchors")
    found = written(repeated(every, "a"), "repeats")
    release(spark)
    drop(every)
    whole = repeated(found, "a", "t").select("rid", "s", "n")
    first = F.min(F.struct("rid", "s", "n"))
    variants = written(found.groupBy("a", "t").agg(first.alias("v")).select("a", "t", "v.*"), "variants")
    several = repeated(variants, "a").groupBy("rid").agg(F.collect_list(F.struct("s", "n", "a")).alias("parts"))
    windows = written(word_windows(several.hint("merge").join(docs.select("rid", "text"), "rid"), length), "windows")
    # windows that follow each other are one run, so that a text's list has an entry for each run, not for each word
    nth = F.dense_rank().over(Window.partitionBy("rid").orderBy("s"))
    hits = repeated(windows, "a", "h").select("rid", "s", (F.col("s") - nth).alias("run")).groupBy("rid", "run").agg(F.min("s").alias("s"), (F.max("s") - F.min("s") + 1).alias("n")).drop("run")
    span = F.struct(F.col("s").alias("b"), (F.col("s") + F.col("n") + length - 1).alias("e"))
    out = written(whole.unionByName(hits).groupBy("rid").agg(F.collect_list(span).alias("runs")), "runs")
    release(spark)
    for df in (found, variants, windows):
        drop(df)
    return out


def struct_lists(column: pa.Array) -> tuple[np.ndarray, ...]:
    """Where each row's list begins (and the last ends), and the fields of all lists' structs; a null is an empty list."""
    at = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))))
    return at, *(f.to_numpy(zero_copy_only=False) for f in column.flatten().flatten())


def merged(b: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of what ranges cover together, in order."""
    o = np.argsort(b, kind="stable")
    b, e = b[o], np.maximum.accumulate(e[o])
    edge = np.flatnonzero(b[1:] > e[:-1])
    return b[np.concatenate((np.zeros(min(1, len(b)), np.int64), edge + 1))], e[np.concatenate((edge, np.full(min(1, len(b)), len(b) - 1)))]


def cut_duplicates(docs: DataFrame, length: int = LENGTH, seed: int = SEED, words: int | None = None, cut_words: bool = True) -> DataFrame:
    """All columns of docs, text replaced by what remains of it, with n_bytes, n_removed, n_spans, kept_sha256, n_run_words. The hash
    is that of the remaining bytes; in the text, characters of which some bytes went are dropped. With words, n_run_words is how many
    words lie in runs of so many words that start anywhere else too (else 0), and these runs are cut as well if cut_words."""
    own = ("rid", "spans", "runs", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_run_words")
    rows = with_row_ids(docs.drop(*own))
    both = rows.join(duplicate_ranges(rows, length, seed).hint("merge"), "rid", "left")
    both = (both.join(word_runs(rows, words).hint("merge"), "rid", "left") if words else both).drop("rid")
    names = [c for c in both.columns if c not in ("spans", "runs")]
    place = {c: both.columns.index(c) for c in both.columns}
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in both.select(*names).schema) + ", n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_run_words long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = text_bytes(batch.column(place["text"]))
            texts, facts = [], []
            at, span_b, span_e = struct_lists(batch.column(place["spans"]))
            run_at, run_b, run_e = struct_lists(batch.column(place["runs"])) if words else (np.zeros(batch.num_rows + 1, np.int64), *[np.zeros(0, np.int64)] * 2)
            for i in range(batch.num_rows):
                raw = data[starts[i] : starts[i + 1]].tobytes()
                b, e = span_b[at[i] : at[i + 1]], span_e[at[i] : at[i + 1]]
                first, last = merged(run_b[run_at[i] : run_at[i + 1]], run_e[run_at[i] : run_at[i + 1]])
                if len(first) and cut_words:
                    begin, end, _ = tokens(data[starts[i] : starts[i + 1]], np.array([0, len(raw)]))
                    b, e = np.concatenate((b, begin[first])), np.concatenate((e, end[last - 1]))
                n_run_words = int((last - first).sum())
                b, e = merged(b, e)
                n_spans, kept, last = len(b), [], 0
                for x, y in zip(b.tolist(), e.tolist(), strict=True):
                    kept.append(raw[last:x])
                    last = y
                rest = b"".join((*kept, raw[last:]))
                texts.append(rest.decode("utf-8", "ignore"))
                facts.append((len(raw), len(raw) - len(rest), n_spans, hashlib.sha256(rest).hexdigest(), n_run_words))
            columns = [pa.array(texts, pa.string()) if c == "text" else batch.column(place[c]) for c in names]
            more = [pa.array([f[k] for f in facts], pa.string() if k == 3 else pa.int64()) for k in range(5)]
            yield pa.RecordBatch.from_arrays([*columns, *more], [*names, "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_run_words"])

    return both.mapInArrow(run, schema)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = cut_duplicates(docs, words=PASSAGE, cut_words=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_run_words")


QUERIES = {"op5_suffix_dedup": op5_suffix_dedup}
