"""LM scoring by cross-entropy difference.

Two matched bigram models, one of trusted target documents and one of the whole corpus as background, share one vocabulary
(all words of the corpus) and their smoothing. A token's loss under a model is ``-ln p``, with
``p(b | a) = (n(a b) + BACKOFF * p(b)) / (n(a) + BACKOFF)`` and ``p(b) = (n(b) + 1) / (N + words of the vocabulary + 1)``.
A document's score is the mean over its tokens of the target's loss minus the background's: the lower, the more it is like the
target. The target is every document labelled good.

The texts are written once with a mark on those of the target. Counts are of all documents and all words and pairs, by 64-bit hashes; nothing is capped.

1. ``grams``: the counts of all words, as a table that grows with the corpus, and those of pairs that make up at least
   1/(2 HOT) of a stretch of text. A pair above 1/HOT of the corpus is counted by at least half that way, so it is found.
2. Words and pairs above 1/(2 HOT) of the corpus, 2 HOT of each at most, are frequent: their counts (of pairs exact ones, by one
   more pass) are broadcast, and their losses are added where the text is read. So no frequent key meets in one task.
3. The rest goes through one shuffle: an entry for each token, keyed by its word, or by the pair if that word is frequent. Keys
   are dealt into slots of about GATHER entries, as many as the corpus needs, and what a stretch of text has for a slot travels
   packed in one row. A task holds one slot at a time, and of one key at most 1/HOT of the corpus; it counts words, contexts and
   pairs there. The losses go back packed by slots of documents, where they are summed. This is done in PASSES parts of the
   slots one after the other, so that the shuffle files of one part only lie on disk.

Defined cases: null and blank texts have no tokens and null losses and score; without target documents both models are
the same and scores are 0; repeated rows count and are scored each; a null id is no target; an empty table gives none. Only the
id and text columns are read. A-Z are lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import LOWER, Prefix, batches_of, chunks, drop, mix, read, release, text_bytes, tokens, with_row_ids, written

BACKOFF, CHUNK, HOT, PASSES, GATHER = 20.0, 4 << 20, 1 << 16, 3, 1 << 19
#: Documents of a slot, entries of a batch that is packed, and of those that are held to be summed.
DOCUMENTS, PACK, HELD = 20_000, 1 << 20, 1 << 21
START = np.uint64(0xBB67AE8584CAA73B)
#: Bits of an entry: it ends its text, is of the target, ends in a frequent word.
LAST, OWN, FREQUENT = 1, 2, 4


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = LOWER[data]
    begin, end, first = tokens(data, starts)
    return (Prefix(data).of(begin, end) if len(begin) else np.zeros(0, np.uint64)), first


def parts(batches: Iterator[pa.RecordBatch]):
    """Of batches (rid, text, own): rids, own, and the word hashes of about CHUNK bytes of text with the first word of each."""
    for batch in batches:
        data, starts = text_bytes(batch.column(1))
        rid, own = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
        for i, j in chunks(starts, CHUNK):
            h, first = word_hashes(data[starts[i] : starts[j]], starts[i : j + 1] - starts[i])
            yield rid[i:j], own[i:j], h, first


def pairs_of(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token the word before it (START at the start of a text), the key of both, and whether it is its text's last."""
    before = np.concatenate(([START], h[:-1]))[: len(h)]
    full = first[:-1] < first[1:]
    before[first[:-1][full]] = START
    last = np.zeros(len(h), bool)
    last[first[1:][full] - 1] = True
    return before, mix(mix(before) + h), last


class Places:
    """Places of hashes in sorted keys, found from their first bits."""

    def __init__(self, keys: np.ndarray):
        bits = len(keys).bit_length() + 1
        self.n, self.shift = len(keys), np.uint64(64 - bits)
        self.keys = np.append(keys, np.uint64(2**64 - 1))
        self.first = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift)

    def of(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash, -1 where it is no key."""
        at = self.first[h >> self.shift]
        left = np.flatnonzero(self.keys[at] < h)
        while len(left):
            at[left] += 1
            left = left[self.keys[at[left]] < h[left]]
        return np.where((self.keys[at] == h) & (at < self.n), at, -1)


def runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted values where each different one begins, and how often it occurs."""
    begin = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))[: len(ordered)]
    return begin, np.diff(np.append(begin, len(ordered)))


def summed(h: np.ndarray, *weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct values, how often each occurs, and the sums of the weights of each."""
    order = np.argsort(h)
    ordered = h[order]
    begin, n = runs(ordered)
    return ordered[begin], n, *(np.add.reduceat(w[order], begin) if len(h) else w for w in weights)


def packed(slot: np.ndarray, columns: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """For each slot (below 2**31) a row with the slot and, of each column, the entries of that slot as bytes."""
    for i in range(0, len(slot), PACK):
        low = slot[i : i + PACK].min()
        some = slot[i : i + PACK] - low
        order = np.argsort(some.astype(np.uint16) if some.max() < 1 << 16 else some, kind="stable")
        begin, n = runs(some[order])
        ends = np.append(begin, len(order))
        data = [pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((ends * c.itemsize).astype(np.int32)), pa.py_buffer(c[i : i + PACK][order])]) for c in columns.values()]
        yield pa.RecordBatch.from_arrays([pa.array((some[order][begin] + low).astype(np.int32)), *data], ["slot", *columns])


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Of rows in order of their slots, each run of a batch: the slot and its columns' bytes."""
    for batch in batches:
        slot = batch.column(0).to_numpy(zero_copy_only=False)
        columns = [text_bytes_of(batch.column(c)) for c in range(1, batch.num_columns)]
        for i, n in zip(*runs(slot), strict=True):
            yield int(slot[i]), [data[at[i] : at[i + n]] for data, at in columns]


def text_bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls, and where each value begins (and the last ends)."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def grams(docs: DataFrame) -> DataFrame:
    """kind, h, n, t, e, et: of words (kind 0) the count, the target's, and both as last word of a text; of frequent pairs
    (kind 1) the count in stretches of text where they are."""
    rare = 2 * HOT

    def counted(held):
        h, k, mine, last = (np.concatenate(c) for c in zip(*held, strict=True))
        words = summed(h, *(w.astype(np.int64) for w in (mine, last, mine & last)))
        k = np.sort(k)
        begin, n = runs(k)
        some = n * rare >= len(k)
        none = np.zeros(int(some.sum()), np.int64)
        columns = [np.repeat([0, 1], [len(words[0]), len(none)]).astype(np.int32), np.concatenate((words[0], k[begin[some]])).view(np.int64), np.concatenate((words[1], n[some])), *(np.concatenate((w, none)) for w in words[2:])]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["kind", "h", "n", "t", "e", "et"])

    def run(batches):
        held, size = [], 0
        for _, own, h, first in parts(batches):
            _, k, last = pairs_of(h, first)
            held.append((h, k, np.repeat(own, np.diff(first)), last))
            size += len(h)
            if size >= PACK:
                yield counted(held)
                held, size = [], 0
        if size:
            yield counted(held)

    each = docs.mapInArrow(run, "kind int, h long, n long, t long, e long, et long")
    return each.groupBy("kind", "h").agg(*(F.sum(c).alias(c) for c in ("n", "t", "e", "et")))


@dataclass
class Model:
    """Totals of the corpus and of the target, and of frequent words and pairs, by sorted hash, what their tokens add to the losses."""

    size: float
    total: tuple[float, float]
    texts: tuple[float, float]
    words: np.ndarray
    counts: tuple[np.ndarray, np.ndarray]
    contexts: tuple[np.ndarray, np.ndarray]
    pairs: np.ndarray
    losses: tuple[np.ndarray, np.ndarray]

    def share(self, side: int, n):
        """BACKOFF * p(b) of words with n tokens."""
        return BACKOFF * (n + 1.0) / (self.total[side] + self.size)


def frequent(docs: DataFrame, table: DataFrame) -> Model:
    word = F.col("kind") == 0
    sums = table.where(word).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "t", "e", "et")), F.count(F.lit(1)).alias("words")).first()
    least = sums["n"] // (2 * HOT)
    top = table.where(F.col("n") > least).toArrow()  # 2 HOT words and as many pairs at most
    kind, h = top.column("kind").to_numpy(), top.column("h").to_numpy().view(np.uint64)
    order = np.flatnonzero(kind == 0)[np.argsort(h[kind == 0])]
    n, t, e, et = (top.column(c).to_numpy()[order].astype(float) for c in ("n", "t", "e", "et"))
    sides = (t, n) if sums["t"] else (n, n)
    ends = (et, e) if sums["t"] else (e, e)
    model = Model(float(sums["words"] + 1), tuple(float(sums[c if sums["t"] else "n"]) for c in ("t", "n")), tuple(float(sums[c if sums["t"] else "e"]) for c in ("et", "e")), h[order], sides, tuple(np.log(x - y + BACKOFF) for x, y in zip(sides, ends, strict=True)), np.sort(h[kind == 1]), ())
    words, pairs = model.words, model.pairs

    def run(batches):
        word, pair = Places(words), Places(pairs)
        w, n, t = (np.zeros(len(pairs), np.int64) for _ in range(3))
        for _, own, h, first in parts(batches):
            _, k, _ = pairs_of(h, first)
            q = pair.of(k)
            some = np.flatnonzero(q >= 0)
            q = q[some]
            w[q] = word.of(h[some])
            n += np.bincount(q, minlength=len(n))
            t += np.bincount(q[np.repeat(own, np.diff(first))[some]], minlength=len(n))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (some, w[some], n[some], t[some])], ["q", "w", "n", "t"])

    exact = docs.mapInArrow(run, "q long, w long, n long, t long").groupBy("q").agg(F.max("w").alias("w"), F.sum("n").alias("n"), F.sum("t").alias("t")).toArrow() if len(pairs) else None
    if exact is None:
        model.losses = (np.zeros(0), np.zeros(0))
        return model
    order = np.argsort(exact.column("q").to_numpy())
    w, n, t = (exact.column(c).to_numpy()[order] for c in ("w", "n", "t"))
    model.losses = tuple(-np.log(x + model.share(s, model.counts[s][w])) for s, x in enumerate((t if sums["t"] else n, n)))
    return model


@dataclass
class Slots:
    """How many slots the keys of one part are dealt into, and how many the documents."""

    keys: int
    documents: int

    def of_documents(self, rid: np.ndarray) -> np.ndarray:
        return (mix(rid.view(np.uint64)) % np.uint64(self.documents)).astype(np.int64)


def rare_rows(docs: DataFrame, shared, slots: Slots, part: int) -> DataFrame:
    """slot, and packed g (key), a (the word before; if the key is a pair, the place of its frequent word), rid and x (LAST, OWN,
    FREQUENT): the tokens of pairs that are not frequent and lie in this part. In the first part also, in slots beyond those of the
    keys, what the frequent ones add to both losses (g and a) of each document, and its tokens (x)."""
    every, low = PASSES * slots.keys, part * slots.keys

    def run(batches):
        model = shared.value
        word, pair = Places(model.words), Places(model.pairs)
        for rid, own, h, first in parts(batches):
            n = np.diff(first)
            doc = np.repeat(np.arange(len(rid)), n)
            a, k, last = pairs_of(h, first)
            w = word.of(h)
            hot = w >= 0
            q = np.full(len(h), -1)
            q[hot] = pair.of(k[hot])  # a frequent pair ends in a frequent word
            if part == 0 and len(h):
                losses = []
                for side in (0, 1):
                    loss = np.zeros(len(h))
                    loss[q >= 0] = model.losses[side][q[q >= 0]]
                    inner = hot & ~last
                    loss[inner] += model.contexts[side][w[inner]]
                    total = np.bincount(doc, weights=loss, minlength=len(rid)) + np.log(model.texts[side] + BACKOFF)
                    losses.append(total[n > 0])
                some = rid[n > 0]
                yield from packed(every + slots.of_documents(some), {"g": losses[0], "a": losses[1], "rid": some, "x": n[n > 0].astype(np.int64)})
            g = np.where(hot, k, h)
            slot = ((g >> np.uint64(32)) * np.uint64(every) >> np.uint64(32)).astype(np.int64)
            some = np.flatnonzero((q < 0) & (slot >= low) & (slot < low + slots.keys))
            x = last[some] * np.uint8(LAST) + own[doc[some]] * np.uint8(OWN) + hot[some] * np.uint8(FREQUENT)
            before = np.where(hot[some], w[some].astype(np.uint64), a[some])
            yield from packed(slot[some], {"g": g[some], "a": before, "rid": rid[doc[some]], "x": x})

    return docs.mapInArrow(run, "slot int, g binary, a binary, rid binary, x binary")


def row_losses(model: Model, g: np.ndarray, a: np.ndarray, rid: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, ...]:
    """rid and what each entry adds to both losses; all entries of a key are here."""
    order = np.argsort(g)
    g, a, rid, x = g[order], a[order], rid[order], x[order]
    begin, n = runs(g)
    hot = (x & FREQUENT) > 0
    pair = np.where(hot, g, mix(mix(a) + g))
    by_pair = np.argsort(pair)
    first, m = runs(pair[by_pair])
    target = model.total[0] != model.total[1]
    own, inner = (x & OWN) > 0, (x & LAST) == 0
    word = np.where(hot[begin], a[begin], np.uint64(0)).astype(np.int64)
    out = []
    for side in (0, 1):
        mine = side == 0 and target
        both = np.empty(len(g))
        both[by_pair] = np.repeat(np.add.reduceat(own[by_pair].astype(np.int64), first) if mine else m, m)
        words = np.add.reduceat(own.astype(np.int64), begin) if mine else n
        if hot.any():
            words = np.where(hot[begin], model.counts[side][word], words)
        contexts = np.log(np.add.reduceat((inner & own if mine else inner).astype(np.int64), begin) + BACKOFF)
        out.append(np.where(inner & ~hot, np.repeat(contexts, n), 0.0) - np.log(both + np.repeat(model.share(side, words), n)))
    return rid, *out


def losses(rows: DataFrame, shared, slots: Slots) -> DataFrame:
    """slot (of documents), and packed rid, n (tokens of the text, once), t and b: what the entries of rare_rows add to the losses."""
    every, schema = PASSES * slots.keys, "slot int, rid binary, n binary, t binary, b binary"

    def run(batches):
        model, at, held, done, size = shared.value, -1, [], [], 0

        def given(done):
            rid, _, t, b = summed(*(np.concatenate(c) for c in zip(*done, strict=True)))
            yield from packed(slots.of_documents(rid), {"rid": rid, "n": np.zeros(len(rid), np.int64), "t": t, "b": b})

        def key_losses(held):
            return row_losses(model, *(np.concatenate(c).view(kind) for c, kind in zip(zip(*held, strict=True), (np.uint64, np.uint64, np.int64, np.uint8), strict=True)))

        for slot, columns in unpacked(batches):
            if slot >= every:
                t, b, rid, n = columns
                ends = [np.array([0, len(c)], np.int32) for c in (rid, n, t, b)]
                yield pa.RecordBatch.from_arrays([pa.array([slot - every], pa.int32()), *(pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(e), pa.py_buffer(np.ascontiguousarray(c))]) for c, e in zip((rid, n, t, b), ends, strict=True))], ["slot", "rid", "n", "t", "b"])
                continue
            if slot != at and held:
                done.append(key_losses(held))
                size += len(done[-1][0])
                held = []
                if size >= HELD:
                    yield from given(done)
                    done, size = [], 0
            at = slot
            held.append(columns)
        if held:
            done.append(key_losses(held))
        if done:
            yield from given(done)

    return rows.repartition("slot").sortWithinPartitions("slot").mapInArrow(run, schema)


def added(rows: DataFrame) -> DataFrame:
    """rid, n, loss_t, loss_n: of each document the sums of losses()."""

    def run(batches):
        at, held, size = -1, [], 0

        def total(held):
            rid, _, *sums = summed(*(np.concatenate(c) for c in zip(*held, strict=True)))
            return rid, *sums

        for slot, columns in unpacked(batches):
            if held and (slot != at or size >= HELD):
                held = [total(held)]
                size = 0
                if slot != at:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[0]], ["rid", "n", "loss_t", "loss_n"])
                    held = []
            at = slot
            held.append(tuple(np.ascontiguousarray(c).view(kind) for c, kind in zip(columns, (np.int64, np.int64, np.float64, np.float64), strict=True)))
            size += len(held[-1][0])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in total(held)], ["rid", "n", "loss_t", "loss_n"])

    return rows.repartition("slot").sortWithinPartitions("slot").mapInArrow(run, "rid long, n long, loss_t double, loss_n double")


def score_documents(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    """doc_id, n_tokens, loss_target, loss_background, score for each row of docs (doc_id, text). target_ids: one column."""
    spark = docs.sparkSession
    batches_of(spark)
    docs = with_row_ids(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    good = target_ids.select(F.col(target_ids.columns[0]).cast("long").alias("_id"), F.lit(False).alias("_none"), F.lit(True).alias("own")).where("_id is not null").distinct()
    # the labels may be too many to send to every task: their join moves the texts, at any size, so it is done once and kept
    spread = docs.select("rid", "text", F.coalesce("doc_id", "rid").alias("_id"), F.col("doc_id").isNull().alias("_none"))
    marked = written(spread.join(good.hint("merge"), ["_id", "_none"], "left").select("rid", "text", F.col("own").isNotNull().alias("own")), "marked", "zstd")
    release(spark)
    table = written(grams(marked), "grams")
    model = frequent(marked, table)
    slots = Slots(int(model.total[1]) // (PASSES * GATHER) + 1, int(model.texts[1]) // DOCUMENTS + 1)
    shared = spark.sparkContext.broadcast(model)
    release(spark)
    drop(table)
    sums = None
    for part in range(PASSES):
        some = written(added(losses(rare_rows(marked, shared, slots, part), shared, slots)), "losses")
        release(spark)
        sums = some if sums is None else sums.unionByName(some)
    drop(marked)
    sums = sums.groupBy("rid").agg(*(F.sum(c).alias(c) for c in ("n", "loss_t", "loss_n"))).where("n > 0")
    out = docs.select("rid", "doc_id").join(sums, "rid", "left")
    target, background = F.col("loss_t") / F.col("n"), F.col("loss_n") / F.col("n")
    return out.select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_tokens"), target.alias("loss_target"), background.alias("loss_background"), (target - background).alias("score"))


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = read(spark, sf_dir, "labels").where((F.col("quality") == 1) & F.col("doc_id").isNotNull())
    return score_documents(read(spark, sf_dir, "documents"), good.select("doc_id"))


QUERIES = {"op1_lm_scoring": op1_lm_scoring}
