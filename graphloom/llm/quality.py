"""Quality rules: fixed base rules, then a hashed n-gram log-likelihood ratio. DataFrame functions only.

Words and word pairs are hashed into BUCKETS. One multinomial over the buckets is counted over the whole raw corpus, the
other over all trusted documents (those labelled good). A text's score is the mean over its words and pairs of
``ln p_trusted - ln p_raw`` with add-one smoothing. Weights are rounded to a millionth and summed as integers, so a document
gets the same verdict in any order of rows. A document is kept from the threshold on: the score that the share QUANTILE of all
trusted documents with enough words stay below, less MARGIN. There each trusted document is scored by weights that have not
seen its own of FOLDS folds (by hash of the id), as those of the rest of the corpus have not seen it either.

Nothing is sampled or capped. The labels may be too many to send to every task: their join moves the texts, at any size, in PARTS
parts of the ids one after the other, so that the shuffle files of one part only lie on disk. The texts of trusted documents are
written once and read twice.

Defined cases: a null or blank text has no words, so it fails the base rules; without trusted documents
all scores are 0, and without ones outside the fold of another the base rules alone decide; repeated rows are judged (and
counted) one by one; a null id is no trusted id; an empty table gives none. Only the id and text columns are read.
"""

from __future__ import annotations

import functools
import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import drop, let, read, release, words, written

BUCKETS, SCALE = 1 << 14, 1_000_000
QUANTILE, MARGIN = 0.001, 0.03
FOLDS, PARTS, BINS = 4, 2, 1024
LEAST_WORDS, WINDOW = 50, 3
SYMBOLS = r"[#*$%&|<>]"
_LOW = (1 << 26) - 1


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds w (the words), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    t = F.coalesce(F.col(text), F.lit(""))
    full = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    out = docs.withColumns({"w": words(F.col(text)), "_lines": full})
    out = out.withColumn("_h", windows(F.col("w")))
    out = out.withColumns(
        {
            "n_words": F.size("w").cast("long"),
            "word_chars": F.length(F.array_join("w", "")).cast("long"),
            "n_symbols": (F.length(t) - F.length(F.regexp_replace(t, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.when(F.size(F.array_distinct("_h")) < F.size("_h"), repeated(F.col("_h"))).otherwise(F.lit(0)).cast("long"),
        }
    )
    # the id, never below 0, keeps filters above these projections: pushed below, they would repeat them many times over
    return out.drop("_h", "_lines").withColumn("base_failed", (F.monotonically_increasing_id() < 0) | (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def windows(w: Column) -> Column:
    """Hashes of the windows of WINDOW words."""
    own = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW))))
    return F.when(F.size(w) >= WINDOW, own).otherwise(F.array().cast("array<bigint>"))


def repeated(h: Column) -> Column:
    """How many words are covered by windows whose hash occurs twice or more. Hashes and places are sorted as one long, of 38 bits
    of the hash and 26 of the place; where hashes that differ agree in these bits, or places need more, as a struct."""
    high = F.lit(~_LOW)
    packed = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(high).bitwiseOR(i.cast("long"))))
    at = lambda x: x.bitwiseAND(F.lit(_LOW)).cast("int")
    alike = lambda x, y: x.bitwiseXOR(y).bitwiseAND(high) == 0
    near = lambda s, same: F.filter(s, lambda x, i: F.coalesce(F.when(i > 0, same(x, F.get(s, i - 1))), F.lit(False)) | F.coalesce(same(x, F.get(s, i + 1)), F.lit(False)))
    mixed = lambda s: F.size(F.filter(s, lambda x, i: F.coalesce(alike(x, F.get(s, i + 1)) & (F.get(h, at(x)) != F.get(h, at(F.get(s, i + 1)))), F.lit(False)))) > 0
    whole = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    slow = let(whole, lambda s: F.transform(near(s, lambda x, y: x["h"] == y["h"]), lambda x: x["i"]))
    twice = let(packed, lambda s: F.when(mixed(s), slow).otherwise(F.transform(near(s, alike), at)))
    places = F.sort_array(F.when(F.size(h) > _LOW, slow).otherwise(twice))
    gaps = lambda p: F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))))
    return let(places, lambda p: F.aggregate(gaps(p), F.lit(0), lambda a, x: a + x))


def buckets(rows: DataFrame, *keep: str) -> DataFrame:
    """Of rows with w: the kept columns and b, the hash bucket of each word and word pair. Words are rows with the word before, since
    functions over arrays of hashes are not compiled."""
    each = F.arrays_zip(F.col("w").alias("x"), F.concat(F.array(F.lit(None).cast("string")), F.col("w")).alias("p"))  # one more than words
    pairs = rows.select(*keep, F.explode(each).alias("z")).select(*keep, "z.x", "z.p").where("x is not null")
    bucket = lambda *c: F.pmod(F.xxhash64(*c), F.lit(BUCKETS)).cast("int")
    both = F.array(bucket("x"), F.when(F.col("p").isNotNull(), bucket("p", "x")))
    return pairs.select(*keep, F.explode(both).alias("b")).where("b is not null")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """_good: the ids of all documents labelled good; _fold: 1 to FOLDS."""
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_good")).distinct()
    return good.withColumn("_fold", (F.pmod(F.xxhash64("_good", F.lit(5)), F.lit(FOLDS)) + 1).cast("int"))


def trusted_texts(docs: DataFrame, labels: DataFrame) -> list[DataFrame]:
    """_fold and text of each row of docs with a trusted id, as tables of PARTS parts."""
    good, out = trusted_ids(labels), []
    for part in range(PARTS):
        mine = lambda c: F.pmod(F.xxhash64(F.col(c).cast("string"), F.lit(9)), F.lit(PARTS)) == part  # noqa: B023, E731
        some = docs.select("doc_id", "text").where(mine("doc_id")).join(good.where(mine("_good")).hint("merge"), F.col("doc_id") == F.col("_good"))
        out.append(written(some.select("_fold", "text"), "trusted", "zstd"))
        release(docs.sparkSession)
    return out


def fit(docs: DataFrame, trusted: DataFrame) -> tuple[list[int], dict[int, list[int]]]:
    """The weight of each bucket in millionths: BUCKETS numbers, whatever the size of the corpus. And for each fold those by the
    trusted texts of the other folds, where there are any."""
    each = lambda rows, *c: buckets(rows.select(*c, words(F.col("text")).alias("w")), *c).groupBy("b")
    raw, folds = [0] * BUCKETS, [[0] * BUCKETS for _ in range(FOLDS)]
    for r in each(docs).agg(F.count(F.lit(1)).alias("n")).collect():  # BUCKETS rows at most
        raw[r["b"]] = r["n"]
    for r in each(trusted, "_fold").agg(*(F.count_if(F.col("_fold") == k + 1).alias(f"n{k}") for k in range(FOLDS))).collect():  # as many
        for k in range(FOLDS):
            folds[k][r["b"]] = r[f"n{k}"]
    good = [sum(n) for n in zip(*folds, strict=True)]
    others = {k: [g - n for g, n in zip(good, own, strict=True)] for k, own in enumerate(folds, 1)}
    return weights_of(raw, good), {k: weights_of(raw, n) for k, n in others.items() if sum(n)}


def weights_of(raw: list[int], good: list[int]) -> list[int]:
    if not sum(good):
        return [0] * BUCKETS
    base = math.log((sum(raw) + BUCKETS) / (sum(good) + BUCKETS))
    return [round((math.log((g + 1) / (n + 1)) + base) * SCALE) for g, n in zip(good, raw, strict=True)]


def score(w: Column, table: Column) -> Column:
    """Mean log-likelihood ratio of a text's words and pairs; 0 without words. table: the weights."""
    look = lambda h: F.get(table, F.pmod(h, F.lit(BUCKETS)).cast("int"))
    each = F.transform(w, lambda x, i: look(F.xxhash64(x)) + F.when(i > 0, look(F.xxhash64(F.get(w, i - 1), x))).otherwise(F.lit(0)))
    total = F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.when(F.size(w) > 0, total / (2 * F.size(w) - 1) / SCALE).otherwise(F.lit(0.0))


def judge(docs: DataFrame, labels: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text and the extra columns of docs, with the columns of base_counts (but w), score, and kept."""
    parts = trusted_texts(docs, labels)
    trusted = functools.reduce(DataFrame.unionByName, parts)
    weights, others = fit(docs, trusted)
    bar = threshold(scored_trusted(trusted, others))
    for part in parts:
        drop(part)
    scored = base_counts(docs.select("doc_id", "text", *extra)).withColumn("score", score(F.col("w"), F.from_json(F.lit(json.dumps(weights)), "array<bigint>")))
    kept = ~F.col("base_failed") & (F.col("score") >= bar) & (F.monotonically_increasing_id() >= 0)
    return scored.drop("w").withColumn("kept", kept)


def scored_trusted(trusted: DataFrame, others: dict[int, list[int]]) -> DataFrame:
    """score of each trusted text, by the weights of the other folds; null with too few words (a filter would take the words apart twice)."""
    table = F.get(F.from_json(F.lit(json.dumps([others.get(k, []) for k in range(1, FOLDS + 1)])), "array<array<bigint>>"), F.col("_fold") - 1)
    held = trusted.where(F.col("_fold").isin(*others)).select("_fold", words(F.col("text")).alias("w"))
    return held.select(F.when(F.size("w") >= LEAST_WORDS, let(table, lambda t: score(F.col("w"), t))).alias("score"))


def threshold(trusted: DataFrame) -> float:
    """The quantile of all scores, between the two next to it in proportion, less MARGIN. No task holds more than BINS counts."""
    scores = written(trusted, "scores")
    n, lo, hi = scores.agg(F.count("score"), F.min("score"), F.max("score")).first()
    if not n:
        drop(scores)
        return float("-inf")
    place = QUANTILE * (n - 1)
    left = math.floor(place)
    while lo < hi:  # the bin that holds the place; the least and the greatest are never in one
        at = F.least(F.floor((F.col("score") - lo) / (hi - lo) * BINS), F.lit(BINS - 1))
        bins = scores.where(F.col("score").between(lo, hi)).groupBy(at.alias("at")).agg(F.count("score").alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi")).orderBy("at").collect()
        for r in bins:
            lo, hi = r["lo"], r["hi"]
            if left < r["n"]:
                break
            left -= r["n"]
    upto, above = scores.agg(F.count_if(F.col("score") <= lo), F.min(F.when(F.col("score") > lo, F.col("score")))).first()
    drop(scores)
    after = lo if upto > math.floor(place) + 1 or above is None else above
    return lo + (place - math.floor(place)) * (after - lo) - MARGIN


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


QUERIES = {"op3_quality_rules": op3_quality_rules}
