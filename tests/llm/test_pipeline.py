"""The stages of the pipeline, each judged on its own input."""

import re
import sys
from collections import Counter
from pathlib import Path

import corpus_pipeline as pipeline
import numpy as np

sys.path.insert(0, str(Path(__file__).parent))
from test_operators import WORD, brute_groups, brute_quality, many_labels  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        seen[name] = (docs.collect(), spark.read.parquet(str(tmp_path / name)).collect())
        docs = spark.read.parquet(str(tmp_path / name))
    before, after = seen["quality_rules"]
    assert set(after) <= set(before) and all(len(WORD.findall(r["text"])) >= 50 for r in after)
    before, after = seen["near_dedup"]
    groups = brute_groups([(r["doc_id"], r["text"]) for r in before], 5)
    assert {r["doc_id"] for r in after} == {i for i, (_, top) in groups.items() if i == top}
    before, after = seen["suffix_array_dedup"]
    order = sorted(before, key=lambda r: r["doc_id"])
    left, _ = brute_left(order)
    assert {r["doc_id"]: r["text"] for r in after} == left and all(r["n_chars"] == len(r["text"]) for r in after)
    before, after = seen["source_mixing"]
    times = Counter(r["doc_id"] for r in after)
    assert max(times.values()) <= 3 and set(times) <= {r["doc_id"] for r in before}
    before, after = seen["sentencepiece"]
    assert Counter(r["doc_id"] for r in before) == Counter(r["doc_id"] for r in after) and all(r["round_trip"] for r in after)


def test_run(spark):
    assert pipeline.run(spark, SF).columns == ["doc_id", "n_tokens", "ids", "round_trip"]


def test_quality_stage_fits_all_labels(spark, tmp_path):
    """The stage keeps what brute force over all of 30,000 labels keeps."""
    texts, labels = many_labels(spark)
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    folds = {r["doc_id"]: r["fold"] for r in labels.where("quality = 1").selectExpr("doc_id", "pmod(xxhash64(doc_id, 5), 4) as fold").collect()}
    want = {i for i, (_, kept) in brute_quality(texts, {i: folds[i] for i in texts if i in folds}).items() if kept}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in pipeline.quality_rules(spark, docs, str(tmp_path)).collect()} == want


def test_suffix_stage_cuts_passages_of_51_words(spark):
    """Runs of over 50 words that repeat, of less than 400 bytes, also with other white space between; 50 words stay."""
    rng = np.random.default_rng(7)
    words = lambda n: ["".join(map(chr, rng.integers(97, 123, rng.integers(2, 9)))) for _ in range(n)]
    passages = [words(n) for n in (51, 51, 60, 50)]
    texts = [" ".join([*words(20 + i), *passages[i % 4], *words(9)]) for i in range(8)]
    texts += [" ".join(words(5)) + " " + "\n".join(passages[1]), " ".join(passages[0][:30] + words(40)), " ".join(words(80))]
    ever = Counter(tuple(w[i : i + 51]) for t in texts for w in [t.split()] for i in range(len(w) - 50))
    want = {}
    for k, t in enumerate(texts):
        w = t.split()
        gone = {i + d for i in range(len(w) - 50) if ever[tuple(w[i : i + 51])] > 1 for d in range(51)}
        want[k] = [x for i, x in enumerate(w) if i not in gone]
    assert sum(len(w) < len(t.split()) for w, t in zip(want.values(), texts, strict=True)) == 7
    df = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"].split() for r in pipeline.suffix_array_dedup(spark, df, SF).collect()}
    assert got == want


def test_suffix_stage_on_documents(spark):
    """Exactly the bytes of repeated 400-byte strings and of repeated runs of 51 words go, with the white space in and between these."""
    df = spark.read.parquet(f"{SF}/documents.parquet").where("text is not null")
    want, by_words = brute_left(df.orderBy("doc_id").collect())
    assert by_words
    assert {r["doc_id"]: r["text"] for r in pipeline.suffix_array_dedup(spark, df, SF).collect()} == want


def brute_left(rows):
    """What is left of each text, without those that lose all, and how many lose bytes to runs of words only."""
    raw = [r["text"].encode() for r in rows]
    spans = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)] for b in raw]
    words = [[b[x:y] for x, y in at] for b, at in zip(raw, spans, strict=True)]
    ever = Counter(tuple(w[i : i + 51]) for w in words for i in range(len(w) - 50))
    strings = Counter(b[i : i + 400] for b in raw for i in range(len(b) - 399))
    want, by_words = {}, 0
    for r, b, at, w in zip(rows, raw, spans, words, strict=True):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 399):
            if strings[b[i : i + 400]] > 1:
                gone[i : i + 400] = True
        before = gone.sum()
        cut = {i + d for i in range(len(w) - 50) if ever[tuple(w[i : i + 51])] > 1 for d in range(51)}
        for i in cut:
            gone[at[i][0] : at[i + 1][0] if i + 1 in cut else at[i][1]] = True
        by_words += int(gone.sum() > before)
        left = np.frombuffer(b, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
        if left or not gone.any():
            want[r["doc_id"]] = left
    return want, by_words


ODD = [(1, None, "en", None, 0), (2, "", None, "a", 0), (3, " \n", "en", "a", 2), (4, "same words here " * 30, "en", "a", None), (4, "same words here " * 30, "en", "a", None), (None, "lost " * 70, "en", "b", 3), (5, "é word " * 2000, "fr", "b", 1)]


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, blanks, repeats, long texts, an empty table, and further columns with the names that the stages use."""
    odd = spark.createDataFrame([(*r, 1, "x", 2.0, "y") for r in ODD], "doc_id long, text string, lang string, source string, n_chars long, rid int, kept string, score double, copies string")
    for name, stage in pipeline.STAGES:
        last = stage is pipeline.STAGES[-1][1]
        for df in (odd, odd.limit(0)):
            got = stage(spark, df, SF)
            assert last or got.columns == list(pipeline.COLUMNS), name
            assert set(r["doc_id"] for r in got.collect()) <= {r[0] for r in ODD}, name
    assert pipeline.quality_rules(spark, odd, SF).where("text is null or n_chars = 0").count() == 0
    assert sorted(str(r["doc_id"]) for r in pipeline.near_dedup(spark, odd, SF).collect()) == sorted(str(r[0]) for r in ODD)
