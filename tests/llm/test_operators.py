"""The operators against brute force, and on nulls, empty and repeated rows, empty tables and clashing column names."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from graphloom.llm import chat_format, license_scan, lm_scoring, minhash, mixing, quality, registry, sentencepiece_codec, simhash, suffix_dedup, url_filter
from graphloom.llm.common import with_row_ids

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TABLES = "documents pages conversations labels benchmark".split()
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "one two three four five six"), (5, "one two three four five six"), (6, "a▁b \U0001f600 é漢 " * 30), (None, "lost"), (7, "word " * 3000)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, blanks, repeats, a null id, long texts, and further columns named like those of the operators."""
    rows = [(i, t, "en", None if i == 4 else f"s{(i or 0) % 2}", 0, "x", 1, "y", 2.0) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rid string, kept int, spans string, score double")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", list(registry.oracles()))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    plain = lambda rows: sorted(tuple(f"{v:.9f}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    assert plain(df.select(*columns).collect()) == plain(con.execute(f"select {', '.join(columns)} from ({registry.oracles()[name]})").fetchall())


def base_facts(text):
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def signed_hash(words):
    h = 42
    for w in words:
        h = xxhash.xxh64_intdigest(w.encode(), h)
    return h - (1 << 64) if h >> 63 else h


def test_quality(spark, docs, odd):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r for r in quality.judge(docs, labels).collect()}
    good = {r["_good"] for r in quality.trusted_ids(labels).where("_fold > 0").collect()}
    raw, trusted = Counter(), Counter()
    grams = {i: [signed_hash(g) % quality.BUCKETS for w in [WORD.findall(t)] for g in [*((x,) for x in w), *zip(w, w[1:])]] for i, t in texts.items()}
    for i, g in grams.items():
        raw.update(g)
        if i in good:
            trusted.update(g)
    base = math.log((sum(raw.values()) + quality.BUCKETS) / (sum(trusted.values()) + quality.BUCKETS))
    weight = lambda b: round((math.log((trusted[b] + 1) / (raw[b] + 1)) + base) * 1e6)
    for i, t in texts.items():
        r = got[i]
        assert base_facts(t) == (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert r["score"] == pytest.approx(sum(map(weight, grams[i])) / max(1, len(grams[i])) / 1e6, abs=1e-9)
    edge = quality.judge(odd, labels.limit(0)).collect()
    assert sorted((r["n_words"], r["kept"]) for r in edge) == sorted((len(WORD.findall(t or "")), base_facts(t or "")[0] >= 50 and 2 * base_facts(t or "")[4] <= base_facts(t or "")[0]) for _, t in ODD)
    assert quality.judge(docs.limit(0), labels).count() == 0


@pytest.mark.parametrize("low", [(1 << 26) - 1, 3])
def test_quality_repeats_of_hashes_that_agree_in_part(spark, monkeypatch, low):
    """Windows whose hashes share all bits that are sorted, in turns; and places that need more bits than there are."""
    monkeypatch.setattr(quality, "_LOW", low)
    a, b, c = 5 << 40, (5 << 40) + 1, -(7 << 50)
    lists = [[a, b, a], [a, b, a, b], [a, b], [c, a, b, c, b, 9], [a] * 5, [], [1, 2, 3, 1, 2, 9, 9]]
    want = [len({i + k for i, x in enumerate(h) if h.count(x) > 1 for k in range(3)}) for h in lists]
    df = spark.createDataFrame(list(enumerate(lists)), "i int, h array<long>")
    assert [r["n"] for r in df.select("i", quality.repeated(F.col("h")).alias("n")).orderBy("i").collect()] == want


def many_labels(spark):
    """600 texts of 60 words in two manners, of ids among 30,000 labels that are good; and the labels."""
    rng = random.Random(11)
    manner = [[f"{c}{k}" for k in range(200)] for c in "ab"]
    texts = {i * 50: " ".join(rng.choice(manner[rng.random() < 0.1 + (i % 5 == 0) * 0.5]) for _ in range(60)) for i in range(600)}
    labels = spark.range(30_000).select(F.col("id").alias("doc_id"), (F.col("id") % 250 != 0).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    return texts, labels


def brute_quality(texts, folds):
    """Score and verdict of texts by all trusted ones (folds: by id), the threshold from each one by the other folds."""
    grams = {i: [signed_hash(g) % quality.BUCKETS for w in [WORD.findall(t)] for g in [*((x,) for x in w), *zip(w, w[1:])]] for i, t in texts.items()}
    raw = Counter(b for g in grams.values() for b in g)

    def scores(of, fit):
        good = Counter(b for i in fit for b in grams[i])
        base = math.log((sum(raw.values()) + quality.BUCKETS) / (sum(good.values()) + quality.BUCKETS))
        return {i: sum(round((math.log((good[b] + 1) / (raw[b] + 1)) + base) * 1e6) for b in grams[i]) / len(grams[i]) / 1e6 for i in of}

    held = [x for k in set(folds.values()) for x in scores([i for i in folds if folds[i] == k], [i for i in folds if folds[i] != k]).values()]
    bar = np.percentile(held, 100 * quality.QUANTILE) - quality.MARGIN
    out = scores(texts, folds)
    return {i: (pytest.approx(x, abs=1e-9), bool(x >= bar)) for i, x in out.items()}


def test_quality_fits_all_labels(spark):
    """Of 30,000 labels all count, in the weights and in the threshold."""
    texts, labels = many_labels(spark)
    folds = {r["_good"]: r["_fold"] for r in quality.trusted_ids(labels).collect()}
    assert len(folds) == 29_880
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["score"], r["kept"]) for r in quality.judge(docs, labels).collect()}
    want = brute_quality(texts, {i: folds[i] for i in texts if i in folds})
    assert got == want and 0 < sum(kept for _, kept in got.values()) < 600


@pytest.mark.parametrize("scores", [[0.5], [-1.0, 2.0], [3.0] * 50, [*np.random.default_rng(3).normal(size=5000)], [-5.0, -5.0, *np.random.default_rng(4).normal(size=1500)], [1e-300, 2e-300, 1.0, -0.0, 0.0]])
def test_quality_threshold(spark, monkeypatch, scores):
    for share in (quality.QUANTILE, 0.25, 1.0):
        monkeypatch.setattr(quality, "QUANTILE", share)
        monkeypatch.setattr(quality, "BINS", 8)
        got = quality.threshold(spark.createDataFrame([(float(x),) for x in scores], "score double"))
        assert got == pytest.approx(np.percentile(scores, 100 * share) - quality.MARGIN, abs=1e-12)


def test_quality_separates(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    fit = labels.where("doc_id % 2 = 0")
    held = quality.judge(docs, fit).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r["quality"]: r["kept"] for r in held}
    assert kept[1] > 0.98 and kept[0] < 0.3


def test_quality_takes_texts_apart_once(spark, docs):
    """The fit counts without functions over arrays, which are not compiled, and it and the threshold split each text once."""
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    some = docs.select((F.col("doc_id") % quality.FOLDS + 1).cast("int").alias("_fold"), "text")
    fit = quality.buckets(some.select("_fold", quality.words(F.col("text")).alias("w")), "_fold")
    assert plan(fit).count("split(") == 1 and "lambda" not in plan(fit)
    texts = {r["doc_id"]: WORD.findall(r["text"] or "") for r in docs.collect()}
    want = Counter((i % quality.FOLDS + 1, signed_hash(g) % quality.BUCKETS) for i, w in texts.items() for g in [*((x,) for x in w), *zip(w, w[1:])])
    assert {(r["_fold"], r["b"]): r["count"] for r in fit.groupBy("_fold", "b").count().collect()} == want
    scores = quality.scored_trusted(some, {1: [5] * quality.BUCKETS, 3: [7] * quality.BUCKETS})
    assert plan(scores).count("split(") == 1
    assert scores.count() == sum(i % 4 in (0, 2) for i in texts) and scores.where("score is not null").count() == sum(i % 4 in (0, 2) and len(w) >= quality.LEAST_WORDS for i, w in texts.items())


def brute_removed(texts, length):
    raw = [t.encode() for t in texts]
    n = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        m = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if n[b[i : i + length]] > 1:
                m[i : i + length] = True
        spans = int((m[1:] & ~m[:-1]).sum() + m[0])
        out.append((len(b), int(m.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~m[:-1]])).hexdigest()))
    return out


@pytest.mark.parametrize(("length", "seed", "batch"), [(400, 100, 4096), (40, 10, 7)])
def test_suffix_dedup(spark, docs, length, seed, batch, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BATCH", batch)
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    got = suffix_dedup.cut_duplicates(docs.select("doc_id", "text"), length, seed).orderBy("doc_id").collect()
    assert [tuple(r)[2:6] for r in got] == brute_removed([r["text"] for r in rows], length)


def test_suffix_dedup_query(spark, docs):
    """Bytes as in the contract, and the words in repeated runs of over 50 words."""
    got = suffix_dedup.op5_suffix_dedup(spark, SF).orderBy("doc_id").collect()
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    assert [tuple(r)[1:5] for r in got] == brute_removed(texts, 400)
    words = [WORD.findall(t) for t in texts]
    n = Counter(tuple(w[i : i + 51]) for w in words for i in range(len(w) - 50))
    runs = [len({i + k for i in range(len(w) - 50) if n[tuple(w[i : i + 51])] > 1 for k in range(51)}) for w in words]
    assert [r["n_run_words"] for r in got] == runs and any(runs)


def test_suffix_dedup_splits_hot_seeds(spark, monkeypatch):
    """Stretches that very many texts share in different surroundings, longer and shorter than the matches."""
    monkeypatch.setattr(suffix_dedup, "HOT", 3)
    rng = np.random.default_rng(4)
    letters = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    shared = [letters(n) for n in (30, 35, 39, 40, 44, 70)]
    texts = [letters(60) + shared[i % 6] + (letters(60) if i % 4 else letters(20) + shared[(i + 1) % 6] * 2) for i in range(60)]
    ends = [letters(n) for n in (3, 9, 15)]
    texts += [letters(50) + ends[i % 3] + shared[0] + ends[i // 3 % 3] + letters(50) for i in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = suffix_dedup.cut_duplicates(df, 40, 10).orderBy("doc_id").collect()
    assert [tuple(r)[2:6] for r in got] == brute_removed(texts, 40)


def test_suffix_dedup_family_and_pieces(monkeypatch):
    rng = np.random.default_rng(3)
    text = bytes(rng.integers(97, 100, 3000, dtype=np.uint8)) + b"ab" * 300
    data = np.frombuffer(text * 2, np.uint8)
    spans = list(zip(*suffix_dedup.anchors_in(data, np.array([0, len(data)]), 40, 10), strict=True))
    family = suffix_dedup.Family(40, 10)
    for c in range(0, len(spans), 5):
        part = spans[c : c + 5]
        family.add(np.array([p[4] for p in part]), np.array([p[3] for p in part]), [data[p[1] : p[1] + p[2] + 39].tobytes() for p in part])
    n = Counter(data[i : i + 40].tobytes() for i in range(len(data) - 39))
    for (_, s, many, *_), hit in zip(spans, family.hit, strict=True):
        assert [n[data[i : i + 40].tobytes()] > 1 for i in range(s, s + many)] == hit.tolist()
    sizes = [len(level["k"]) for level in family.levels]
    assert sizes == sorted(sizes, reverse=True) and sum(sizes) == len(spans)


def test_suffix_dedup_ranges():
    """Lists of ranges, also sliced and with nulls, and what ranges cover, against marks on a line."""
    lists = [None, [], [(3, 5)], [(1, 4), (4, 6), (9, 12)], None, [(7, 8), (0, 2)]]
    column = pa.array([None if v is None else [{"b": b, "e": e} for b, e in v] for v in lists], pa.list_(pa.struct([("b", pa.int64()), ("e", pa.int64())])))
    for cut in (0, 1, 3):
        at, b, e = suffix_dedup.struct_lists(column.slice(cut))
        got = [list(zip(b[x:y].tolist(), e[x:y].tolist(), strict=True)) for x, y in zip(at[:-1], at[1:], strict=True)]
        assert got == [v or [] for v in lists[cut:]]
    rng = np.random.default_rng(3)
    for n in [0, 1, 2, 5, 20] * 20:
        b = rng.integers(0, 60, n)
        e = b + rng.integers(1, 9, n)
        line = np.zeros(80, int)
        for x, y in zip(b, e, strict=True):
            line[x : y] = 1
        edge = np.diff(np.concatenate(([0], line, [0])))
        first, last = suffix_dedup.merged(b, e)
        assert first.tolist() == np.flatnonzero(edge == 1).tolist() and last.tolist() == np.flatnonzero(edge == -1).tolist()


def test_suffix_dedup_edges(spark, odd):
    got = suffix_dedup.cut_duplicates(odd).collect()
    want = brute_removed([t or "" for _, t in ODD], 400)
    assert Counter((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == Counter(want)
    assert suffix_dedup.cut_duplicates(odd.limit(0)).count() == 0


def test_simhash(spark, docs, odd):
    got = simhash.op6_document_fingerprints(spark, SF).orderBy("doc_id").collect()
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    assert len(got) == len(texts)
    for i, r in enumerate(got):
        half = len(texts[i]) // 2
        edited = texts[i][: len(texts[i]) - half] + texts[(i + 1) % len(texts)][:half]
        assert (r["n_chars"], r["edited_sha256"]) == (len(texts[i]), hashlib.sha256(edited.encode()).hexdigest())
    assert len({t: 1 for t in texts}) >= len({r["fingerprint"] for r in got})
    w = WORD.findall(texts[0])
    votes = np.zeros(128, int)
    terms = [signed_hash(w[i : i + 5]) for i in range(len(w) - 4)]
    for h in terms:
        second = xxhash.xxh64_intdigest(np.int64(h).tobytes(), 42)
        votes += [(((h, second)[b // 64] >> (63 - b % 64)) & 1) for b in range(128)]
    bits = "".join("1" if 2 * v > len(terms) else "0" for v in votes)
    assert f"{int(bits, 2):032x}" == got[0]["fingerprint"]
    assert simhash.fingerprints(odd.withColumn("k", F.monotonically_increasing_id()), ["k"]).count() == len(ODD)
    few = simhash.with_next(odd).where("_own").collect()
    assert len(few) == len(ODD)
    fps = spark.createDataFrame([("0" * 32,), ("0" * 31 + "7",), ("f" * 32,), ("0" * 15 + "1" + "0" * 15 + "3",)], "fingerprint string")
    pairs = {(r["query"], r["match"]) for r in simhash.within(fps, fps, 3).collect()}
    rows = [r[0] for r in fps.collect()]
    assert pairs == {(a, b) for a in rows for b in rows if bin(int(a, 16) ^ int(b, 16)).count("1") <= 3}
    values = {r["doc_id"]: int(r["fingerprint"], 16) for r in got}
    counts = {i: sum(bin(a ^ b).count("1") <= simhash.RADIUS for b in values.values()) - 1 if i % 20 == 0 else None for i, a in values.items()}
    assert {r["doc_id"]: r["n_within"] for r in got} == counts


@pytest.mark.parametrize("radius", range(5))
def test_simhash_search(spark, radius):
    rng = random.Random(radius)
    seeds = [rng.getrandbits(128) for _ in range(6)]
    values = [s ^ sum(1 << b for b in rng.sample(range(128), rng.randrange(7))) for s in seeds for _ in range(60)] + seeds * 20
    rows = [(i if i % 7 else None, f"{v:032x}", "x") for i, v in enumerate(values)]
    table = spark.createDataFrame(rows, "doc_id long, fingerprint string, n string")
    near = simhash.with_neighbours(table.withColumnRenamed("n", "query"), radius).collect()
    want = [(i, f"{v:032x}", sum(bin(v ^ o).count("1") <= radius for o in values) - 1 if i and i % 20 == 0 else None) for (i, _, _), v in zip(rows, values, strict=True)]
    assert sorted(((r["doc_id"], r["fingerprint"], r["n_within"]) for r in near), key=str) == sorted(want, key=str)
    pairs = [(r["query"], r["match"], r["distance"]) for r in simhash.within(table, table.select("fingerprint").distinct(), radius).collect()]
    distinct = set(values)
    assert sorted(pairs) == sorted((f"{a:032x}", f"{b:032x}", bin(a ^ b).count("1")) for a in distinct for b in distinct if bin(a ^ b).count("1") <= radius)


def test_simhash_search_refuses_wide_radii(spark):
    table = spark.createDataFrame([("0" * 32,)], "fingerprint string")
    for radius in (-1, 5):
        with pytest.raises(ValueError):
            simhash.within(table, table, radius)
    assert simhash.with_neighbours(table.withColumn("doc_id", F.lit(20)).limit(0)).count() == 0


def test_simhash_ranges(spark, docs, monkeypatch):
    monkeypatch.setattr(simhash, "ROWS_PER_RANGE", 20)
    whole = simhash.with_next(docs).where("_own").orderBy("doc_id").collect()
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    assert [r["next_text"] for r in whole] == texts[1:] + texts[:1]


def test_simhash_range_lookup(spark, monkeypatch):
    monkeypatch.setattr(simhash, "STRIDE", 3)
    for bounds in ([], [5], [2, 4, 6], [1, 2, 3, 5, 8, 13, 21]):
        rows = spark.createDataFrame([(i,) for i in (None, *range(-2, 25))], "doc_id long").withColumn("r", simhash.range_of(F.col("doc_id"), bounds)).collect()
        assert all(r["r"] == sum(b < r["doc_id"] for b in bounds if r["doc_id"] is not None) for r in rows)


def test_url_filter(spark):
    urls = ["http://a.example.com/en/1", "https://WWW.example.com/en/x?q", "http://b.net/es/", "http://b.net/en/", "ftp://x.org", "no url", "", None, "http://q.com?x/", "http://notexample.com/en/"]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit(1))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in url_filter.filter_urls(rows).collect()}
    assert got == {0: ("a.example.com", "/en/1", "example.com/en/"), 1: ("www.example.com", "/en/x", "www.example.com/en/"), 2: ("b.net", "/es/", "net/es/"), 3: ("b.net", "/en/", None), 4: ("x.org", "", None), 5: ("", "", None), 6: ("", "", None), 7: ("", "", None), 8: ("q.com", "", None), 9: ("notexample.com", "/en/", "com/")}
    assert url_filter.filter_urls(rows.limit(0)).count() == 0


def test_mixing_says_when_it_does_not_settle(spark, docs, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_LEVELS", 1)
    with pytest.raises(RuntimeError):
        mixing.mix(with_row_ids(docs), block=3)


def test_row_ids(spark, odd):
    rows = with_row_ids(odd).collect()
    assert len({r["rid"] for r in rows}) == len(ODD)
    assert [r["rid"] for r in with_row_ids(spark.createDataFrame([(4,), (9,)], "doc_id long")).collect()] == [4, 9]


def test_components_of_a_hot_node(spark):
    from graphloom.llm.components import components

    edges = [(0, i) for i in range(1, 400)] + [(i, 1000 - i) for i in range(1, 400)] + [(2000 + i, 2001 + i) for i in range(40)] + [(5000, 5000), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in (0, *range(1, 400), *range(601, 1000))}, **{2000 + i: 2000 for i in range(41)}}


def test_mixing(spark, docs, odd):
    assert mixing.targets({"a": 10, "b": 1000, None: 0}) == {"a": 30, "b": 980.0, None: 0}
    a, b = (sorted(tuple(r) for r in mixing.op8_source_mixing(spark, SF).collect()) for _ in range(2))
    assert a == b
    df = spark.createDataFrame(a, "doc_id long, size long, source_size long, target double, taken long, copies long").join(docs.select("doc_id", "source"), "doc_id")
    for r in df.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("most")).collect():
        assert abs(r["taken"] - r["target"]) <= max(r["most"], 0.1 * r["target"])
    assert all(0 <= r[4] <= 3 * r[1] for r in a)
    sizes = np.random.default_rng(1).integers(1, 500, 300).astype(float).tolist()
    p = mixing.flight(sizes, [0.3] * 300, np.random.default_rng(2).random)
    assert sum(p) == pytest.approx(90, abs=1e-6) and np.dot(p, sizes) == pytest.approx(0.3 * sum(sizes), abs=1e-3)
    assert sum(0 < x < 1 for x in p) <= 2
    small = mixing.mix(with_row_ids(odd.drop("rid")), block=2).collect()
    assert len(small) == len(ODD)
    assert mixing.mix(with_row_ids(odd.drop("rid").limit(0))).count() == 0


def test_sentencepiece(spark, docs, odd):
    p = sentencepiece_codec.load()
    texts = [r["text"] for r in docs.collect()] + [t or "" for _, t in ODD]
    ids, at = sentencepiece_codec.encode(p, texts)
    assert sentencepiece_codec.decode(p, ids, at) == texts
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    score = {sp.id_to_piece(i): (sp.get_score(i), i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    for t in ["of the retitioning", "Ouréaux qui", "a  b", "漢字 x"]:
        s = "▁" + t.replace(" ", "▁")
        best = [(0.0, [])]
        for j in range(1, len(s) + 1):
            ways = [(best[i][0] + score[s[i:j]][0], best[i][1] + [score[s[i:j]][1]]) for i in range(max(0, j - p.longest), j) if s[i:j] in score]
            if s[j - 1] not in score:
                ways.append((best[j - 1][0] + p.unknown, best[j - 1][1] + [int(p.byte_ids[b]) for b in s[j - 1].encode()]))
            best.append(max(ways, key=lambda w: w[0]))
        mine, _ = sentencepiece_codec.encode(p, [t])
        assert mine.tolist() == best[-1][1]
    got = sentencepiece_codec.encode_documents(odd).collect()
    assert len(got) == len(ODD) and all(r["round_trip"] for r in got)


def brute_groups(rows, k, similar=80):
    sets = {}
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    part = {i: i for i in sets}

    def top(i):
        while part[i] != i:
            i = part[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= similar * len(sets[a] | sets[b]):
                lo, hi = sorted((top(a), top(b)))
                part[hi] = lo
    return {i: (len(sets[i]), top(i)) for i in sets}


@pytest.mark.parametrize(("k", "block"), [(4, 512), (5, 3)])
def test_minhash(spark, k, block):
    rng = np.random.default_rng(5)
    rows = []
    for g in range(12):
        base = [f"w{x}" for x in rng.integers(0, 10_000, 120)]
        for _ in range(8):
            w = list(base)
            for x in rng.integers(0, 120, rng.integers(0, 6)):
                w[x] = f"e{rng.integers(0, 10**9)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(1000, None), (1001, ""), (1002, "Same Words"), (1003, "same words"), (1004, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("cid", F.lit(1)).withColumn("component", F.lit(2))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df, k=k, block=block).collect()}
    assert got == brute_groups(rows, k)


def test_minhash_keeps_chance_clusters_apart(spark):
    """Texts that share a third of their shingles meet in buckets by chance; only real links may tie them."""
    rng = np.random.default_rng(8)
    common, rows = [f"c{x}" for x in range(60)], []
    for _ in range(40):
        w = common + [f"u{x}" for x in rng.integers(0, 10**9, 60)]
        rows.append((len(rows), " ".join(w)))
        if len(rows) % 4 == 1:
            w[-1] = "other"
            rows.append((len(rows), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df, k=4, block=4).collect()}
    assert got == brute_groups(rows, 4)


def test_minhash_deals_long_texts_to_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "UNIT", 300)
    rng = np.random.default_rng(9)
    rows = []
    for g in range(6):
        base = [f"w{x}" for x in rng.integers(0, 10**6, 150 * (g + 1))]
        for _ in range(6):
            w = list(base)
            for x in rng.integers(0, len(w), rng.integers(0, 4 * (g + 1))):
                w[x] = f"e{rng.integers(0, 10**9)}"
            rows.append((len(rows), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df, k=4, block=8).collect()}
    assert got == brute_groups(rows, 4)


def test_minhash_of_rows_that_share_ids(spark):
    """Every row is compared by its own text; an id reaches what any of its rows reaches."""
    texts = [" ".join(f"{c}{i}" for i in range(40)) for c in "abc"]
    rows = [(5, texts[0]), (5, texts[1]), (6, texts[1] + " more"), (3, texts[0] + " end"), (9, texts[2]), (9, texts[2]), (10, texts[2]), (12, ""), (12, texts[0][:9]), (12, None), (None, texts[0]), (None, None)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4, block=3).collect()
    found = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got), key=str)
    want = [(5, 37, 3, False), (5, 37, 3, False), (6, 38, 3, False), (3, 38, 3, True), (9, 37, 9, True), (9, 37, 9, True), (10, 37, 9, False)]
    want += [(12, 0, 12, True), (12, 1, 12, True), (12, 0, 12, True), (None, 37, None, True), (None, 0, None, True)]
    assert found == sorted(want, key=str)


def test_minhash_edges(spark, odd):
    got = minhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD)
    assert minhash.near_duplicates(odd.limit(0)).count() == 0


def test_chat_format(spark):
    rows = [(1, 0, "user", "</turn>\n### assistant: \\l"), (1, 1, "assistant", "a: \\b # <"), (2, 0, None, None), (3, None, "assistant", ""), (3, None, "assistant", ""), (None, 1, "a: b", "x"), (4, 0, "user", "plain: # text"), (4, 1, "assistant", "é\U0001f600")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(0))
    made = chat_format.format_conversations(df)
    for r in made.withColumn("back", chat_format.parse(F.col("formatted"))).collect():
        assert r["back"] == r["turns"]
        assert sum(x["n"] for x in r["loss_runs"]) == len(r["formatted"])
        assert r["escaped"] == (r["conv_id"] in (1, None))
    assert chat_format.format_conversations(df.limit(0)).count() == 0
    cut = lambda runs: [r[0] for r in made.orderBy("conv_id").select(F.transform(chat_format.cut_by_mask(F.col("formatted"), runs), chat_format.unescape)).collect()]
    own = [[t["text"] for t in r["turns"] if t["role"] == "assistant"] for r in made.orderBy("conv_id").collect()]
    assert cut(F.col("loss_runs")) == own
    longer = F.transform("loss_runs", lambda r, i: F.struct(F.when(i == 0, r["n"] + 1).otherwise(r["n"]).alias("n"), r["loss"].alias("loss")))
    turned = F.transform("loss_runs", lambda r: F.struct(r["n"].alias("n"), (~r["loss"]).alias("loss")))
    assert cut(longer) == [None] * len(own)
    assert all(x != y for x, y in zip(cut(turned), own, strict=True))


@pytest.mark.parametrize("hot", [lm_scoring.HOT, 40])
def test_lm_scoring(spark, docs, odd, monkeypatch, hot):
    """All documents against plain counting, with all or some words and pairs frequent."""
    monkeypatch.setattr(lm_scoring, "HOT", hot)
    monkeypatch.setattr(lm_scoring, "GATHER", 3000)
    ids = [r["doc_id"] for r in docs.orderBy("doc_id").limit(20).collect()]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + ODD
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(ODD, "doc_id long, text string"))
    assert_losses(lm_scoring.score_documents(both, spark.createDataFrame([(i,) for i in ids], "i long")), [(i, WORD.findall(lower(t))) for i, t in rows], set(ids))
    edge = lm_scoring.score_documents(odd, spark.createDataFrame([], "i long")).collect()
    assert len(edge) == len(ODD) and all(r["score"] in (None, 0.0) and (r["score"] is None) == (r["n_tokens"] == 0) for r in edge)
    assert lm_scoring.score_documents(odd.limit(0), spark.createDataFrame([(1,)], "i long")).count() == 0


def assert_losses(got, rows, good):
    """rows: id and words of each document."""
    n, ctx, two = ([Counter(), Counter()] for _ in range(3))
    for i, w in rows:
        for side in (0, 1) if i in good else (1,):
            n[side].update(w), ctx[side].update(["^", *w[:-1]] if w else []), two[side].update(zip(["^", *w], w))
    want = []
    for i, w in rows:
        each = [-sum(math.log((two[s][a, b] + lm_scoring.BACKOFF * (n[s][b] + 1) / (n[s].total() + len(n[1]) + 1)) / (ctx[s][a] + lm_scoring.BACKOFF)) for a, b in zip(["^", *w], w)) / len(w) if w else None for s in (0, 1)]
        want.append((i, len(w), *each, each[0] - each[1] if w else None))
    order = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or 0)
    for g, x in zip(sorted(map(tuple, got.collect()), key=order), sorted(want, key=order), strict=True):
        assert g[:2] == x[:2] and (g[2:] == x[2:] if x[2] is None else g[2:] == pytest.approx(x[2:], rel=1e-9, abs=1e-9))


def test_lm_scoring_counts_every_word_and_pair(spark, monkeypatch, hot=300):
    """More words than any fixed vocabulary, each pair with its own count; the same for repeated ids."""
    monkeypatch.setattr(lm_scoring, "HOT", hot)
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.05, 800) % 60_000) for _ in range(60)]
    texts += [" ".join(f"r{i}x{j}" for j in range(400)) for i in range(50)]
    rows = [(i // 2, t) for i, t in enumerate(texts)]
    good = {3, 4, 40}
    assert len({w for t in texts for w in t.split()}) > 1 << 14
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert_losses(lm_scoring.score_documents(df, spark.createDataFrame([(i,) for i in good], "i long")), [(i, t.split()) for i, t in rows], good)


def test_lm_scoring_packs_what_it_shuffles(spark, docs, monkeypatch):
    """Each token is shuffled once, in rows that hold the entries of many."""
    monkeypatch.setattr(lm_scoring, "HOT", 300)
    marked = docs.select(F.col("doc_id").cast("long").alias("rid"), "text", (F.col("doc_id") % 3 == 0).alias("own"))
    model = lm_scoring.frequent(marked, lm_scoring.grams(marked))
    slots = lm_scoring.Slots(2, 3)
    rows = [lm_scoring.rare_rows(marked, spark.sparkContext.broadcast(model), slots, p).selectExpr("slot", "length(g) div 8 as n", "length(x) as x").collect() for p in range(lm_scoring.PASSES)]
    rare = [r for part in rows for r in part if r["slot"] < slots.keys * lm_scoring.PASSES]
    texts = [re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or "") for r in docs.collect()]
    pairs = Counter(p for t in texts for w in [WORD.findall(t)] for p in zip(["", *w], w))
    assert len(model.pairs) and sum(r["n"] for r in rare) == pairs.total() - sum(n for _, n in pairs.most_common(len(model.pairs))) == sum(r["x"] for r in rare)
    assert sum(map(len, rows)) * 100 < pairs.total()


def test_lm_scoring_packing(monkeypatch):
    """Packed entries come back whole, also in batches; hashes are found among sorted keys, first and last ones too."""
    monkeypatch.setattr(lm_scoring, "PACK", 64)
    rng = np.random.default_rng(8)
    for most in (1, 7, 100_000, 1 << 30):
        slot, a, b = rng.integers(0, most, 500), rng.integers(0, 99, 500), rng.integers(0, 99, 500).astype(np.uint8)
        got = [(s, *e) for s, (x, y) in lm_scoring.unpacked(lm_scoring.packed(slot, {"a": a, "b": b})) for e in zip(x.view(np.int64).tolist(), y.tolist(), strict=True)]
        assert Counter(got) == Counter(zip(slot.tolist(), a.tolist(), b.tolist(), strict=True))
    assert not list(lm_scoring.packed(np.zeros(0, np.int64), {"a": np.zeros(0, np.int64)}))
    for n in (0, 1, 2, 3, 1000):
        keys = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        keys[:1], keys[2:][-1:] = 0, 2**64 - 1
        h = np.concatenate((keys, keys + np.uint64(1), rng.integers(0, 1 << 63, 500).astype(np.uint64), np.array([0, 2**64 - 1], np.uint64)))
        at = {int(k): i for i, k in enumerate(keys)}
        assert lm_scoring.Places(keys).of(h).tolist() == [at.get(int(x), -1) for x in h]


def test_lm_scoring_in_many_slots(spark, docs, monkeypatch):
    """Few entries in a slot and few held at a time give the same sums."""
    for name, value in (("HOT", 300), ("GATHER", 500), ("DOCUMENTS", 9), ("HELD", 900)):
        monkeypatch.setattr(lm_scoring, name, value)
    rows = [(r["doc_id"], re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or "")) for r in docs.collect()]
    good = {i for i, _ in rows if i % 4 == 0}
    assert_losses(lm_scoring.score_documents(docs, spark.createDataFrame([(i,) for i in good], "i long")), [(i, WORD.findall(t)) for i, t in rows], good)


def brute_best(words):
    """The best match of any template in a text, aligned at every place without a band: matched words, first place, name."""
    index = license_scan.Index(license_scan.TEMPLATES)
    found = []
    for name, template in zip(index.names, index.words):
        m, a, _ = license_scan.align(template, words, 0, len(words) + len(template))
        if m / len(template) >= license_scan.LEAST_COVERAGE:
            found.append((-m, a, name))
    return min(found, default=None)


def test_license_scan_finds_edited_notices(spark):
    """Notices with words changed, lost and put in, at each place of the short ones and at many of the long ones."""
    rng = np.random.default_rng(6)
    texts = ["no notice here at all under the license of the work"]
    for name, t in license_scan.TEMPLATES.items():
        w = t.replace("-", " ").split()
        for i in range(len(w)) if len(w) < license_scan.LONG else rng.integers(0, len(w), 3):
            texts += [" ".join(["before", *w[:i], "zzz", *w[i + 1 :], "after"]), " ".join([*w[:i], *w[i + 1 :]]), " ".join([*w[:i], "zzz", *w[i:]])]
        if len(w) >= license_scan.LONG:
            gone = set(rng.choice(len(w), len(w) // 6, replace=False).tolist())
            texts.append(" ".join("zzz" if i in gone else x for i, x in enumerate(w)))
    got = {}
    for r in license_scan.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        got.setdefault(r["doc_id"], set()).add((r["license"], r["matched_words"]))
    found = 0
    for k, t in enumerate(texts):
        raw = np.frombuffer(t.encode(), np.uint8)
        best = brute_best(license_scan.split(raw, np.array([0, len(raw)]))[2])
        assert (best is None and k not in got) or (best[2], -best[0]) in got[k], t
        found += best is not None
    assert found > 100


def test_license_scan(spark, odd):
    mit = license_scan.TEMPLATES["MIT-text"]
    w = mit.split()
    edited = " ".join([*w[:20], "really", *w[20:40], *w[42:]])
    rows = [(1, "é x Released under the MIT License. y"), (2, f"intro words\n{mit}\nend"), (3, edited), (4, "the license of a work"), (5, None), (6, "Released under the MIT License. " * 2)]
    got = license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string").withColumn("license", F.lit(1))).collect()
    assert sorted((r["doc_id"], r["license"]) for r in got) == [(1, "MIT"), (2, "MIT-text"), (3, "MIT-text"), (6, "MIT"), (6, "MIT")]
    text = {i: t for i, t in rows}
    for r in got:
        part = text[r["doc_id"]][r["span_start"] : r["span_end"]]
        assert part.startswith(("Released", "Permission")) and part.endswith(("License", "Software"))
        assert r["coverage"] == 1.0 or (r["doc_id"] == 3 and r["coverage"] > 0.95)
    assert license_scan.scan_licenses(odd).count() == 0
