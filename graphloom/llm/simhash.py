"""Document fingerprints: SimHash over word shingles. DataFrame functions only.

Terms are the runs of SHINGLE words (a shorter text is one term); each occurrence votes, so a term weighs its frequency.
The BITS bits of a term's hash vote on the bits of the fingerprint; a bit is set if more than half of the votes are for it.
Votes are counted with two 32-bit lanes in a long: one addition counts two bits. The likeness of two fingerprints is the
share of bits in which they agree.

``within`` finds all fingerprints within a Hamming radius by permuted block tables: the bits are cut into BLOCKS blocks,
and for each choice of BLOCKS - radius of them there is a table keyed by those blocks. Two fingerprints that differ in at
most radius bits agree in one table's key at least; the distance is then confirmed. The query asks it for every row whose id is
divisible by QUERY_EACH, against all rows: n_within counts the others that are found. Equal fingerprints go in as one, with their number.

Defined cases: a null text is an empty text; a text without words has the fingerprint of zeros; rows that share an id follow
each other by text; a single row is its own next document; an empty table gives none. Only the id and text columns are
read. A null id comes before all others.
"""

from __future__ import annotations

import json
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.common import let, read, words, written

SHINGLE, BITS, BLOCKS, RADIUS, QUERY_EACH, SALTS = 5, 128, 5, 3, 20, 8
ROWS_PER_RANGE, MOST_RANGES, STRIDE = 5_000, 100_000, 300
_PAIR = (1 << 32) | 1


def fingerprints(rows: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """key columns and fingerprint (hexadecimal) of each group of rows with the same key; a row of no word adds no votes."""
    listed = rows.select(*key, words(F.col(text)).alias("_w"))
    w = F.col("_w")
    runs = F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(SHINGLE))))
    short = F.when(F.size(w) == 0, F.array(F.lit(None).cast("long"))).otherwise(F.array(F.xxhash64(F.array_join(w, " "))))
    each = listed.select(*key, F.explode(F.when(F.size(w) < SHINGLE, short).otherwise(runs)).alias("_h0"))
    each = each.withColumn("_h1", F.when(F.col("_h0").isNotNull(), F.xxhash64("_h0")))
    sums = [F.sum(F.shiftrightunsigned(f"_h{j}", k).bitwiseAND(F.lit(_PAIR))).alias(f"_s{j}_{k}") for j in range(BITS // 64) for k in range(32)]
    voted = each.groupBy(*key).agg(F.count("_h0").alias("_n"), *sums)
    bit = lambda s, on: F.when(2 * s > F.col("_n"), F.lit(on)).otherwise(F.lit(0))

    def half(j: int, high: bool) -> Column:
        votes = (F.shiftright(f"_s{j}_{k}", 32) if high else F.col(f"_s{j}_{k}").bitwiseAND(F.lit(0xFFFFFFFF)) for k in range(32))
        total = F.lit(0).cast("long")
        for k, v in enumerate(votes):
            total = total + bit(v, 1 << k)
        return F.lpad(F.lower(F.hex(total)), 8, "0")

    return voted.select(*key, F.concat(*(half(j, high) for j in range(BITS // 64) for high in (True, False))).alias("fingerprint"))


def words_of(fp: Column) -> list[Column]:
    """A fingerprint as longs of 32 bits."""
    return [F.conv(F.substring(fp, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(BITS // 32)]


def distance(a: Column, b: Column) -> Column:
    return sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(words_of(a), words_of(b), strict=True)), F.lit(0))


def likeness(a: Column, b: Column) -> Column:
    return F.lit(1.0) - distance(a, b) / F.lit(float(BITS))


def halves(fp: Column) -> list[Column]:
    """A fingerprint as longs of 64 bits."""
    w = words_of(fp)
    return [F.shiftleft(w[k], 32).bitwiseOR(w[k + 1]) for k in range(0, len(w), 2)]


def within(queries: DataFrame, against: DataFrame, radius: int = RADIUS) -> DataFrame:
    """query, match, distance, and n where ``against`` has it: all pairs of distinct fingerprints of ``queries`` and ``against``
    (each with a column fingerprint, in ``against`` once each) that differ in at most ``radius`` bits, each pair once.

    A pair counts only in the first table where it agrees, so nothing is made distinct. A frequent key is dealt to SALTS tasks by
    match (adaptive execution splits it further); the queries are repeated for each. A radius of BLOCKS or more is refused."""
    if not 0 <= radius < BLOCKS:
        raise ValueError(f"the radius must lie between 0 and {BLOCKS - 1}")
    cuts = [BITS // 4 * k // BLOCKS for k in range(BLOCKS + 1)]
    tables = list(combinations(range(BLOCKS), BLOCKS - radius))

    def entries(df: DataFrame, name: str, salt: Column, *more: str) -> DataFrame:
        blocks = [F.substring("fingerprint", a + 1, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]
        keys = [F.struct(F.lit(t).alias("t"), F.xxhash64(F.lit(t), *(blocks[i] for i in chosen)).alias("key")) for t, chosen in enumerate(tables)]
        each = df.select(F.array(*halves(F.col("fingerprint"))).alias("h"), F.col("fingerprint").alias(name), *more, F.explode(F.array(*keys)).alias("_k"))
        return each.select(name, *more, *(F.col("h")[k].alias(f"{name}{k}") for k in range(BITS // 64)), F.col("_k.t").alias(f"{name}_t"), F.col("_k.key").alias("_key"), salt.alias("_salt"))

    q = entries(queries.select("fingerprint").distinct(), "query", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    m = entries(against, "match", F.pmod(F.xxhash64("match"), F.lit(SALTS)).cast("int"), *(["n"] if "n" in against.columns else []))
    pairs = q.join(m, ["_key", "_salt"])
    differ = [F.col(f"query{k}").bitwiseXOR(F.col(f"match{k}")) for k in range(BITS // 64)]
    agreed = F.lit(0)
    for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        mask = ((1 << 4 * (b - a)) - 1) << (BITS - 4 * b)
        parts = [d.bitwiseAND(F.lit(signed(mask >> (BITS - 64 * (k + 1)) & (1 << 64) - 1))) for k, d in enumerate(differ)]
        agreed = agreed + F.when(sum((F.bit_count(x) for x in parts), F.lit(0)) == 0, F.lit(1 << i)).otherwise(F.lit(0))
    first = [next((t for t, chosen in enumerate(tables) if all(bits >> i & 1 for i in chosen)), -1) for bits in range(1 << BLOCKS)]
    apart = sum((F.bit_count(d) for d in differ), F.lit(0))
    here = F.get(F.array(*map(F.lit, first)), agreed)
    kept = pairs.where((apart <= radius) & (F.col("query_t") == F.col("match_t")) & (here == F.col("query_t")))
    return kept.select("query", "match", *(["n"] if "n" in against.columns else []), apart.alias("distance"))


def signed(value: int) -> int:
    """The 64 bits of a value as a signed long."""
    return value - (1 << 64) if value >> 63 else value


def with_neighbours(found: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Adds n_within to a table of doc_id and fingerprint: for each row whose id is divisible by QUERY_EACH the number of other rows
    whose fingerprints differ from its own in at most ``radius`` bits; for other rows null."""
    asks = F.coalesce(F.col("doc_id") % QUERY_EACH == 0, F.lit(False))
    counts = found.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"))
    near = within(found.where(asks), counts, radius).groupBy(F.col("query").alias("fingerprint")).agg((F.sum("n") - 1).alias("n_within"))
    near = near.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    asked = found.where(asks).withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    answered = asked.join(near, ["fingerprint", "_salt"]).select(*found.columns, "n_within")
    return answered.unionByName(found.where(~asks).withColumn("n_within", F.lit(None).cast("long")))


def constant(values: list, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def range_of(value: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds lie below a value: a look at each STRIDE-th bound, then at those in between."""
    every, some = constant(bounds, "bigint"), constant(bounds[STRIDE - 1 :: STRIDE], "bigint")
    below = lambda b: F.size(F.filter(b, lambda x: x < value))
    return let(below(some) * STRIDE, lambda skip: skip + below(F.slice(every, skip + 1, F.lit(STRIDE))))


def with_next(docs: DataFrame) -> DataFrame:
    """Adds next_text: the text of the document that follows by ascending id, of the last the first's. Ids are dealt into
    ranges of about equal counts (_range), whose rows are numbered (_at). Each range also gets a copy (_own is false) of the
    first row of the next range, so only a range's rows meet in one task. MOST_RANGES + 1 ids at most go to the driver."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    n = min(MOST_RANGES, docs.count() // ROWS_PER_RANGE) + 1
    shares = constant([k / n for k in range(1, n)], "double")
    bounds = docs.agg(F.percentile_approx("doc_id", shares, max(10_000, 10 * n)).alias("b")).first()["b"] if n > 1 else []
    dealt = docs.withColumn("_range", range_of(F.col("doc_id"), sorted(set(bounds or []))))
    least = dealt.groupBy("_range").agg(F.min(F.struct("doc_id")).alias("m")).collect()
    least = dict(sorted((r["_range"], r["m"]["doc_id"]) for r in least))
    places = range(max(least, default=-1) + 1)
    into = dict(zip(least, [max(least, default=0), *least], strict=False))  # the range before, of the first the last
    starts = F.get(constant([least.get(r) for r in places], "bigint"), F.col("_range"))
    firsts = dealt.where(F.col("doc_id").eqNullSafe(starts)).groupBy("_range").agg(F.min(F.struct("doc_id", "text")).alias("m"))
    before = F.get(constant([into.get(r, 0) for r in places], "int"), F.col("_range"))
    copies = firsts.select(F.col("m.doc_id").alias("doc_id"), F.col("m.text").alias("text"), before.alias("_range"), F.lit(False).alias("_own"))
    w = Window.partitionBy("_range").orderBy(F.desc("_own"), "doc_id", "text")
    both = dealt.withColumn("_own", F.lit(True)).unionByName(copies)
    return both.withColumns({"next_text": F.lead("text").over(w), "_at": F.row_number().over(w)})


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_next(read(spark, sf_dir, "documents"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    key = ["_range", "_at", "_own", "doc_id", "n_chars", "edited_sha256"]
    made = rows.select("_range", "_at", "_own", "doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    kinds = F.array(F.struct(F.lit(0).alias("kind"), F.col("text")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text")))
    both = made.withColumn("edited_sha256", F.sha2("edited", 256)).select(*key, F.explode(kinds).alias("v"))
    both = both.where(F.col("_own") | (F.col("v.kind") == 0)).select(*key, F.col("v.kind").alias("kind"), F.col("v.text").alias("text"))
    found = fingerprints(both, [*key, "kind"])
    of = lambda k: F.max(F.when(F.col("kind") == k, F.col("fingerprint")))
    one = found.groupBy(*key).agg(of(0).alias("fingerprint"), of(1).alias("edited_fingerprint"))
    led = one.withColumn("_after", F.lead("fingerprint").over(Window.partitionBy("_range").orderBy("_at"))).where("_own")
    near = lambda c: likeness(F.col("fingerprint"), F.col(c))
    made = led.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near("edited_fingerprint").alias("near_edited"), near("_after").alias("near_next"))
    return with_neighbours(written(made, "fingerprints"))


QUERIES = {"op6_document_fingerprints": op6_document_fingerprints}
