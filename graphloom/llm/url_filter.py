"""URL filter: rules first, then the ratio of two character language models. DataFrame functions only.

The models are variable-order Markov models over the lower-cased URL, one of the URLs that the rules allow and one of those
that they block. The probability of a character after its last k characters is
``(n(context, char) + WEIGHT * p(char | one character less)) / (n(context) + WEIGHT)`` for k = 3 down to 0, and 1/ALPHABET
below that; so a context that was not seen hands over to the shorter one. A URL's score is the mean over its characters of
``ln p_allowed - ln p_blocked``; it is allowed from the threshold on, which lies midway between the mean scores of the two
training classes. Each character's ratio is rounded to a millionth and summed as an integer, so results do not depend on
the order of rows.

Defined cases: a null URL and one without ``://`` have an empty host and path and fit no rule; a null or empty URL has no
score and is blocked; without rows of one class all scores are 0 and the threshold is 0, so the others are allowed;
repeated URLs count each time; rows of one page_id are judged one by one; an empty table gives none. Only the id and the
URL column are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import read, written

RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
ORDER, WEIGHT, ALPHABET, SCALE = 3, 4.0, 256, 1_000_000
PAD = "\u0002"  # stands before the first character
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def rule_for(host_: Column, path_: Column, rules) -> Column:
    """struct<rule, verdict> of the longest rule that fits (of equal ones the first by code point), else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):
        name, slash, rest = rule.partition("/")
        fits = ((host_ == name) | F.endswith(host_, F.lit("." + name))) & F.startswith(path_, F.lit(slash + rest))
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def grams(url: Column) -> Column:
    """Each character with the ORDER characters before it."""
    padded = F.concat(F.lit(PAD * ORDER), F.lower(url))
    return F.transform(F.sequence(F.lit(1), F.length(url)), lambda i: F.substring(padded, i, F.lit(ORDER + 1)))


def ratios_of(counted: DataFrame) -> DataFrame:
    """Ratios from grams with counts a (allowed) and b (blocked); without one of the classes all are 0."""
    total = counted.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("a"), F.coalesce(F.sum("b"), F.lit(0)).alias("b")).first()
    if not total["a"] or not total["b"]:
        return counted.select("gram", F.lit(0).cast("long").alias("ratio"))
    out = counted.select("gram", F.lit(1.0 / ALPHABET).alias("pa"), F.lit(1.0 / ALPHABET).alias("pb"))
    for k in range(ORDER + 1):
        full = F.substring("gram", ORDER + 1 - k, k + 1)
        counts = counted.groupBy(full.alias("full")).agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
        out = out.join(counts, full == counts["full"]).drop("full")
        if k:
            ctx = F.substring("gram", ORDER + 1 - k, k)
            contexts = counted.groupBy(ctx.alias("ctx")).agg(F.sum("a").alias("ca"), F.sum("b").alias("cb"))
            out = out.join(contexts, ctx == contexts["ctx"]).drop("ctx")
        else:
            out = out.withColumns({"ca": F.lit(total["a"]), "cb": F.lit(total["b"])})
        p = lambda x: (F.col(f"n{x}") + F.lit(WEIGHT) * F.col(f"p{x}")) / (F.col(f"c{x}") + F.lit(WEIGHT))
        out = out.select("gram", p("a").alias("pa"), p("b").alias("pb"))
    return out.select("gram", F.round((F.log("pa") - F.log("pb")) * SCALE).cast("long").alias("ratio"))


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """pages: page_id, url. Adds host, path, rule, verdict, score (double), n_chars (long)."""
    rows = pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rows = rows.withColumn("fit", rule_for(F.col("host"), F.col("path"), rules))
    # equal URLs are scored once
    urls = rows.where(F.length("url") > 0).groupBy("url").agg(F.count(F.lit(1)).alias("times"), F.first("fit").alias("fit"))
    exploded = urls.select("url", "times", (F.col("fit.verdict") == "allow").alias("allowed"), F.explode(grams(F.col("url"))).alias("gram"))
    # tables of distinct characters in context and of distinct URLs, each read several times below
    counted = exploded.groupBy("gram").agg(*(F.sum(F.when(F.col("allowed") == v, F.col("times")).otherwise(0)).alias(x) for x, v in (("a", True), ("b", False))))
    counted = written(counted, "grams")
    scored = exploded.join(written(ratios_of(counted), "ratios"), "gram").groupBy("url").agg(F.sum("ratio").alias("total"), F.count(F.lit(1)).alias("n_chars"), F.first("times").alias("times"), F.first("allowed").alias("allowed"))
    mean = written(scored.select("url", "n_chars", "times", "allowed", (F.col("total") / F.col("n_chars") / SCALE).alias("score")), "urls")
    sides = mean.where(F.col("allowed").isNotNull()).groupBy("allowed").agg(F.sum(F.round(F.col("score") * SCALE).cast("long") * F.col("times")).alias("s"), F.sum("times").alias("n")).collect()
    threshold = sum(r["s"] / r["n"] for r in sorted(sides, key=lambda r: r["allowed"])) / 2 / SCALE if len(sides) == 2 else 0.0
    judged = rows.join(mean.select("url", "score", "n_chars"), "url", "left")
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("score") >= threshold, "allow").otherwise("block"))
    return judged.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "score", F.coalesce("n_chars", F.lit(0)).alias("n_chars"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read(spark, sf_dir, "pages").select("page_id", "url"))


def oracle(rules=RULES) -> str:
    """DuckDB SQL for op7's rows."""
    fits = " ".join(f"when (host = '{r.partition('/')[0]}' or host like '%.{r.partition('/')[0]}') and starts_with(path, '/{r.partition('/')[2]}') then '{r}'" for r, _ in sorted(rules, key=lambda r: (-len(r[0]), r[0])))
    says = " ".join(f"when '{r}' then '{v}'" for r, v in rules)
    steps, last = "", f"select gram, {1.0 / ALPHABET}::double as pa, {1.0 / ALPHABET}::double as pb from counted"
    for k in range(ORDER + 1):
        full, ctx = f"substr(gram, {ORDER + 1 - k}, {k + 1})", f"substr(gram, {ORDER + 1 - k}, {k})"
        steps += f"""
p{k} as (select q.gram, (f.a + {WEIGHT}::double * q.pa) / (c.a + {WEIGHT}::double) as pa, (f.b + {WEIGHT}::double * q.pb) / (c.b + {WEIGHT}::double) as pb
  from ({last}) q join (select {full} as x, sum(a) as a, sum(b) as b from counted group by 1) f on {full.replace("gram", "q.gram")} = f.x
  join (select {ctx} as x, sum(a) as a, sum(b) as b from counted group by 1) c on {ctx.replace("gram", "q.gram")} = c.x),"""
        last = f"select * from p{k}"
    return f"""
with cut as (select page_id, url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}') as host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) as path from pages),
fit as (select *, case {fits} end as rule from cut),
ruled as (select *, case rule {says} end as said from fit),
urls as (select url, count(*) as times, any_value(said) as said from ruled where length(url) > 0 group by url),
chars as (select url, times, said, substr(repeat(chr(2), {ORDER}) || lower(url), i::int, {ORDER + 1}) as gram from (select *, unnest(range(1, length(url) + 1)) as i from urls)),
counted as (select gram, coalesce(sum(times) filter (where said = 'allow'), 0)::double as a, coalesce(sum(times) filter (where said = 'block'), 0)::double as b from chars group by gram),
n as (select sum(a) > 0 and sum(b) > 0 as both from counted),{steps}
ratio as (select gram, case when n.both then round((ln(pa) - ln(pb)) * {SCALE})::bigint else 0 end as ratio from p{ORDER}, n),
score as (select url, any_value(times) as times, any_value(said) as said, count(*)::bigint as n_chars, sum(ratio)::double / count(*) / {SCALE} as score from chars join ratio using (gram) group by url),
side as (select said, sum(round(score * {SCALE})::bigint * times)::double / sum(times)::double as m from score where said is not null group by said),
limit_ as (select case when count(*) = 2 then sum(m) / 2 / {SCALE} else 0 end as threshold from side)
select page_id, host, path, rule, coalesce(said, case when score >= threshold then 'allow' else 'block' end) as verdict, score, coalesce(n_chars, 0) as n_chars
from ruled left join (select url, score, n_chars from score) using (url), limit_
"""


QUERIES = {"op7_url_filter": op7_url_filter}
ORACLES = {"op7_url_filter": oracle()}
