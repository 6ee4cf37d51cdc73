"""The corpus pipeline: quality rules, near-dedup, suffix-array dedup, mixing, encoding.

Each stage takes what the one before kept, written as Parquet and read again. All but the last return the columns of
``documents``; n_chars follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import minhash, mixing, quality, sentencepiece_codec, suffix_dedup
from graphloom.llm.common import read, shared_root, with_row_ids

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: A repeated run of so many words is a passage.
PASSAGE = 51


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.judge(docs.select(*COLUMNS), read(spark, sf_dir, "labels"), extra=COLUMNS[2:]).where("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more; the smallest id stays."""
    docs = docs.select(*COLUMNS)
    lost = minhash.near_duplicates(docs, k=5).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(lost, "doc_id", "left_anti").select(*COLUMNS)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that the corpus holds more than once, of over 50 words or of 400 bytes or more; texts of which
    nothing is left go."""
    cut = suffix_dedup.cut_duplicates(docs.select(*COLUMNS), words=PASSAGE)
    return cut.where((F.length("text") > 0) | (F.col("n_removed") == 0)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    rows = with_row_ids(docs.select(*COLUMNS))
    taken = mixing.mix(rows).where("copies > 0").select("rid", "copies")
    return rows.join(taken, "rid").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each text."""
    return sentencepiece_codec.encode_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("source_mixing", source_mixing),
    ("sentencepiece", encoding),
]

#: Suffix arrays, sampling and Viterbi are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on documents, each one's rows written as Parquet and read again."""
    import uuid

    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_root(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
