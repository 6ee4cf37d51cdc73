"""Shared by the operators: column expressions, byte-level tokenising, intermediate tables.

Words are maximal runs of anything but space, tab, line feed, vertical tab, form feed and carriage return.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text; of null or blank text none."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE_RUN))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def let(value: Column, body) -> Column:
    """``body(value)`` with value computed once, also where body has lambdas that use it again and again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def with_row_ids(docs: DataFrame) -> DataFrame:
    """Adds rid: the id where ids are unique, else the row's number in a table that is written for it (rows of one id, or of none,
    never meet in one task)."""
    docs = docs.withColumn("rid", F.col("doc_id").cast("long"))
    if not docs.groupBy("rid").count().where("rid is null or count > 1").limit(1).count():
        return docs
    return written(docs.withColumn("rid", F.monotonically_increasing_id()), "numbered")


# -- intermediate tables ----------------------------------------------------------------------------------------------

_ROOTS: dict[str, str] = {}


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def shared_root(spark: SparkSession) -> str:
    """A folder of this application under spark.checkpoint.dir; a temporary one only where that is unset and all tasks run on
    this machine (tests)."""
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        _ROOTS[app] = f"{(base or tempfile.mkdtemp(prefix='graphloom-')).rstrip('/')}/graphloom-{app}"

        def tidy(root=_ROOTS[app]):
            try:
                _delete(spark, root)
            except Exception:  # noqa: BLE001  the JVM may be gone already
                pass

        atexit.register(tidy)
    return _ROOTS[app]


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def drop(df: DataFrame) -> None:
    """Deletes a table made by written() that nothing reads any more."""
    _delete(df.sparkSession, df._written)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps now, not when the driver happens to collect garbage. The first
    collection frees what holds them, the second finds them."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def batches_of(spark: SparkSession, rows: int = 1000, size: str = "8388608b") -> None:
    """Arrow batches small enough, in rows and bytes, that a batch of long texts fits a Python worker; a longer row is a batch alone."""
    for key, value in (("maxRecordsPerBatch", str(rows)), ("maxBytesPerBatch", size)):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}") != value:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", value)


# -- byte-level tokenising in numpy -----------------------------------------------------------------------------------

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_INV = _U(pow(int(_BASE), -1, 1 << 64))
_TABLE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_POW: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_POW[0]) < n:
        for k, b in enumerate((_BASE, _INV)):
            p = np.full(max(n, 1 << 20), b, np.uint64)
            p[0] = 1
            _POW[k] = np.multiply.accumulate(p)
    return _POW[0], _POW[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


class Prefix:
    """Hashes of any substrings of a byte buffer."""

    def __init__(self, data: np.ndarray):
        self.pow, self.inv = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLE[data] * self.pow[: len(data)], out=self.sums[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inv[start]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(self.raw(start, end) + (end - start).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column, one text behind the other, and where each text begins (and the last ends); null: empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[o[0] : o[-1]], o - o[0]


def chunks(starts: np.ndarray, most: int = 1 << 20):
    """Ranges of texts with about ``most`` bytes each; a longer text alone."""
    i, n = 0, len(starts) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def tokens(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts one behind the other: begin and end of each word, and the first word of each text (and the end)."""
    word = ~_IS_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True
    before = np.concatenate(([False], word[:-1])) if len(data) else word
    after = np.concatenate((word[1:], [False])) if len(data) else word
    begin = np.flatnonzero(word & (~before | edge[:-1]))
    end = np.flatnonzero(word & (~after | edge[1:])) + 1
    return begin, end, np.searchsorted(begin, starts)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each k successive word hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    s = h[:n].copy()
    for j in range(1, k):
        s = mix(s * _BASE + h[j : j + n])
    return s
