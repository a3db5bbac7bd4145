"""Helpers shared by the corpus operators: shared storage and byte-level text views."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only where none is named and all work is done on this machine."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="cadenza-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back; cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that `materialize` wrote and nothing reads any more."""
    if files := df.inputFiles():
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def joined_to_groups(rows: DataFrame, groups: DataFrame, key: str, hot_groups: int = 10_000) -> DataFrame:
    """rows joined with their groups: unique `key`, its number of rows `n`, and other columns.

    A key may hold a large part of all rows, so groups of many rows are broadcast, at most
    `hot_groups` of them however many rows there are, and only the rows of others are shuffled.
    """
    least = max(1000, rows.count() // hot_groups)
    hot = groups.filter(F.col("n") > least).drop("n")
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(rest.join(groups.filter(F.col("n") <= least).drop("n"), key))


#: Hash buckets by which rows that may have a partner are told from those that cannot.
BUCKETS = 1 << 20


def may_match(df: DataFrame, key: Column, keys: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows whose key shares a hash bucket with one of `keys` (its only column), or with how="left_anti" the others.

    Rows of no such bucket need not be shuffled to meet `keys`. At most BUCKETS numbers are broadcast.
    """
    bucket = lambda c: F.pmod(F.xxhash64(c, F.lit(5)), F.lit(BUCKETS)).alias("__bucket")
    taken = keys.select(bucket(F.col(keys.columns[0]))).distinct()
    return df.join(F.broadcast(taken), bucket(key) == taken["__bucket"], how)


#: Spark's limit on the bytes of a batch that goes to Python.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Lower the session's limit on the bytes of a batch to `most`: rows are whole texts here, and each batch is held twice or more."""
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH_BYTES, "1g"))
    if now > most:
        spark.conf.set(BATCH_BYTES, f"{most}b")


def texts_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone, so no other column of the input can clash with ours."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(lengths: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Cut items into runs [i, j) of at most `most` in total length; one longer item is a run of its own."""
    start = total = 0
    i = -1
    for i, n in enumerate(lengths):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if i >= start and i >= 0:
        yield start, i + 1


#: Called where a worker begins work that does not need what these keep.
WORKER_CACHES: list[Callable[[], None]] = []


def small_batches(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows, a few at a time, so that few texts are Python objects at once; what earlier stages keep in this worker goes."""
    for drop in WORKER_CACHES:
        drop()
    for b in batches:
        for i in range(0, len(b), rows):
            yield b.slice(i, rows)


#: Odd base of the polynomial hash over bytes, modulo 2**64 (fixed value).
BASE = np.uint64(0x9E3779B97F4A7C15)


def _new_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in (BASE, np.uint64(pow(int(BASE), -1, 1 << 64))):
        p = np.full(n, b, np.uint64)
        p[:1] = 1
        out.append(np.multiply.accumulate(p, out=p))
    return out[0], out[1]


@lru_cache(maxsize=1)
def _kept_powers() -> tuple[np.ndarray, np.ndarray]:
    return _new_powers(1 << 19)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n; those of a usual length are kept between calls."""
    up, down = _kept_powers() if n <= 1 << 19 else _new_powers(n)
    return up[:n], down[:n]


def mix64(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads a 64-bit hash over all its bits."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


class ByteHashes:
    """Prefix sums of a polynomial hash, giving the hash of any byte range in O(1)."""

    def __init__(self, data: np.ndarray):
        power, self.inverse = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=self.sums[1:])

    def between(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mixed hash of data[start:end], with the length mixed in."""
        h = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return mix64(h + (end - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def word_table(lower: bool, is_word: Iterable[int]) -> tuple[np.ndarray, np.ndarray]:
    """(byte map, word flags) for split_words."""
    fold = np.arange(256, dtype=np.uint8)
    if lower:
        fold[65:91] += 32
    flags = np.zeros(256, bool)
    flags[list(is_word)] = True
    return fold, flags


def split_words(data: np.ndarray, bounds: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of word bytes that do not cross the document bounds.

    bounds holds len(docs)+1 byte offsets. Returns start and end of each word, and for each
    document the number of words before it (len(docs)+1 values).
    """
    w = flags[data]
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(bounds), np.int64)
    first = w.copy()
    first[1:] &= ~w[:-1]
    last = w.copy()
    last[:-1] &= ~w[1:]
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    first[inner] |= w[inner]
    last[inner - 1] |= w[inner - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, bounds)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array, and the offsets of their bounds."""
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=bounds[1:])
    return np.frombuffer(b"".join(texts), np.uint8), bounds
