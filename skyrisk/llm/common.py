"""Helpers shared by the training-data operators.

Every operator reads only an id column and a text column (or a vector), under names of its own,
so further columns of the input, whatever their names, never clash with working columns.
"""

from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyrisk.session import checkpoint_dir


CACHE_WORDS = 400_000
BROADCAST_ROWS = 200_000
SLICE_ROWS = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator needs, as ``doc_id`` and ``text``."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


GARBAGE_SECONDS = 10.0
_collected = [0.0]


def _collect_garbage(spark: SparkSession) -> None:
    """Collect the driver's garbage, on which Spark's cleaner removes shuffle files; not for each of many
    small steps."""
    if time.monotonic() - _collected[0] > GARBAGE_SECONDS:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _collected[0] = time.monotonic()


_WORKING: list[list[str]] = []


@contextmanager
def working(spark: SparkSession) -> Iterator[None]:
    """Tables written in this block, but for those written with ``result=True``, are deleted at its end."""
    _WORKING.append([])
    try:
        yield
    finally:
        dropped(spark, *_WORKING.pop())


def written(df: DataFrame, name: str, result: bool = False) -> tuple[DataFrame, str]:
    """``df`` as a Parquet table in the shared folder (lineage cut, survives lost executors), and
    its path for :func:`dropped`.  The shuffles behind it are garbage then, and are collected now and
    then, so that their files don't add up over the steps of an operator."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    if len(_WORKING) > result:
        _WORKING[-1 - result].append(path)
    _collect_garbage(spark)
    return spark.read.schema(df.schema).parquet(path), path


def dropped(spark: SparkSession, *paths: str) -> None:
    """Delete working tables that no returned frame reads any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``BROADCAST_ROWS`` rows (counted); else as it is."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


_HELD: dict[tuple, object] = {}


def held_in_worker(kind: str, key: object, build):
    """``build()``, kept for the tasks that a reused worker gets next.  A worker keeps one such object at
    a time, so the caches of the operators that ran before don't add up."""
    if (kind, key) not in _HELD:
        _HELD.clear()
        _HELD[kind, key] = build()
    return _HELD[kind, key]


def nothing_held() -> None:
    """Let go of what the operator before left in this worker; for tasks that hold nothing themselves."""
    if _HELD:
        _HELD.clear()
        gc.collect()


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in parts of up to ``rows`` rows: a task's Python objects are those of one part."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on arrays of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes:
    """64-bit hashes of words, with a cache of ``CACHE_WORDS``."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def of(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        ids = list(map(known.get, words))
        if None in ids:
            for i, x in enumerate(ids):
                if x is None:
                    w = words[i]
                    ids[i] = known[w] = xxhash.xxh3_64_intdigest(w)
        return np.array(ids, np.uint64)
