"""Session helpers.

Library functions never change session settings; they only read them.  ``local_session``
is for tests and the benchmark.  ``checkpoint_dir`` returns the shared checkpoint folder
the cluster names in ``spark.checkpoint.dir`` and only creates a scratch folder when the
setting is unset (local tests).
"""

from __future__ import annotations

import gc
import os
import tempfile
import threading
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "skyrisk") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The reliable checkpoint folder.  Uses the context's folder when one is set (the cluster's
    ``spark.checkpoint.dir``); only when none is set it sets a local one once, on a local master, and
    raises on any other.  Never calls
    ``setCheckpointDir`` again: Spark appends a fresh sub-folder on every call."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="skyrisk-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` into the reliable checkpoint folder (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


GARBAGE_SECONDS = 10.0
_collected = [0.0]


def _collect_garbage(spark: SparkSession) -> None:
    """Collect the driver's garbage, on which Spark removes shuffle files from local disks; not for each of many small tables."""
    if time.monotonic() - _collected[0] > GARBAGE_SECONDS:
        _collected[0] = time.monotonic()
        gc.collect()
        spark.sparkContext._jvm.System.gc()


_blocks = threading.local()  # the open ``working`` blocks of a thread, each a list of tables


@contextmanager
def working(spark: SparkSession) -> Iterator[None]:
    """Tables that this thread stores in the block, but for those with ``result=True``, are deleted at its end."""
    blocks = _blocks.__dict__.setdefault("open", [])
    blocks.append([])
    try:
        yield
    finally:
        _delete(spark, blocks.pop())


def stored(df: DataFrame, result: bool = False, file_rows: int = 0) -> DataFrame:
    """``df`` as a Parquet table in the checkpoint folder: for many rows that several passes read, a pass takes the
    columns it needs, and no row is deserialised as an object, as those of a checkpoint are.  A file gets at most ``file_rows``
    rows, if given (for large rows).  The shuffles behind it are garbage then."""
    path = scratch_path(df.sparkSession, f"stored-{uuid.uuid4().hex}")
    df.write.option("maxRecordsPerFile", file_rows).parquet(path, compression="zstd")
    _collect_garbage(df.sparkSession)
    blocks = getattr(_blocks, "open", [])
    if len(blocks) > result:
        blocks[-1 - result].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unstore(df: DataFrame) -> None:
    """Delete the ``stored`` tables that ``df`` reads, when nothing reads them any more."""
    folders = {os.path.dirname(f) for f in df.inputFiles()}
    _delete(df.sparkSession, [f for f in folders if os.path.basename(f).startswith("stored-")])


def _delete(spark: SparkSession, paths: list[str]) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for path in paths:
        p = hadoop.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for intermediate tables."""
    return os.path.join(checkpoint_dir(spark), name)
