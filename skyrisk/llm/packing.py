"""Hierarchical residual packing of documents into token sequences.

1. Every text is encoded, an end id is appended, and a document longer than ``size`` is cut into
   pieces: the first one takes what is over, the others are full.  A full piece is a sequence.
2. Each partition packs its remaining pieces by best fit, longest first.  Bins with at most ``slack``
   free places are done; the others are items of the next round, in which ``FAN`` partitions come
   together.  Rounds end when one task has packed all that is left, or, where more bins are left than
   ``TASK_ITEMS`` (for example only pieces of over half a sequence), when a round no longer saves one
   bin in a hundred; what is left is then done as it is.

A task holds one partition's lengths and item numbers only, texts are read once, and each round is a
written table.  Sequences are numbered by the item number of their first piece.

Defined cases: null or empty texts are the end id alone; repeated rows are packed each by itself; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyrisk.llm.common import id_text, written
from skyrisk.llm.tokens import encoder, shipped, tokenizer_file

SIZE = 2048
SLACK = 16
FAN = 8
TASK_ITEMS = 400_000
END_ID = 0


def token_pieces(docs: DataFrame, size: int = SIZE, tokenizer: str | None = None, end_id: int = END_ID,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: the pieces of each document."""
    frame = id_text(docs, id_col, text_col)
    spec = shipped(docs.sparkSession, tokenizer or tokenizer_file())
    end = np.array([end_id], "<u4").tobytes()
    schema = T.StructType([frame.schema["doc_id"], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
                           T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(spec)
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = enc.encode(text) + end
                n = len(ids) // 4
                first = n % size or size
                for k, at in enumerate([0, *range(first, n, size)]):
                    to = first if at == 0 else at + size
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(to - at)
                    crc.append(zlib.crc32(ids[4 * at:4 * to]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return frame.mapInArrow(run, schema)


def best_fit(sizes: list[int], size: int) -> list[list[int]]:
    """Bins of positions in ``sizes``: longest first, each into the fullest bin that takes it."""
    free: dict[int, list[int]] = {}  # free places -> bins
    mask = 0  # the bit of each number of free places that some bin has
    bins: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        n = sizes[i]
        above = mask >> n
        if above:
            left = n + (above & -above).bit_length() - 1
            b = free[left].pop()
            if not free[left]:
                mask ^= 1 << left
            bins[b].append(i)
        else:
            left, b = size, len(bins)
            bins.append([i])
        if left > n:
            free.setdefault(left - n, []).append(b)
            mask |= 1 << (left - n)
    return bins


_BIN = "size int, items array<long>, lengths array<int>"


def _packer(size: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [f for f in frames if len(f)]
        if not got:
            return
        held = pd.concat(got, ignore_index=True)
        items, lengths = held["items"].tolist(), held["lengths"].tolist()
        out = []
        for b in best_fit(held["size"].tolist(), size):
            one = np.concatenate([items[i] for i in b]), np.concatenate([lengths[i] for i in b])
            out.append((int(one[1].sum()), *one))
        for at in range(0, len(out), 10_000):
            yield pd.DataFrame(out[at:at + 10_000], columns=["size", "items", "lengths"])

    return run


def pack_bins(pieces: DataFrame, size: int = SIZE, slack: int = SLACK) -> tuple[list[DataFrame], list[str]]:
    """Done bins (``size, items, lengths``) of each round of the hierarchy over ``item, length`` rows
    that are shorter than ``size``, and the working tables they are in."""
    bins = pieces.select(F.col("length").cast("int").alias("size"), F.array("item").alias("items"), F.array(F.col("length").cast("int")).alias("lengths"))
    tasks, before, done, paths = bins.rdd.getNumPartitions(), None, [], []
    while True:
        bins, path = written(bins.mapInPandas(_packer(size), _BIN), "bins")
        paths.append(path)
        full = F.col("size") >= size - slack
        left = bins.where(~full).count()
        stuck = before is not None and left > 0.99 * before
        if tasks == 1 or left == 0 or stuck and left > TASK_ITEMS:
            return [*done, bins], paths
        done.append(bins.where(full))
        # by slices of a few hundred thousand bins, never more than one task can hold
        tasks, before = max(min(-(-tasks // FAN), tasks - 1), -(-left // TASK_ITEMS)), left
        bins = bins.where(~full).coalesce(tasks)


def pack(docs: DataFrame, size: int = SIZE, slack: int = SLACK, tokenizer: str | None = None, end_id: int = END_ID,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``: one row per piece."""
    pieces, _ = written(token_pieces(docs, size, tokenizer, end_id, id_col, text_col)
                        .withColumn("item", F.monotonically_increasing_id()), "pieces")
    done, _ = pack_bins(pieces.where(F.col("length") < size), size, slack)
    members = reduce(DataFrame.unionAll, done).select(
        F.col("items")[0].alias("sequence_id"), F.posexplode("items").alias("at", "item"), "lengths")
    placed = members.select("item", "sequence_id", F.aggregate(
        F.slice("lengths", F.lit(1), F.col("at")), F.lit(0).cast("long"), lambda n, x: n + x).alias("offset"))
    short = pieces.where(F.col("length") < size).join(placed, "item")
    full = pieces.where(F.col("length") == size).withColumns({"sequence_id": F.col("item"), "offset": F.lit(0).cast("long")})
    out = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return short.select(*out).unionAll(full.select(*out))
