"""Exact top-k inner-product search with a KD-tree per shard.

Vectors become ``floor(1024 * x)`` per component.  Each partition of the vector table is a shard: its
tree is built by median splits of the widest dimension down to leaves of ``LEAF`` vectors with tight
bounding boxes, and the leaves are written as a table (one row per leaf).  For a query the largest
inner product that a box can hold is ``sum(max(q*low, q*high))``; leaves are taken best first, and a
leaf whose bound is below the k-th score so far is skipped, an equal one is read (ties go to the
smaller id).  The k-th score is propagated: every shard first reads the best leaf of each query, the k
best of these over all shards give each query's bound, and the second pass reads only leaves that
reach it.

The queries are the stated query set, taken in blocks of ``BLOCK_ROWS`` rows whose bytes are checked
before the broadcast; a table with more queries is searched block after block.

Scores are exact: BLAS on doubles while every sum of products stays below 2**53, 64-bit integers beyond.

Defined cases: a vector that is null or holds a null or non-finite component takes no part, nor does a
row with a null id; vectors are compared with those of equal length only; rows that repeat a query's id
are its own and no candidates; a repeated query (same id and vector) is searched once; an empty table
gives no rows; fewer than k candidates give all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyrisk.llm.common import written

K = 10
LEAF = 256
SHARD_ROWS = 20_000
BLOCK_ROWS = 4_096
BLOCK_BYTES = 64 << 20
SCALE = 1024

_LEAF = "shard long, dims int, ids array<long>, vectors array<long>, low array<long>, high array<long>"
_HIT = "query_id long, qpos long, vec_id long, score long"


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, v array<long>``: the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    fine = v.isNotNull() & F.forall(v, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    return (vectors.where(F.col(id_col).isNotNull() & fine)
            .select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x * SCALE).cast("long")).alias("v")))


def _leaves(rows: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
    """Median splits of the widest dimension."""
    todo = [at]
    while todo:
        part = todo.pop()
        if len(part) <= LEAF:
            yield part
            continue
        own = rows[part]
        wide = int(np.argmax(own.max(0) - own.min(0))) if own.shape[1] else -1
        half = len(part) // 2
        order = np.argpartition(own[:, wide], half) if wide >= 0 else np.arange(len(part))
        todo += [part[order[:half]], part[order[half:]]]


def _tree(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict[int, list] = {}
    shard = 0

    def build(dims: int) -> pd.DataFrame:
        nonlocal shard
        rows = held.pop(dims)
        ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.int64).reshape(len(rows), dims)
        shard += 1
        return pd.DataFrame([(shard, dims, ids[x], v[x].ravel(), v[x].min(0), v[x].max(0)) for x in _leaves(v, np.arange(len(rows)))],
                            columns=["shard", "dims", "ids", "vectors", "low", "high"])

    for f in frames:
        for i, v in zip(f["vec_id"], f["v"], strict=True):
            held.setdefault(len(v), []).append((i, v))
            if len(held[len(v)]) >= SHARD_ROWS:
                yield build(len(v))
    for dims in list(held):
        yield build(dims)


def build_trees(vectors: DataFrame) -> DataFrame:
    """One row per leaf; a shard has at most ``SHARD_ROWS`` vectors of one length, and its leaves stay together."""
    return vectors.mapInPandas(_tree, _LEAF).withColumn("shard", F.col("shard") + F.spark_partition_id().cast("long") * 1_000_000)


def _products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    most = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(1, q.shape[1])
    return (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64) if most < 2**53 else q @ v.T


def _searcher(block, k: int, first_only: bool):
    """Best-first search of each shard for every query of the block."""

    def shards(frames):
        rows: list = []
        for f in frames:
            for row in f.itertuples(index=False):
                if rows and row.shard != rows[0].shard:
                    yield rows
                    rows = []
                rows.append(row)
        if rows:
            yield rows

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_dims = block.value
        for leaves in shards(frames):
            dims = leaves[0].dims
            if dims not in by_dims:
                continue
            pos, ids, q, floor = by_dims[dims]
            low = np.array([x.low for x in leaves], np.float64).reshape(len(leaves), dims)
            high = np.array([x.high for x in leaves], np.float64).reshape(len(leaves), dims)
            qf = q.astype(np.float64)
            bound = np.maximum(qf, 0) @ high.T + np.minimum(qf, 0) @ low.T
            bound += np.abs(bound) * 1e-12  # rounding never hides a leaf
            order = np.argsort(-bound, axis=1, kind="stable")
            held = [np.asarray(x.vectors, np.int64).reshape(len(x.ids), dims) for x in leaves]
            names = [np.asarray(x.ids, np.int64) for x in leaves]
            best: list[list] = [[] for _ in ids]
            kth = floor.copy()
            alive = np.arange(len(ids))
            for step in range(1 if first_only else len(leaves)):
                leaf = order[alive, step]
                keep = bound[alive, leaf] >= kth[alive]
                alive, leaf = alive[keep], leaf[keep]
                if not len(alive):
                    break
                for at in np.unique(leaf):
                    own = alive[leaf == at]
                    score = _products(q[own], held[at])
                    near = (score >= kth[own][:, None]) & (names[at][None, :] != ids[own][:, None])
                    for r in np.flatnonzero(near.any(1)):
                        i = own[r]
                        hit = np.flatnonzero(near[r])
                        top = sorted([*best[i], *zip((-score[r, hit]).tolist(), names[at][hit].tolist(), strict=True)])[:k]
                        best[i] = top
                        if len(top) == k:
                            kth[i] = max(kth[i], -top[-1][0])
            out = [(int(ids[i]), int(pos[i]), v, -s) for i, top in enumerate(best) for s, v in top]
            if out:
                yield pd.DataFrame(out, columns=["query_id", "qpos", "vec_id", "score"])

    return run


def _best(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qpos").orderBy(F.desc("score"), F.asc("vec_id"))
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k highest integer inner products."""
    spark = vectors.sparkSession
    leaves, _ = written(build_trees(integer_vectors(vectors, id_col, vector_col)), "leaves")
    asked = (integer_vectors(queries, id_col, vector_col).distinct()
             .withColumns({"qpos": F.monotonically_increasing_id(), "bytes": F.size("v") * 8 + 32}))
    asked, _ = written(asked.repartitionByRange(F.col("vec_id")), "queries")
    found = None
    for block in _blocks(asked):
        held = spark.sparkContext.broadcast(_by_dims(block, {}))
        seeds = _best(leaves.mapInPandas(_searcher(held, k, True), _HIT), k)
        floors = {r.qpos: r.low for r in seeds.groupBy("qpos").agg(F.min("score").alias("low"), F.count("*").alias("n")).where(F.col("n") == k).collect()}
        held = spark.sparkContext.broadcast(_by_dims(block, floors))
        part = _best(leaves.mapInPandas(_searcher(held, k, False), _HIT), k)
        if len(block) == BLOCK_ROWS or found is not None:
            part, _ = written(part, "topk")  # many blocks: each result is kept, not planned again
        found = part if found is None else found.unionAll(part)
    if found is None:
        found = spark.createDataFrame([], _HIT + ", rank int")
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _blocks(asked: DataFrame) -> Iterator[list]:
    block, size = [], 0
    for row in asked.toLocalIterator():
        if block and (len(block) == BLOCK_ROWS or size + row.bytes > BLOCK_BYTES):
            yield block
            block, size = [], 0
        block.append(row)
        size += row.bytes
    if block:
        yield block


def _by_dims(block: list, floors: dict[int, int]) -> dict[int, tuple]:
    out = {}
    for dims in {len(r.v) for r in block}:
        own = [r for r in block if len(r.v) == dims]
        out[dims] = (np.array([r.qpos for r in own]), np.array([r.vec_id for r in own]), np.array([r.v for r in own], np.int64).reshape(len(own), dims),
                     np.array([floors.get(r.qpos, -(2**63)) for r in own], np.int64))
    return out
