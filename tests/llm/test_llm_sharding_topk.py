"""Extendible hashing and exact top-k against brute force."""

import hashlib
import math

import numpy as np
import pytest
from llm_fixtures import CLASH, corpus, frame, ordered, rows_of
from pyspark.sql import functions as F

from skyrisk.llm import sharding as S
from skyrisk.llm import topk as K
from skyrisk.llm.common import scratch


def brute_shards(rows, limit):
    units = [(d, format(int(hashlib.md5(("" if d is None else str(d)).encode()).hexdigest()[:15], 16), "060b"), len((t or "").encode())) for d, t in rows]
    todo, out = [("", units)], []
    while todo:
        shard, own = todo.pop()
        size = sum(u[2] for u in own)
        if own and (size <= limit or len(shard) == 60):
            out += [(d, shard, len(shard), n, size, len(own), size > limit) for d, _, n in own]
        elif own:
            todo += [(shard + b, [u for u in own if u[1][len(shard)] == b]) for b in "01"]
    return ordered(out)


@pytest.mark.parametrize("limit", [3_000, 20_000, 10**9])
def test_shards_match_brute_force(spark, limit):
    rows = corpus()
    got = rows_of(S.assign_shards(frame(spark, rows), limit), "doc_id", "shard", "depth", "n_bytes", "shard_bytes", "shard_docs", "oversized")
    assert got == brute_shards(rows, limit)


def test_only_full_buckets_split_further(spark, monkeypatch):
    """Cells that don't fit go on with more bits, round by round."""
    monkeypatch.setattr(S, "MORE_BITS", 2)
    rows = [(d, "x" * (5000 if d % 7 == 0 else 10)) for d in range(200)]
    got = rows_of(S.assign_shards(frame(spark, rows), 5_000), "doc_id", "shard", "depth", "n_bytes", "shard_bytes", "shard_docs", "oversized")
    assert got == brute_shards(rows, 5_000)


def test_empty_and_written(spark):
    assert S.assign_shards(frame(spark, [])).count() == 0
    docs = frame(spark, corpus(n=10)).drop("shard")
    path = scratch(spark, "shards-test")
    S.write_shards(docs, path, 20_000)
    back = spark.read.parquet(path)
    assert rows_of(back, *docs.columns) == rows_of(docs, *docs.columns)
    name = S.folder_column(docs)
    assert name == ("shard_1" if "shard" in docs.columns else "shard")
    assert back.select(name).distinct().count() == S.assign_shards(docs, 20_000).select("shard").distinct().count()


def brute_top(rows, queries, k=10):
    fine = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in dict.fromkeys((i, tuple(v)) for i, v in fine if i in queries):
        hits = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in fine if i != q and len(w) == len(v))[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(hits, 1)]
    return ordered(out)


def vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return df.withColumns({c: F.lit(c) for c in [*CLASH, "v", "score", "rank", "qpos"]}).repartition(5)


def test_top_k_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(K, "LEAF", 8)
    rng = np.random.default_rng(2)
    rows = [(i, (rng.integers(-3, 4, 6) / 4).tolist()) for i in range(400)]  # many ties
    rows += [(500 + i, rows[7][1]) for i in range(30)]  # copies
    rows += [(600, None), (601, [None] * 6), (602, [float("nan")] + [0.0] * 5), (603, [float("inf")] + [0.0] * 5), (None, [1.0] * 6), (604, []), (700, []), (605, [1.0, 2.0]),
             (606, [3.0, 1.0]), (700, [0.5, 0.5]), rows[100]]
    asked = set(range(0, 1000, 20))
    table = vectors(spark, rows)
    got = rows_of(K.top_k(table, table.where("vec_id % 20 = 0")), "query_id", "rank", "vec_id", "score")
    assert got == brute_top(rows, asked)


def test_blocks_of_queries_and_large_numbers(spark, monkeypatch):
    monkeypatch.setattr(K, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=4) * 10.0 ** int(rng.integers(0, 4))).tolist()) for i in range(120)]
    rows += [(200, [2e5, -3e5, 1e5, 4e5])]  # products beyond 2**53 in all
    table = vectors(spark, rows)
    got = rows_of(K.top_k(table, table.where("vec_id % 5 = 0"), k=4), "query_id", "rank", "vec_id", "score")
    assert got == brute_top(rows, set(range(0, 1000, 5)), 4)


def test_no_vectors(spark):
    none = vectors(spark, [(1, None)])
    assert K.top_k(none, none).count() == 0
    one = vectors(spark, [(100, [1.0, 0.0])])
    assert K.top_k(one, one).count() == 0
