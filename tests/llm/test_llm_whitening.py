"""Whitening: the components against a dense eigensolver, sums in whole numbers, and the defined cases."""

import math

import numpy as np
import pytest

from llm_fixtures import CLASH, rows_of
from pyspark.sql import functions as F

from skyrisk.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(f"x-{c}") for c in CLASH}).repartition(5)


def vectors(seed=3, n=300, d=12):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) @ np.diag(np.linspace(0.2, 2, d)) @ rng.normal(size=(d, d))
    return [(i, [float(np.float32(v)) for v in row]) for i, row in enumerate(x)]


def brute(rows):
    x = np.array([[math.floor(1024 * v) + 100000 for v in row] for _, row in rows])
    n, s = len(x), x.sum(0)
    c = x - s / n
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    return x, n, s, c, v, e[::-1], u[:, ::-1]


@pytest.mark.parametrize("d", [1, 2, 3, 12, 40])
def test_whitening_equals_a_dense_solver(spark, d):
    rows = vectors(n=200, d=d)
    bad = [(900, None), (901, []), (902, [1.0] * (d + 1)), (903, [float("nan")] * d), (904, [float("inf")] * d), (905, [None] * d), (None, rows[4][1]), rows[0]]
    kept = [*rows, (None, rows[4][1]), rows[0]]
    x, n, s, c, v, e, u = brute(kept)
    got = W.whiten(frame(spark, rows + bad)).collect()
    k = min(8, d)
    assert len(got) == len(kept) * k
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    first = u[:, :k] * np.sign(u[np.abs(u[:, :k]).argmax(0), np.arange(k)])
    want = c @ first / np.sqrt(e[:k])
    for (i, _), xi, wi in zip(kept, x, want, strict=True):
        exact = sum((n * int(a) - int(b)) ** 2 for a, b in zip(xi, s, strict=True))
        for j in range(k):
            r = by[i][j + 1][0]
            assert r.n == n and r.deviation == exact
            assert r.explained == pytest.approx(e[j] / np.trace(v), rel=1e-9)
            assert r.whitened == pytest.approx(wi[j], abs=1e-6)
            assert r.identity_error < 1e-9


def test_close_and_equal_eigenvalues():
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.normal(size=(30, 30)))
    for e in (np.r_[[5.0] * 4, 5 - 1e-12, 4.9999, np.linspace(1, 2, 24)], np.r_[[1.0] * 30], np.r_[3.0, 1.0, np.zeros(28)], np.geomspace(1e8, 1e-8, 30)):
        v = q @ np.diag(e) @ q.T
        v = (v + v.T) / 2
        values, vectors = W.leading_components(v)
        k = len(values)
        assert k == min(8, int((e > 1e-9 * e.sum()).sum())) or e[0] == 1e8
        assert np.allclose(values, np.sort(e)[::-1][:k], rtol=1e-9, atol=1e-12 * e.max())
        assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12
        assert np.abs(v @ vectors - vectors * values).max() < 1e-12 * e.max() * 30
    for v in (np.diag([3.0, 2.0, 1.0]), np.zeros((3, 3)), np.array([[2.0]]), np.array([[1.0, 1.0], [1.0, 1.0]])):
        values, vectors = W.leading_components(v)
        assert np.allclose(v @ vectors, vectors * values)


def test_sturm_counts_and_bisection():
    rng = np.random.default_rng(2)
    d, e = rng.normal(size=20), rng.normal(size=19)
    full = np.linalg.eigvalsh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))
    at = np.linspace(-4, 4, 17)
    assert (W.sturm_counts(d, e, at) == [(full < x).sum() for x in at]).all()
    assert np.allclose(W.leading_eigenvalues(d, e, 8), full[::-1][:8], rtol=0, atol=1e-13)


def test_no_variance_and_empty_tables(spark):
    assert W.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    assert W.whiten(frame(spark, [])).collect() == []
    assert W.whiten(frame(spark, [(1, None), (2, [])])).collect() == []
    one = W.whiten(frame(spark, [(1, [0.0, 0.0]), (2, [1.0, 0.0])])).collect()
    assert sorted((r.vec_id, r.component, abs(round(r.whitened, 9)), r.deviation) for r in one) == [(1, 1, 1.0, 1048576), (2, 1, 1.0, 1048576)]


def test_deviation_past_64_bits_is_null_and_others_stay_exact(spark):
    rows = [(0, [1e9, 0.0]), (1, [-1e9, 1.0]), *[(i, [0.0, float(i % 3)]) for i in range(2, 60)]]
    got = {r.vec_id: r.deviation for r in W.whiten(frame(spark, rows), components=1).collect()}
    x, n, s, *_ = brute([(i, [float(np.float32(a)) for a in v]) for i, v in rows])
    exact = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(xi, s, strict=True)) for xi in x]
    assert got[0] is None and got[5] == exact[5]


def test_partitions_do_not_matter(spark):
    rows = vectors(n=120, d=6)
    a, b = (rows_of(W.whiten(spark.createDataFrame(rows, SCHEMA).repartition(k)).withColumn("w", F.round("whitened", 7)), "vec_id", "component", "deviation", "w") for k in (1, 9))
    assert a == b
