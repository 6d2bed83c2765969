import numpy as np
import pytest

from skyrisk.functions import quantiles as Q
from skyrisk.operators import drift as D


@pytest.fixture
def narrowed(monkeypatch):
    """Narrow from fifty rows on; the rows that are still sorted, by call."""
    monkeypatch.setattr(Q, "NARROW_ROWS", 50)
    monkeypatch.setattr(Q, "PIVOTS", 40)
    ranked, rows = Q.ranked_values, []

    def seen(*a, **kw):
        out = ranked(*a, **kw)
        rows.append(out.count())
        return out

    monkeypatch.setattr(Q, "ranked_values", seen)
    return rows


def test_quantiles_sort_only_the_intervals_they_need(spark, narrowed):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=4000), np.repeat([-0.0, 0.0, 1.0, np.inf, -np.inf], [300, 200, 400, 50, 50])
    rows = [("a", float(x)) for x in a] + [("b", float(x)) for x in b] + [("a", None), ("one", 7.0)]
    df = spark.createDataFrame(rows, "feature string, value double").repartition(3)
    qs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {(r.feature, r.q): r.quantile for r in Q.exact_quantiles(df, ["feature"], "value", qs).collect()}
    assert narrowed and narrowed[0] < 1500
    for q in qs:
        assert got["a", q] == pytest.approx(np.quantile(a, q), abs=1e-12)
        assert got["b", q] == sorted(b.tolist())[int(q * 999)] or got["b", q] == pytest.approx(np.quantile(b, q))
        assert got["one", q] == 7.0


def test_order_statistics_of_counts_and_long_keys(spark, narrowed):
    big = 1 << 59
    df = spark.createDataFrame([("x", big + i, 1 + i % 3) for i in range(400)], "g string, v long, n long")
    flat = [big + i for i in range(400) for _ in range(1 + i % 3)]
    want = spark.createDataFrame([("x", p) for p in (0, 7, 399, len(flat) - 1, len(flat))], "g string, pos long")
    got = {r.pos: r.value for r in Q.order_statistics(df, ["g"], "v", want, count_col="n").collect()}
    assert got == {p: flat[p] for p in (0, 7, 399, len(flat) - 1)} | {len(flat): None} and narrowed


def test_drift_report_is_the_same_when_narrowed(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = spark.createDataFrame([(float(x), bool(x > 0), None) for x in rng.normal(size=600)], "x double, f boolean, z double")
    new = spark.createDataFrame([(float(x), bool(x > 0), 1.0) for x in rng.normal(0.5, size=300)], "x double, f boolean, z double")

    def report():
        return sorted((r.feature, r.method, round(r.psi, 9), r.baseline_count, r.new_count, r.drift_status) for r in D.drift_report(base, new, "r", "2000-01-01 00:00:00").collect())

    before = report()
    monkeypatch.setattr(Q, "NARROW_ROWS", 50)
    assert report() == before and [x[0] for x in before] == ["f", "x"] and before[1][3:5] == (600, 300)
