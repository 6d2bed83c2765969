"""Drift golden cases (FIXTURES.md 3.3) and properties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyrisk.functions.quantiles import exact_quantiles
from skyrisk.functions.special import chi2_sf_numpy
from skyrisk.operators.drift import (baseline_edges, categorical_long, categorical_stats, drift_report,
                                     histogram_on_edges, numeric_long, psi_numeric)


def num(spark, values):
    return numeric_long(spark.createDataFrame([(float(v),) for v in values], "x double"), ["x"])


def cat(spark, values):
    return categorical_long(spark.createDataFrame([(v,) for v in values], "x string"), ["x"])


@pytest.mark.parametrize("base,new,psi", [
    (range(1, 21), range(5, 25), 5.110315914799085),
    ([0] * 8 + [1] * 2, [0] * 5 + [1] * 5, 0.41588830833596724),
    ([7] * 4, [7, 8], 0.0),
    ([7] * 4, [8, 9], 27.631021115900918),
])
def test_psi_numeric_golden(spark, base, new, psi):
    got = psi_numeric(num(spark, base), num(spark, new)).collect()[0].psi
    assert got == pytest.approx(psi, rel=1e-9, abs=1e-12)


def test_histogram_counts_p1_and_p3(spark):
    b = num(spark, range(1, 21))
    e = baseline_edges(b)
    counts = {r.bin: r["count"] for r in histogram_on_edges(num(spark, range(5, 25)), e).collect()}
    assert [counts.get(i, 0) for i in range(10)] == [0, 0] + [2] * 8
    b3 = num(spark, [7] * 4)
    e3 = baseline_edges(b3)
    assert e3.collect()[0].edges == [7.0, 7.0, 7.0]
    c3 = {r.bin: r["count"] for r in histogram_on_edges(b3, e3).collect()}
    assert c3 == {1: 4}


def test_categorical_golden(spark):
    c1 = categorical_stats(cat(spark, ["a"] * 50 + ["b"] * 50), cat(spark, ["a"] * 30 + ["b"] * 70)).collect()[0]
    assert c1.psi == pytest.approx(0.16945957207744072, rel=1e-12)
    assert c1.chi2_stat == pytest.approx(16.0) and c1.dof == 1
    assert chi2_sf_numpy([c1.chi2_stat], [1])[0] == pytest.approx(6.334248366623977e-05, rel=1e-9)
    c2 = categorical_stats(cat(spark, ["a"] * 50 + ["b"] * 50),
                           cat(spark, ["a"] * 40 + ["b"] * 50 + ["c"] * 10)).collect()[0]
    assert c2.psi == pytest.approx(2.5551579573995427, rel=1e-12)
    assert c2.chi2_masked == pytest.approx(2.0)
    assert c2.chi2_stat > 1e13
    assert chi2_sf_numpy([c2.chi2_stat], [2])[0] == 0.0


def test_chi2_sf_against_closed_forms():
    x = np.array([0.5, 1.0, 3.84, 10.0, 40.0])
    # df = 2: exp(-x/2)
    assert np.allclose(chi2_sf_numpy(x, np.full(5, 2.0)), np.exp(-x / 2), rtol=1e-12)
    # df = 4: exp(-x/2) (1 + x/2)
    assert np.allclose(chi2_sf_numpy(x, np.full(5, 4.0)), np.exp(-x / 2) * (1 + x / 2), rtol=1e-12)
    assert np.isnan(chi2_sf_numpy([1.0], [0.0])[0])


def test_drift_report_status_and_p(spark):
    base = spark.createDataFrame([(float(i), "a" if i < 50 else "b") for i in range(100)], "v double, c string")
    new = spark.createDataFrame([(float(i), "a" if i < 30 else "b") for i in range(100)], "v double, c string")
    rows = {r.feature: r for r in drift_report(base, new, "r1", "2024-01-01 00:00:00").collect()}
    assert rows["v"].drift_status == "No Drift" and rows["v"].method == "psi"
    assert rows["c"].method == "psi+chi2"
    assert rows["c"].chi2_p_value == pytest.approx(6.334248366623977e-05, rel=1e-9)
    assert rows["c"].drift_status == "High Drift (chi2)"
    assert rows["c"].baseline_count == 100 and rows["c"].new_count == 100
    # identical data -> PSI 0, no p-value branch
    same = {r.feature: r for r in drift_report(base, base, "r2", "2024-01-01 00:00:00", with_p_value=False).collect()}
    assert same["v"].psi == pytest.approx(0.0, abs=1e-15) and same["c"].method == "psi"


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(7)
    rows = [("a", float(v)) for v in rng.integers(0, 30, 500)] + [("b", float(v)) for v in rng.normal(size=333)]
    df = spark.createDataFrame(rows, "feature string, value double").repartition(7)
    qs = [i / 10 for i in range(11)] + [0.25, 0.333]
    out = exact_quantiles(df, ["feature"], "value", qs).collect()
    for f in ("a", "b"):
        vals = np.array([v for g, v in rows if g == f])
        got = [r.quantile for r in sorted([r for r in out if r.feature == f], key=lambda r: r.q_index)]
        assert np.allclose(got, np.quantile(vals, qs), rtol=1e-12, atol=1e-12)


def test_psi_sf001_cutoff_golden(spark):
    """PSI on the fact table at sf0.01 with cutoff 2000-07-01 (FIXTURES.md 3.3)."""
    from conftest import SF001
    from skyrisk.sources.fixtures import approaches

    a = approaches(spark, SF001).withColumn("spread", F.col("max_diameter_km") - F.col("min_diameter_km"))
    d = F.to_date("close_approach_date")
    cols = ["absolute_magnitude_h", "epoch_date_close_approach", "relative_velocity_kps", "miss_distance_km", "spread"]
    b = numeric_long(a.where(d < "2000-07-01"), cols)
    n = numeric_long(a.where(d >= "2000-07-01"), cols)
    got = {r.feature: r.psi for r in psi_numeric(b, n).collect()}
    exp = {"absolute_magnitude_h": 0.0005177849651967901, "epoch_date_close_approach": 25.328436027821716,
           "relative_velocity_kps": 0.0009281690121061325, "miss_distance_km": 0.0009346615661232665,
           "spread": 0.0005177849651967901}
    for k, v in exp.items():
        assert got[k] == pytest.approx(v, rel=1e-9), k


def test_profile_gives_the_report_and_reads_new_weeks_only(spark, tmp_dir):
    import datetime as dt

    from conftest import SF0001
    from pyspark.sql import functions as F

    from skyrisk.catalog import appr, logs
    from skyrisk.operators import profile as P
    from skyrisk.operators.explore import training_cutoff
    from skyrisk.plans.jobs import drift_rows
    from skyrisk.sources.ledger import Ledger
    from skyrisk.sources.weeks import folder_weeks, write_weeks

    a, log = appr(spark, SF0001), logs(spark, SF0001)
    fact, profile, ledger = f"{tmp_dir}/fact", f"{tmp_dir}/profile", f"{tmp_dir}/ledger"
    split = F.col("close_approach_date") < "1999-01-04"  # a Monday
    write_weeks(a.where(split), fact)
    first = P.update_profile(spark, fact, profile, ledger)
    assert first == folder_weeks(spark, fact) and P.update_profile(spark, fact, profile, ledger) == []
    write_weeks(a.where(~split), fact)
    # what the second update must not read is taken away
    late = a.where(~split)
    rows = []
    real = P.profile_rows
    P.profile_rows = lambda df: rows.append(df) or real(df)
    try:
        second = P.update_profile(spark, fact, profile, ledger)
    finally:
        P.profile_rows = real
    assert set(second) == set(folder_weeks(spark, fact)) - set(first) and min(second) > max(first)
    read = {r.f for r in rows[0].select(F.input_file_name().alias("f")).distinct().collect()}
    assert rows[0].count() == late.count() and all(dt.date.fromisoformat(f.split("approach_week=")[1][:10]) in set(second) for f in read)
    cutoff = training_cutoff(log).first()["model_last_trained"]
    shown = lambda df: sorted((r.feature, r.feature_type, r.method, round(r.psi, 12), r.drift_status, r.baseline_count, r.new_count,
                               None if r.chi2_p_value is None else round(r.chi2_p_value, 12)) for r in df.collect())
    at = "2000-06-21 00:00:00"
    want = shown(drift_rows(a, log, "r", at))
    assert shown(P.drift_from_profile(spark, profile, ledger, cutoff, "r", at)) == want and len(want) == 7
    # rows that arrive late for a known week: its run is made anew
    week = second[-1]
    extra = a.where(F.col("close_approach_date") == late.agg(F.max("close_approach_date")).first()[0]).limit(1)
    write_weeks(extra, fact)
    assert week in P.update_profile(spark, fact, profile, ledger, again=[week])
    assert week in P.update_profile(spark, fact, profile, ledger, again=[week])
    want = shown(drift_rows(a.unionByName(extra), log, "r", at))
    assert shown(P.drift_from_profile(spark, profile, ledger, cutoff, "r", at)) == want
    assert Ledger(spark, ledger).runs().count() == 2
