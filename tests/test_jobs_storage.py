"""Sinks, storage folder, pruning and numeric edges."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF0001
from skyrisk.catalog import appr, logs
from skyrisk.functions.special import chi2_sf_numpy
from skyrisk.operators import explore as X
from skyrisk.operators import risk as R
from skyrisk.operators.features import impute_median, one_hot
from skyrisk.session import checkpoint_dir
from skyrisk.sources.ingest import append_both, append_table


def test_dedupe_keys_inside_a_batch_and_null_keys(spark, tmp_dir):
    path = f"{tmp_dir}/t"
    batch = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (None, "d"), (2, "e")], "id long, v string")
    assert append_table(batch, path, ["id"]) == 3
    assert append_table(batch, path, ["id"]) == 0
    assert append_table(spark.createDataFrame([(2, "x"), (3, "y")], "id long, v string"), path, ["id"]) == 1
    assert sorted((r.id or 0) for r in spark.read.parquet(path).collect()) == [0, 1, 2, 3]
    assert append_table(batch, path) == 5  # never de-duplicates unless asked


def test_both_tables_get_the_same_rows(spark, tmp_dir):
    rows = spark.range(50).withColumn("r", F.rand())
    assert append_both(rows, f"{tmp_dir}/a", f"{tmp_dir}/b") == 50
    assert sorted(spark.read.parquet(f"{tmp_dir}/a").collect()) == sorted(spark.read.parquet(f"{tmp_dir}/b").collect())


class _Context:
    """Stands in for a cluster's context without a checkpoint folder."""

    master = "spark://host:7077"

    def getCheckpointDir(self):  # noqa: N802
        return None

    def getConf(self):  # noqa: N802
        return {}


def test_no_local_folder_off_a_local_master():
    session = type("S", (), {"sparkContext": _Context(), "conf": type("C", (), {"get": lambda self, k, d=None: d})()})()
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(session)


def test_dates_are_pushed_to_a_stored_table(spark, tmp_dir):
    appr(spark, SF0001).write.parquet(f"{tmp_dir}/fact")
    fact = spark.read.parquet(f"{tmp_dir}/fact")
    for df in (X.week_window(fact, "2000-07-01"), X.baseline_split(fact, logs(spark, SF0001))[0]):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters" in plan and "GreaterThanOrEqual(close_approach_date" in plan or "LessThan(close_approach_date" in plan
        assert "NestedLoop" not in plan


def test_risk_readers_scan_the_fact_table_few_times(spark):
    import __spark_entry__ as E

    for name, most in (("leaderboard_risk", 4), ("job_weekly_alert", 8)):
        plan = E.queries()[name](spark, SF0001)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("l_orderkey") // 2 <= 4 * most


def test_hot_id_fans_out_fully(spark):
    facts = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS id", "id AS n")
    preds = spark.createDataFrame([("7", 0.1), ("7", 0.2), ("8", 0.3)], "id string, probability_being_truely_hazardous double")
    assert X.join_predictions(facts, preds).count() == 2 * (facts.where("id = 7").count()) + facts.where("id = 8").count()


def test_risk_minmax_with_nulls_and_infinities(spark):
    rows = [(1, 5.0, 10.0), (2, float("inf"), 20.0), (3, None, None), (4, 15.0, float("inf")), (5, float("nan"), 40.0)]
    got = {r.id: (r.Enorm, r.Rmoid_norm) for r in R.risk_minmax(spark.createDataFrame(rows, "id long, impact_energy_j double, miss_distance_km double")).collect()}
    energy = np.array([5.0, 0, 0, 15.0, 0])
    miss = 1 / (np.array([10.0, 20, 40, 40, 40]) + 1e-12)
    for k, e, m in zip(range(1, 6), energy / 15, (miss - miss.min()) / (miss.max() - miss.min())):
        assert got[k] == pytest.approx((e, m))


def test_clamp_and_impute_edges(spark):
    rows = [(1, -0.5), (2, 1.7), (3, None), (4, float("nan")), (5, 0.25)]
    got = {r.id: r.Phazardous for r in R.clamp_probability(spark.createDataFrame(rows, "id long, probability_being_truely_hazardous double")).collect()}
    assert got[1] == 0 and got[2] == 1 and got[3] is None and math.isnan(got[4]) and got[5] == 0.25
    vals = spark.createDataFrame([(1.0,), (None,), (float("inf"),), (3.0,), (8.0,), (float("-inf"),)], "x double")
    assert sorted(r.x for r in impute_median(vals, ["x"]).collect()) == [1.0, 3.0, 3.0, 3.0, 3.0, 8.0]


def test_data_driven_weights_match_newton(spark):
    rng = np.random.default_rng(5)
    x = rng.random((400, 3))
    y = (x @ [2.0, -1.0, 3.0] + rng.normal(size=400) * 0.5 > 2).astype(float)
    df = spark.createDataFrame([(*map(float, r), bool(t)) for r, t in zip(x, y)], "Enorm double, Rmoid_norm double, Phazardous double, is_hazardous boolean")
    got = R.weights(df, "data-driven")
    z, w = np.c_[x, np.ones(400)], np.zeros(4)
    for _ in range(60):  # minimises |w|^2 / 2 + sum of losses, the intercept free
        p = 1 / (1 + np.exp(-z @ w))
        ridge = np.diag([1.0, 1, 1, 0])
        w -= np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge, z.T @ (p - y) + ridge @ w)
    assert got == pytest.approx(np.abs(w[:3]) / np.abs(w[:3]).sum(), abs=1e-5)


def test_chi_square_tail_for_many_categories():
    for dof in (2_000, 200_000, 2_000_000):
        a = dof / 2
        assert chi2_sf_numpy([dof], [dof])[0] == pytest.approx(0.5 - 1 / (3 * math.sqrt(2 * math.pi * a)), abs=1e-6)
    assert chi2_sf_numpy([3.84145882069], [1])[0] == pytest.approx(0.05, abs=1e-9)
    assert chi2_sf_numpy([220_000], [200_000])[0] < 1e-100
    assert np.isnan(chi2_sf_numpy([1.0], [0])[0])


def test_too_many_categories_raise(spark, monkeypatch):
    from skyrisk.operators import features

    monkeypatch.setattr(features, "MAX_CATEGORIES", 3)
    with pytest.raises(ValueError, match="categories"):
        one_hot(spark.range(10).withColumn("c", F.col("id").cast("string")), "c")
