"""Golden values for features, physics and risk (FIXTURES.md 3.1, 3.2)."""

import math

import pytest
from pyspark.sql import functions as F

from skyrisk.functions.columns import risk_category
from skyrisk.operators.features import engineered_features, skew_transform
from skyrisk.operators.physics import physical_metrics
from skyrisk.operators.risk import clamp_probability, composite_risk, manual_weights, risk_minmax
from skyrisk.schemas import APPROACH

ROWS = [
    (2085990, "85990 (1999 JV6)", 20.27, 0.234723, 0.524856, "2015-01-05", "2015-Jan-05 11:16", 1420456560000,
     7.694743, 1.246329e7, "Earth", True, False, "u1"),
    (2523915, "523915 (1997 VM4)", 18.57, 0.513517, 1.148259, "2015-01-05", "2015-Jan-05 11:56", 1420458960000,
     16.169622, 5.815821e7, "Earth", False, False, "u2"),
]


@pytest.fixture()
def sample(spark):
    return spark.createDataFrame(ROWS, APPROACH)


def rel(a, b, tol):
    return abs(a - b) <= tol * max(abs(a), abs(b))


def test_engineered_features(sample):
    out = engineered_features(sample).orderBy("absolute_magnitude_h", ascending=False).collect()
    exp = [
        (0.3797895, 74576299770.28706, 2.2077966706065254e18, 8.023563601578697e-08, 25.900228629070895),
        (0.830888, 780907206336.5035, 1.020867010693479e20, 1.719447692767415e-08, 28.193676523057494),
    ]
    for r, e in zip(out, exp):
        got = (r.diameter_range, r.est_mass_kg, r.est_kinetic_energy_j, r.inv_miss_dist, r.impact_risk_index)
        for g, x in zip(got, e):
            assert rel(g, x, 1e-12), (g, x)
    assert "id" not in engineered_features(sample).columns


def test_skew_transform(sample):
    out = skew_transform(engineered_features(sample)).orderBy("absolute_magnitude_h", ascending=False).collect()
    exp = [(-0.9681381271156547, 2.040537368422515, 3530.3385106813766),
           (-0.18526027058663033, 2.7831342966924013, 7626.153027575568)]
    for r, e in zip(out, exp):
        for g, x in zip((r.diameter_range, r.relative_velocity_kps, r.miss_distance_km), e):
            assert rel(g, x, 1e-12)


def test_physical_metrics_units(sample):
    out = physical_metrics(sample, diameter_unit="km", velocity_unit="km/s").orderBy("id").collect()
    assert rel(out[0].mass_kg, 74576299770.28706 * 1.0, 1e-9)
    assert rel(out[0].impact_energy_j, 2.2077966706065254e18, 1e-9)
    with pytest.raises(ValueError):
        physical_metrics(sample, diameter_unit="ft")
    with pytest.raises(ValueError):
        physical_metrics(sample, velocity_unit="mph")


def test_risk_two_rows(spark, sample):
    df = sample.withColumn("probability_being_truely_hazardous",
                           F.when(F.col("id") == 2085990, F.lit(0.9)).otherwise(F.lit(0.3)))
    norm = clamp_probability(risk_minmax(physical_metrics(df, diameter_unit="km", velocity_unit="km/s")))
    out = composite_risk(norm, manual_weights((0.4, 0.4, 0.2))).orderBy("id").collect()
    assert [r.Enorm for r in out] == [0.0, 1.0]
    assert [r.Rmoid_norm for r in out] == [1.0, 0.0]
    assert [round(r.RiskScore_raw, 12) for r in out] == [0.58, 0.46]
    assert [r.RiskScorenorm for r in out] == [1.0, 0.0]
    assert [r.RiskCategory for r in out] == ["High Risk", "Very Low Risk"]


def test_risk_single_row_is_zero(spark, sample):
    df = sample.limit(1).withColumn("probability_being_truely_hazardous", F.lit(0.5))
    norm = clamp_probability(risk_minmax(physical_metrics(df, diameter_unit="km", velocity_unit="km/s")))
    r = composite_risk(norm, manual_weights()).collect()[0]
    assert r.RiskScorenorm == 0.0 and r.RiskCategory == "Very Low Risk"


def test_risk_category_edges(spark):
    df = spark.createDataFrame([(0.2,), (0.5,), (0.8,), (None,), (float("nan"),), (-1.0,), (0.81,)], "s double")
    got = [r.c for r in df.select(risk_category("s").alias("c")).collect()]
    assert got == ["Very Low Risk", "Low Risk", "Medium Risk", "High Risk", "High Risk", "Very Low Risk", "High Risk"]


def test_manual_weights_validation():
    assert manual_weights((2, 2, 1)) == (0.4, 0.4, 0.2)
    with pytest.raises(ValueError):
        manual_weights((-1, 1, 1))
    with pytest.raises(ValueError):
        manual_weights((0, 0, 0))


def test_clamp_probability(spark):
    df = spark.createDataFrame([(1, -0.5), (2, 1.5), (3, 0.25), (4, None)],
                               "id long, probability_being_truely_hazardous double")
    got = {r.id: r.Phazardous for r in clamp_probability(df).collect()}
    assert got == {1: 0.0, 2: 1.0, 3: 0.25, 4: None}
    with pytest.raises(ValueError):
        clamp_probability(df.drop("probability_being_truely_hazardous"))


def test_data_driven_weights_sum_to_one(spark, sample):
    from skyrisk.operators.risk import data_driven_weights

    rows = [(float(i % 7) / 7, float(i % 5) / 5, float(i % 3) / 3, i % 2 == 0) for i in range(60)]
    df = spark.createDataFrame(rows, "Enorm double, Rmoid_norm double, Phazardous double, is_hazardous boolean")
    w = data_driven_weights(df)
    assert math.isclose(sum(w), 1.0) and all(x >= 0 for x in w)
    single = df.withColumn("is_hazardous", F.lit(True))
    assert data_driven_weights(single) == pytest.approx((1 / 3, 1 / 3, 1 / 3))
    with pytest.raises(ValueError):
        data_driven_weights(df, label_col="missing")
