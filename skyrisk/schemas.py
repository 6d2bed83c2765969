"""Schemas and fixed values.

The values in the "fixed values" block must equal the reference application's for the same
results (feature lists, weights, thresholds, densities, bounds).  They are stated plainly.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must match the reference application's behaviour)
# ---------------------------------------------------------------------------
DENSITY_KG_M3 = 2600.0
MANUAL_WEIGHTS = (0.4, 0.4, 0.2)
RISK_EPS = 1e-12                      # inverse miss-distance guard in risk scoring
FEATURE_EPS = 1e-5                    # inverse miss-distance guard in feature engineering
PSI_EPS = 1e-12                       # proportion floor in PSI / chi-square expected floor
PSI_WARN = 0.10
PSI_ALERT = 0.20
CHI2_ALPHA = 0.05
NUMERIC_BUCKETS = 10
RISK_BREAKS = (0.2, 0.5, 0.8)         # <= 0.2 Very Low, <= 0.5 Low, <= 0.8 Medium, else High
RISK_LABELS = ("Very Low Risk", "Low Risk", "Medium Risk", "High Risk")
ISCLOSE_ATOL = 1e-8
ISCLOSE_RTOL = 1e-5
DROP_COLUMNS = ["id", "name", "close_approach_date", "close_approach_date_full", "nasa_jpl_url",
                "orbiting_body", "max_diameter_km", "min_diameter_km"]
FEATURE_COLUMNS = ["absolute_magnitude_h", "epoch_date_close_approach", "relative_velocity_kps",
                   "miss_distance_km", "is_sentry_object", "diameter_range", "est_mass_kg",
                   "est_kinetic_energy_j", "inv_miss_dist", "impact_risk_index"]
TARGET_COLUMN = "is_potentially_hazardous"
CATEGORICAL_COLUMNS = ["is_sentry_object"]
NUMERIC_COLUMNS = ["absolute_magnitude_h", "epoch_date_close_approach", "relative_velocity_kps",
                   "miss_distance_km", "diameter_range", "est_mass_kg", "est_kinetic_energy_j",
                   "inv_miss_dist", "impact_risk_index"]
ORBIT_MISS_MIN_KM = 6599.0
ORBIT_MISS_MAX_KM = 74794677.0
ORBIT_RADIUS_MIN = 3.0
ORBIT_RADIUS_MAX = 48.0
ORBIT_SIZE_MIN = 0.015
ORBIT_SIZE_MAX = 1.25
ORBIT_SPEED = 0.00012
ORBIT_DEFAULT_VELOCITY = 20.0
RADAR_MAX_VELOCITY_KPS = 66.0
RADAR_MAX_DIAMETER_KM = 2.0
RADAR_MAX_MISS_KM = 75e6
RADAR_PROB_FALLBACK = (0.8, 0.1)      # hazardous, not hazardous
EARTH_DIAMETER_KM = 12742.0
BADGE_THRESHOLD = 0.5
PAGE_LIMIT_RANGE = (1, 1000)
TOP_RANGE = (10, 1000)
COMPARE_CAP = 6
# leaderboards: ranked column and direction, nulls last
BOARDS = {
    "risk": ("risk_score_manual", "DESC"),
    "velocity": ("relative_velocity_kps", "DESC"),
    "closest": ("miss_distance_km", "ASC"),
    "size": ("max_diameter_km", "DESC"),
}
ALERT_SLOTS = 10
ALERT_PAD = "—"
NAME_SHORTEN_AT = 20
NAME_SHORT_KEEP = 18
NEW_ASTEROID_EVENT = "new_asteroid"
# training defaults
SPLIT_TEST_SIZE = 0.2
SEED = 42
SMOTE_K = 5
TUNE_TRIALS = 10
TUNE_FOLDS = 3
STACK_FOLDS = 5
META_TREES = 100
# ---------------------------------------------------------------------------

APPROACH_COLUMNS = ["id", "name", "absolute_magnitude_h", "min_diameter_km", "max_diameter_km",
                    "close_approach_date", "close_approach_date_full", "epoch_date_close_approach",
                    "relative_velocity_kps", "miss_distance_km", "orbiting_body",
                    "is_potentially_hazardous", "is_sentry_object", "nasa_jpl_url"]

APPROACH = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("absolute_magnitude_h", T.DoubleType()),
    T.StructField("min_diameter_km", T.DoubleType()),
    T.StructField("max_diameter_km", T.DoubleType()),
    T.StructField("close_approach_date", T.StringType()),
    T.StructField("close_approach_date_full", T.StringType()),
    T.StructField("epoch_date_close_approach", T.LongType()),
    T.StructField("relative_velocity_kps", T.DoubleType()),
    T.StructField("miss_distance_km", T.DoubleType()),
    T.StructField("orbiting_body", T.StringType()),
    T.StructField("is_potentially_hazardous", T.BooleanType()),
    T.StructField("is_sentry_object", T.BooleanType()),
    T.StructField("nasa_jpl_url", T.StringType()),
])

PREDICTION = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("actual", T.BooleanType()),
    T.StructField("model_prediction", T.BooleanType()),
    T.StructField("probability_being_falsely_hazardous", T.DoubleType()),
    T.StructField("probability_being_truely_hazardous", T.DoubleType()),
    T.StructField("trained_model_date_used", T.StringType()),
])

RISK = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("davg_m", T.DoubleType()),
    T.StructField("mass_kg", T.DoubleType()),
    T.StructField("impact_energy_j", T.DoubleType()),
    T.StructField("Enorm", T.DoubleType()),
    T.StructField("Rmoid_norm", T.DoubleType()),
    T.StructField("Phazardous", T.DoubleType()),
    T.StructField("RiskScore_raw", T.DoubleType()),
    T.StructField("RiskScorenormManual", T.DoubleType()),
    T.StructField("RiskCategoryManual", T.StringType()),
    T.StructField("RiskScorenormDDriven", T.DoubleType()),
    T.StructField("RiskCategoryDDriven", T.StringType()),
    T.StructField("risk_analysed_on_date", T.DateType()),
])

DRIFT = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("feature", T.StringType()),
    T.StructField("feature_type", T.StringType()),
    T.StructField("method", T.StringType()),
    T.StructField("psi", T.DoubleType()),
    T.StructField("chi2_stat", T.DoubleType()),
    T.StructField("chi2_p_value", T.DoubleType()),
    T.StructField("chi2_alpha", T.DoubleType()),
    T.StructField("drift_status", T.StringType()),
    T.StructField("baseline_count", T.LongType()),
    T.StructField("new_count", T.LongType()),
    T.StructField("created_at", T.TimestampType()),
])

TRAINING_LOG = T.StructType([
    T.StructField("model_name", T.StringType()),
    T.StructField("training_date", T.StringType()),
    T.StructField("accuracy", T.DoubleType()),
    T.StructField("precision", T.DoubleType()),
    T.StructField("recall", T.DoubleType()),
    T.StructField("f1_score", T.DoubleType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("artifact_uri", T.StringType()),
])

ARTIFACT = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("artifact", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
])

# Nested feed document: {"near_earth_objects": {date: [asteroid, ...]}}
CLOSE_APPROACH = T.StructType([
    T.StructField("close_approach_date", T.StringType()),
    T.StructField("close_approach_date_full", T.StringType()),
    T.StructField("epoch_date_close_approach", T.LongType()),
    T.StructField("relative_velocity", T.StructType([T.StructField("kilometers_per_second", T.StringType())])),
    T.StructField("miss_distance", T.StructType([T.StructField("kilometers", T.StringType())])),
    T.StructField("orbiting_body", T.StringType()),
])

FEED_ASTEROID = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("absolute_magnitude_h", T.DoubleType()),
    T.StructField("estimated_diameter", T.StructType([
        T.StructField("kilometers", T.StructType([
            T.StructField("estimated_diameter_min", T.DoubleType()),
            T.StructField("estimated_diameter_max", T.DoubleType()),
        ])),
    ])),
    T.StructField("is_potentially_hazardous_asteroid", T.BooleanType()),
    T.StructField("is_sentry_object", T.BooleanType()),
    T.StructField("nasa_jpl_url", T.StringType()),
    T.StructField("close_approach_data", T.ArrayType(CLOSE_APPROACH)),
])

FEED = T.StructType([
    T.StructField("near_earth_objects", T.MapType(T.StringType(), T.ArrayType(FEED_ASTEROID))),
])
