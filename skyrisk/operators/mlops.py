"""Model-history and drift-history views (training log and drift tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyrisk.functions.columns import psi_status  # noqa: F401  (re-exported for callers)

METRICS = ["accuracy", "precision", "recall", "f1_score"]


def latest_model(logs: DataFrame) -> DataFrame:
    """Newest training row (training_date text compares as ISO text)."""
    return logs.orderBy(F.desc_nulls_last("training_date"), F.asc("model_name")).limit(1)


def model_history(logs: DataFrame) -> DataFrame:
    return logs.orderBy(F.desc_nulls_last("training_date"), F.asc("model_name"))


def model_metrics_pct(logs: DataFrame) -> DataFrame:
    """Newest training row with the four metrics x 100."""
    return latest_model(logs).select("model_name", "training_date",
                                     *[(F.col(m) * F.lit(100.0)).alias(f"{m}_pct") for m in METRICS])


def model_versions(logs: DataFrame) -> DataFrame:
    """Oldest first, labelled v1..vn, metrics x 100 rounded to 2 dp.  The training log holds one
    row per training run (tens of rows), so a single ordered window over it is bounded."""
    w = Window.orderBy(F.asc_nulls_first("training_date"), F.asc("model_name"))
    return logs.select(
        F.concat(F.lit("v"), F.row_number().over(w).cast("string")).alias("version"),
        "model_name", F.substring("training_date", 1, 10).alias("trained_on"),
        *[F.round(F.col(m) * F.lit(100.0), 2).alias(f"{m}_pct") for m in METRICS])


def drift_history(drift: DataFrame) -> DataFrame:
    cols = ["run_id", "feature", "feature_type", "method", "psi", "chi2_stat", "chi2_p_value", "drift_status",
            "baseline_count", "new_count", "created_at"]
    return drift.select(*cols).orderBy(F.desc_nulls_first("created_at"), F.asc("feature"))


def newest_run(drift: DataFrame) -> DataFrame:
    """One-row frame with the run id of the newest created_at."""
    return drift.agg(F.max_by("run_id", F.struct("created_at", "run_id")).alias("_run"))


def latest_drift(drift: DataFrame) -> DataFrame:
    rows = drift.join(F.broadcast(newest_run(drift)), F.col("run_id") == F.col("_run")).drop("_run")
    cols = ["run_id", "feature", "feature_type", "method", "psi", "chi2_stat", "chi2_p_value", "drift_status",
            "baseline_count", "new_count", "created_at"]
    return rows.select(*cols).orderBy("feature")


def drift_summary(drift: DataFrame) -> DataFrame:
    """Counts of exactly High / Moderate / No Drift in the newest run ('High Drift (chi2)' is
    counted in none, as in the reference)."""
    rows = latest_drift(drift)
    s = F.col("drift_status")
    return rows.agg(
        F.max("run_id").alias("run_id"),
        F.count_if(s == "High Drift").alias("high_drift"),
        F.count_if(s == "Moderate Drift").alias("moderate_drift"),
        F.count_if(s == "No Drift").alias("no_drift"))


def chart_rows(drift: DataFrame, kind: str = "psi") -> DataFrame:
    """Bar-chart rows of the newest run: psi (severity from the status text) or chi2 (from p)."""
    rows = latest_drift(drift)
    if kind == "psi":
        sev = (F.when(F.col("drift_status").contains("High"), F.lit("high"))
               .when(F.col("drift_status").contains("Moderate"), F.lit("moderate")).otherwise(F.lit("none")))
        return rows.where(F.col("psi").isNotNull()).select("feature", "psi", sev.alias("severity"))
    if kind == "chi2":
        p = F.col("chi2_p_value")
        sev = F.when(p < 0.05, F.lit("high")).when(p < 0.1, F.lit("moderate")).otherwise(F.lit("none"))
        return rows.where(p.isNotNull()).select("feature", "chi2_p_value", sev.alias("severity"))
    raise ValueError("kind must be psi or chi2")
