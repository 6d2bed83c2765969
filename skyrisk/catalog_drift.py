"""Registered drift queries.

The drift fixture table holds two runs: run A uses the training log without its newest row
(cutoff 2000-05-21), run B the whole log (cutoff 2000-06-20).  Both branches of the reference have an
oracle: without p-values (method 'psi', masked chi-square) and with them (the flags have one degree of
freedom, for which SQL sums the series of the error function).
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from skyrisk import oracle as O
from skyrisk.catalog import appr, logs, pred, register
from skyrisk.catalog_more import rounded
from skyrisk.functions.special import chi2_sf
from skyrisk.operators.explore import category_union, training_cutoff
from skyrisk.operators import drift as D
from skyrisk.operators import mlops as ML
from skyrisk.operators.profile import drift_from_profile, update_profile
from skyrisk.operators.sketches import hero_counters, update_sketches
from skyrisk.plans.jobs import Paths, drift_inputs, drift_rows, job_drift, job_risk_analysis
from skyrisk.session import scratch_path
from skyrisk.sources import fixtures as FX
from skyrisk.sources.weeks import write_weeks

W = O.with_
RUN_A = ("drift-run-a", "2000-05-22 00:00:00", "model_name <> 'best_model_24'")
RUN_B = ("drift-run-b", "2000-06-21 00:00:00", "true")
DA = O.drift_run("a", RUN_A[2], RUN_A[0], RUN_A[1])
DB = O.drift_run("b", RUN_B[2], RUN_B[0], RUN_B[1])
DRIFT_TABLE = """
neo_data_drift AS (SELECT * FROM drift_a UNION ALL SELECT * FROM drift_b)"""
BD = W(O.APPROACHES, O.MODEL_LOGS, DB)
BDD = W(O.APPROACHES, O.MODEL_LOGS, DA, DB, DRIFT_TABLE)


# p = erfc(sqrt(x / 2)): erf(z) = 2 / sqrt(pi) * exp(-z^2) * sum over n of z * x^n / (2n + 1)!!, with x = 2 z^2
_TERM = "exp(0.5e0 * ln(x / 2) + n * ln(x) - (lgamma(2 * n + 2) - n * ln(2) - lgamma(n + 1)) - x / 2)"
P_VALUES = f"""
pv AS (SELECT feature, CASE WHEN dof <> 1 THEN NULL WHEN x = 0 THEN 1.0e0 WHEN x > 150 THEN 0.0e0 ELSE
              1 - 2 / sqrt(pi()) * list_sum([{_TERM} FOR n IN range(0, 600)]) END AS p
       FROM (SELECT feature, dof, chi2_stat AS x FROM dcs_b)),
drift_p AS (
  SELECT d.* REPLACE (CASE WHEN d.feature_type = 'categorical' THEN 'psi+chi2' ELSE d.method END AS method,
                      CASE WHEN d.feature_type = 'categorical' THEN round(c.chi2_stat, 9) ELSE d.chi2_stat END AS chi2_stat,
                      round(pv.p, 9) AS chi2_p_value,
                      CASE WHEN pv.p < 0.05 AND d.drift_status <> 'High Drift' THEN 'High Drift (chi2)' ELSE d.drift_status END AS drift_status)
  FROM drift_b d LEFT JOIN pv USING (feature) LEFT JOIN dcs_b c USING (feature))"""
BDP = W(O.APPROACHES, O.MODEL_LOGS, DB, P_VALUES)


def _logs(s, sf, newest: bool):
    lg = logs(s, sf)
    return lg if newest else lg.where(F.col("model_name") != "best_model_24")


def _inputs(s, sf):
    return drift_inputs(appr(s, sf), _logs(s, sf, True))


def _long(s, sf):
    b, n = _inputs(s, sf)
    _, _, num, cat = D.align_columns(b, n)
    return D.numeric_long(b, num), D.numeric_long(n, num), D.categorical_long(b, cat), D.categorical_long(n, cat)


def drift_table(s, sf, with_p: bool = False):
    a = drift_rows(appr(s, sf), _logs(s, sf, False), RUN_A[0], RUN_A[1], with_p_value=with_p)
    b = drift_rows(appr(s, sf), _logs(s, sf, True), RUN_B[0], RUN_B[1], with_p_value=with_p)
    return rounded(a.unionByName(b), ["psi", "chi2_stat"])


register("align_columns",
         f"{BD}SELECT absolute_magnitude_h, epoch_date_close_approach, relative_velocity_kps, miss_distance_km, "
         f"is_potentially_hazardous, is_sentry_object, diameter_range FROM dsp_b WHERE _is_base")(
    lambda s, sf: D.align_columns(*_inputs(s, sf))[0])

register("baseline_edges",
         f"{BD}SELECT feature, CAST(i AS INTEGER) AS edge_index, edges[i + 1] AS edge FROM "
         f"(SELECT feature, edges, unnest(range(0, len(edges))) AS i FROM ded_b)")(
    lambda s, sf: D.baseline_edges(_long(s, sf)[0]).select("feature", F.posexplode("edges").alias("edge_index", "edge")))

register("histogram_on_edges", f"{BD}SELECT feature, bin, cnt AS count FROM dh_b WHERE _is_base")(
    lambda s, sf: (lambda bl: D.histogram_on_edges(bl, D.baseline_edges(bl)))(_long(s, sf)[0]))

register("psi_numeric", f"{BD}SELECT feature, round(psi, 9) AS psi FROM dpsi_b")(
    lambda s, sf: rounded((lambda t: D.psi_numeric(t[0], t[1]))(_long(s, sf)), ["psi"]))

register("category_counts", f"{BD}SELECT feature, category, b, n FROM dcc_b")(
    lambda s, sf: (lambda t: D.category_counts(t[2], t[3]).select("feature", "category", "b", "n"))(_long(s, sf)))

register("category_union", f"{BD}SELECT DISTINCT category FROM dcat_b WHERE feature = 'is_sentry_object'")(
    lambda s, sf: (lambda t: category_union(
        t[2].where(F.col("feature") == "is_sentry_object"), t[3].where(F.col("feature") == "is_sentry_object"),
        "category"))(_long(s, sf)))

register("psi_categorical", f"{BD}SELECT feature, round(psi, 9) AS psi FROM dcs_b")(
    lambda s, sf: rounded((lambda t: D.categorical_stats(t[2], t[3]).select("feature", "psi"))(_long(s, sf)), ["psi"]))

register("chi2_stat", f"{BD}SELECT feature, round(chi2_masked, 9) AS chi2 FROM dcs_b")(
    lambda s, sf: rounded((lambda t: D.categorical_stats(t[2], t[3]).select(
        "feature", F.col("chi2_masked").alias("chi2")))(_long(s, sf)), ["chi2"]))

register("chi2_gof_stat", f"{BD}SELECT feature, round(chi2_stat, 9) AS chi2_stat, dof FROM dcs_b")(
    lambda s, sf: rounded((lambda t: D.categorical_stats(t[2], t[3]).select("feature", "chi2_stat", "dof"))(
        _long(s, sf)), ["chi2_stat"]))

register("chi2_gof", f"{BDP}SELECT feature, round(chi2_stat, 9) AS chi2_stat, dof, round(p, 9) AS chi2_p_value FROM dcs_b JOIN pv USING (feature)")(
    lambda s, sf: rounded((lambda t: D.categorical_stats(t[2], t[3]).select(
        "feature", "chi2_stat", "dof", chi2_sf(F.col("chi2_stat"), F.col("dof").cast("double")).alias("chi2_p_value")))(_long(s, sf)),
        ["chi2_stat", "chi2_p_value"]))

register("drift_report_no_p", f"{BD}SELECT * FROM drift_b")(
    lambda s, sf: rounded(drift_rows(appr(s, sf), _logs(s, sf, True), RUN_B[0], RUN_B[1], with_p_value=False),
                          ["psi", "chi2_stat"]))

register("drift_report", f"{BDP}SELECT * FROM drift_p")(
    lambda s, sf: rounded(drift_rows(appr(s, sf), _logs(s, sf, True), RUN_B[0], RUN_B[1], with_p_value=True), ["psi", "chi2_stat", "chi2_p_value"]))

register("drift_status", f"{BD}SELECT feature, drift_status FROM drift_b")(
    lambda s, sf: drift_rows(appr(s, sf), _logs(s, sf, True), RUN_B[0], RUN_B[1], with_p_value=False)
    .select("feature", "drift_status"))

register("job_drift", f"{BDD}SELECT * FROM neo_data_drift")(lambda s, sf: drift_table(s, sf))

_DH = ("run_id, feature, feature_type, method, psi, chi2_stat, chi2_p_value, drift_status, baseline_count, "
       "new_count, created_at")
register("drift_history", f"{BDD}SELECT {_DH} FROM neo_data_drift ORDER BY created_at DESC, feature")(
    lambda s, sf: ML.drift_history(drift_table(s, sf)))
_NEWRUN = "(SELECT run_id FROM neo_data_drift ORDER BY created_at DESC, run_id DESC LIMIT 1)"
register("latest_drift", f"{BDD}SELECT {_DH} FROM neo_data_drift WHERE run_id = {_NEWRUN} ORDER BY feature")(
    lambda s, sf: ML.latest_drift(drift_table(s, sf)))
register("drift_summary",
         f"{BDD}SELECT max(run_id) AS run_id, count(*) FILTER (WHERE drift_status = 'High Drift') AS high_drift, "
         f"count(*) FILTER (WHERE drift_status = 'Moderate Drift') AS moderate_drift, "
         f"count(*) FILTER (WHERE drift_status = 'No Drift') AS no_drift FROM neo_data_drift WHERE run_id = {_NEWRUN}")(
    lambda s, sf: ML.drift_summary(drift_table(s, sf)))
register("psi_chart_rows",
         f"{BDD}SELECT feature, psi, CASE WHEN contains(drift_status, 'High') THEN 'high' WHEN contains(drift_status, "
         f"'Moderate') THEN 'moderate' ELSE 'none' END AS severity FROM neo_data_drift WHERE run_id = {_NEWRUN} "
         f"AND psi IS NOT NULL")(
    lambda s, sf: ML.chart_rows(drift_table(s, sf), "psi"))
register("chi2_chart_rows",
         f"{BDP}SELECT feature, chi2_p_value, CASE WHEN chi2_p_value < 0.05 THEN 'high' WHEN chi2_p_value < 0.1 THEN 'moderate' ELSE 'none' END AS severity "
         f"FROM drift_p WHERE chi2_p_value IS NOT NULL")(
    lambda s, sf: rounded(ML.chart_rows(drift_rows(appr(s, sf), _logs(s, sf, True), RUN_B[0], RUN_B[1], with_p_value=True), "chi2"), ["chi2_p_value"]))


def _job_drift(s, sf):
    """J2 as the job: both runs appended to one drift table, which is read back."""
    root = scratch_path(s, f"drift-{uuid.uuid4().hex}")
    appr(s, sf).write.parquet(f"{root}/approaches")
    for run, newest in ((RUN_A, False), (RUN_B, True)):
        _logs(s, sf, newest).write.parquet(f"{root}/logs-{run[0]}")
        job_drift(s, Paths(approaches=f"{root}/approaches", training_logs=f"{root}/logs-{run[0]}", drift=f"{root}/drift"), run[0],
                  dt.datetime.fromisoformat(run[1]))
    return rounded(s.read.parquet(f"{root}/drift").where(F.col("run_id") == RUN_B[0]), ["psi", "chi2_stat", "chi2_p_value"])


register("job_drift_tables", f"{BDP}SELECT * FROM drift_p")(_job_drift)


def _profiled(s, sf):
    """Two landings of the fact table by week, the profile updated after each, and the report from it."""
    root = scratch_path(s, f"profile-{uuid.uuid4().hex}")
    fact, profile, ledger, a = f"{root}/fact", f"{root}/profile", f"{root}/ledger", appr(s, sf)
    first = F.col("close_approach_date") < PROFILE_FROM
    for rows in (a.where(first), a.where(~first)):
        write_weeks(rows, fact)
        update_profile(s, fact, profile, ledger)
    cutoff = training_cutoff(_logs(s, sf, True)).first()["model_last_trained"]
    return rounded(drift_from_profile(s, profile, ledger, cutoff, RUN_B[0], RUN_B[1]), ["psi", "chi2_stat", "chi2_p_value"])


PROFILE_FROM = "2000-07-03"  # a Monday
register("drift_profile", f"{BDP}SELECT * FROM drift_p")(_profiled)


def _heroes(s, sf):
    """Hero counters from weekly sketches, updated twice; the error of each distinct count measured against the exact one."""
    root = scratch_path(s, f"sketches-{uuid.uuid4().hex}")
    a = appr(s, sf)
    first = F.col("close_approach_date") < PROFILE_FROM
    for rows in (a.where(first), a.where(~first)):
        write_weeks(rows, f"{root}/fact")
        update_sketches(s, f"{root}/fact", f"{root}/sketches", f"{root}/ledger")
    got = hero_counters(s, f"{root}/sketches", f"{root}/ledger")
    exact = a.groupBy("id").agg(F.bool_or("is_potentially_hazardous").alias("h"), F.bool_or("is_sentry_object").alias("s")).agg(
        F.count("id").alias("ids"), F.count_if("h").alias("hazardous"), F.count_if("s").alias("sentry"))
    error = [(F.abs(F.col(f"{c}_estimate") - F.col(c)) <= 0.03 * F.col(c)).alias(f"{c}_within_3_percent") for c in ("ids", "hazardous", "sentry")]
    return got.crossJoin(F.broadcast(exact)).select("ids", "hazardous", "sentry", *error, "total_approaches", "closest_km", "fastest_kps", "latest_date")


register("hero_sketches",
         f"{O.BASE}SELECT count(DISTINCT id) AS ids, count(DISTINCT CASE WHEN is_potentially_hazardous THEN id END) AS hazardous, "
         f"count(DISTINCT CASE WHEN is_sentry_object THEN id END) AS sentry, true AS ids_within_3_percent, true AS hazardous_within_3_percent, "
         f"true AS sentry_within_3_percent, count(*) AS total_approaches, min(miss_distance_km) AS closest_km, max(relative_velocity_kps) AS fastest_kps, "
         f"max(close_approach_date) AS latest_date FROM approaches")(_heroes)


def _job_risk(s, sf):
    """J1 as the job: the week of the newest drift run, joined, scored with manual and with fitted weights, appended and
    read back."""
    root = scratch_path(s, f"risk-{uuid.uuid4().hex}")
    appr(s, sf).write.parquet(f"{root}/approaches")
    pred(s, sf).write.parquet(f"{root}/predictions")
    s.createDataFrame([("r", dt.datetime(2000, 6, 24, 9)), ("q", dt.datetime(2000, 7, 1, 9))], "run_id string, created_at timestamp").write.parquet(f"{root}/drift")
    paths = Paths(approaches=f"{root}/approaches", predictions=f"{root}/predictions", risk=f"{root}/risk", drift=f"{root}/drift")
    return rounded(job_risk_analysis(s, paths, analysed_on=FX.RISK_AS_OF), ["RiskScorenormDDriven"], 6)


register("job_risk_tables", f"{O.BASE_RISK.replace('WITH', 'WITH RECURSIVE', 1).rstrip()},{O.fitted_weights('late')},{O.fitted_risk('late')} "
                            f"SELECT * FROM risk_fitted_late")(_job_risk)
