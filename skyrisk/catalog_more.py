"""More registered queries: risk, leaderboards, physics, features, metrics, mlops, drift, alerts,
ingest.  Floating results of transcendental functions and of sums are rounded to 9 decimals on
both sides (the DuckDB oracle applies the same rounding)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyrisk import oracle as O
from skyrisk.catalog import appr, logs, pred, register, risk
from skyrisk.functions import columns as C
from skyrisk.operators import alerts as AL
from skyrisk.operators import explore as X
from skyrisk.operators import features as FE
from skyrisk.operators import metrics as M
from skyrisk.operators import mlops as ML
from skyrisk.operators import physics as P
from skyrisk.operators import risk as R
from skyrisk.schemas import BOARDS, DROP_COLUMNS, NUMERIC_COLUMNS
from skyrisk.sources import fixtures as FX
from skyrisk.sources import registry as REG

W = O.with_
A, L, PR, RK, ML_, RC = O.APPROACHES, O.LATEST, O.PREDICTIONS, O.RISK, O.MODEL_LOGS, O.RECIPIENTS
LC, BC = O.LATEST_COLS, O.BOARD_COLS


def rounded(df: DataFrame, cols, digits: int = 9) -> DataFrame:
    cols = set(cols)
    return df.select(*[F.round(F.col(c), digits).alias(c) if c in cols else F.col(c) for c in df.columns])


def r9(expr: str) -> str:
    return f"round({expr}, 9)"


# =============================================================== risk (J1 and its parts)
BR = W(A, L, PR, RK)

register("job_risk_analysis", f"{BR}SELECT * FROM risk_analysis")(lambda s, sf: risk(s, sf))

register("risk_inputs",
         f"{W(A, L, PR)}SELECT a.id, a.min_diameter_km, a.max_diameter_km, a.relative_velocity_kps, "
         f"a.miss_distance_km, p.probability_being_truely_hazardous, a.is_potentially_hazardous "
         f"FROM approaches a JOIN predictions p ON TRY_CAST(p.id AS BIGINT) = a.id WHERE {O.week_filter(FX.RISK_AS_OF)}")(
    lambda s, sf: R.risk_inputs(appr(s, sf), pred(s, sf), FX.RISK_AS_OF))

_RL = O.risk_run("late", FX.RISK_AS_OF)
register("physical_metrics_risk",
         f"{W(A, L, PR, _RL)}SELECT id, davg_m, mass_kg, impact_energy_j FROM ren_late")(
    lambda s, sf: P.physical_metrics(R.risk_inputs(appr(s, sf), pred(s, sf), FX.RISK_AS_OF),
                                     diameter_unit="km", velocity_unit="km/s").select(
        "id", "davg_m", "mass_kg", "impact_energy_j"))

register("risk_minmax",
         f"{W(A, L, PR, _RL)}SELECT id, impact_energy_j, miss_distance_km, Enorm, Rmoid_norm FROM rnorm_late")(
    lambda s, sf: R.risk_minmax(P.physical_metrics(R.risk_inputs(appr(s, sf), pred(s, sf), FX.RISK_AS_OF),
                                                   diameter_unit="km", velocity_unit="km/s"))
    .select("id", "impact_energy_j", "miss_distance_km", "Enorm", "Rmoid_norm"))

register("clamp_probability", f"{W(A, L, PR, _RL)}SELECT id, Phazardous FROM rnorm_late")(
    lambda s, sf: R.clamp_probability(R.risk_inputs(appr(s, sf), pred(s, sf), FX.RISK_AS_OF)).select("id", "Phazardous"))


def _manual_composite(s, sf):
    phys = P.physical_metrics(R.risk_inputs(appr(s, sf), pred(s, sf), FX.RISK_AS_OF), diameter_unit="km",
                              velocity_unit="km/s")
    norm = R.clamp_probability(R.risk_minmax(phys))
    out = R.composite_risk(norm, R.weights(norm, "manual"))
    return out.select("id", "Enorm", "Rmoid_norm", "Phazardous", "RiskScore_raw", "RiskScorenorm", "RiskCategory")


register("composite_risk",
         f"{W(A, L, PR, _RL)}SELECT id, Enorm, Rmoid_norm, Phazardous, RiskScore_raw, "
         f"RiskScorenormManual AS RiskScorenorm, RiskCategoryManual AS RiskCategory FROM risk_late")(_manual_composite)

register("score_merge", f"{BR}SELECT * FROM risk_late")(
    lambda s, sf: R.risk_table(appr(s, sf), pred(s, sf), FX.RISK_AS_OF, dd_weights=FX.FIXED_DD_WEIGHTS))

register("risk_category", f"{BR}SELECT id, risk_analysed_on_date, RiskScorenormDDriven, "
                          f"{O.risk_category('RiskScorenormDDriven')} AS category FROM risk_analysis")(
    lambda s, sf: risk(s, sf).select("id", "risk_analysed_on_date", "RiskScorenormDDriven",
                                     C.risk_category("RiskScorenormDDriven").alias("category")))

# =============================================================== risk-table readers
register("risk_breakdown", f"{BR}SELECT RiskCategoryManual AS category, count(*) AS count FROM risk_analysis GROUP BY 1")(
    lambda s, sf: X.risk_breakdown(risk(s, sf)))
register("risk_total", f"{BR}SELECT count(*) AS total FROM risk_analysis WHERE RiskCategoryManual = 'Low Risk'")(
    lambda s, sf: X.risk_total(risk(s, sf), "Low Risk"))
register("filter_category", f"{BR}SELECT * FROM risk_analysis WHERE RiskCategoryManual = 'Very Low Risk'")(
    lambda s, sf: X.filter_category(risk(s, sf), "Very Low Risk"))
# what is known of an id, looked up for each scored row
_SEEN = ("(SELECT *, (SELECT struct_pack(name := l.name, pho := l.is_potentially_hazardous, sentry := l.is_sentry_object) FROM latest l "
         "WHERE l.id = risk_analysis.id) AS seen FROM risk_analysis)")
register("risk_with_names",
         f"{BR}SELECT * EXCLUDE (seen), seen.name AS name, seen.pho AS is_potentially_hazardous, seen.sentry AS is_sentry_object FROM {_SEEN}")(
    lambda s, sf: X.risk_with_names(risk(s, sf), appr(s, sf)))

_NEWEST = "(SELECT max(risk_analysed_on_date) FROM risk_analysis)"
register("weekly_risky",
         f"{BR}SELECT a.id, a.name FROM approaches a WHERE a.id IN (SELECT id FROM risk_analysis "
         f"WHERE RiskCategoryDDriven = 'High Risk' AND risk_analysed_on_date = {_NEWEST})")(
    lambda s, sf: X.weekly_risky(appr(s, sf), risk(s, sf)))
_WIDS = f"(SELECT id FROM risk_analysis WHERE risk_analysed_on_date = {_NEWEST})"
register("weekly_ids_left",
         f"{BR}SELECT w.id, t.is_potentially_hazardous FROM {_WIDS} w LEFT JOIN approaches t ON w.id = t.id")(
    lambda s, sf: X.weekly_ids_left(appr(s, sf), risk(s, sf)))
WEEK_FLAGS = f"""
week_flags AS (SELECT id, bool_or(is_potentially_hazardous) AS any_true, bool_or(NOT is_potentially_hazardous) AS any_false
               FROM approaches WHERE id IN {_WIDS} GROUP BY id),
week_counts AS (SELECT (SELECT count(DISTINCT id) FROM {_WIDS} ids) AS total_asteroids,
                       count(CASE WHEN any_true THEN 1 END) AS hazardous, count(CASE WHEN any_false THEN 1 END) AS non_hazardous
                FROM week_flags)"""
register("weekly_summary", f"{W(A, L, PR, RK, WEEK_FLAGS)}SELECT * FROM week_counts")(
    lambda s, sf: X.weekly_summary(appr(s, sf), risk(s, sf)))

BOARD = f"""
score AS (SELECT id, RiskScorenormManual AS risk_score_manual, RiskCategoryManual AS risk_category_manual FROM risk_analysis),
board AS (SELECT {BC}, risk_score_manual, risk_category_manual FROM latest LEFT JOIN score USING (id))"""
register("leaderboard_join", f"{W(A, L, PR, RK, BOARD)}SELECT * FROM board")(
    lambda s, sf: X.leaderboard_join(appr(s, sf), risk(s, sf)))

_BOARD_ORDER = {board: f"{column} {way} NULLS LAST" for board, (column, way) in BOARDS.items()}
for _by, _top, _flt in (("risk", 100, None), ("velocity", 50, None), ("closest", 10, None), ("size", 1000, None),
                        ("risk_pho", 100, "hazardous")):
    key = _by.split("_")[0]
    order = (f"{_BOARD_ORDER[key]}, id ASC, risk_score_manual DESC NULLS LAST, risk_category_manual ASC NULLS LAST")
    where = "WHERE is_potentially_hazardous = true" if _flt else ""
    register(f"leaderboard_{_by}",
             f"{W(A, L, PR, RK, BOARD)}SELECT row_number() OVER (ORDER BY {order}) AS rank, {BC}, risk_score_manual, "
             f"risk_category_manual FROM board {where} ORDER BY {order} LIMIT {_top}")(
        (lambda k, t, h: lambda s, sf: X.leaderboard(appr(s, sf), risk(s, sf), by=k, top=t, hazardous=h))(
            key, _top, True if _flt else None))

register("leaderboard_search",
         f"{W(A, L, PR, RK, BOARD)}SELECT row_number() OVER (ORDER BY relative_velocity_kps DESC NULLS LAST, id ASC, "
         f"risk_score_manual DESC NULLS LAST, risk_category_manual ASC NULLS LAST) AS rank, {BC}, risk_score_manual, "
         f"risk_category_manual FROM board WHERE name ILIKE '%ring%' AND is_sentry_object = false "
         f"ORDER BY rank LIMIT 1000")(
    lambda s, sf: X.leaderboard(appr(s, sf), risk(s, sf), by="velocity", top=1000, sentry=False, name="ring"))

register("risk_page",
         f"{BR}SELECT * EXCLUDE (seen, place), seen.name AS name, seen.pho AS is_potentially_hazardous, seen.sentry AS is_sentry_object FROM "
         f"(SELECT *, row_number() OVER (ORDER BY RiskScorenormManual DESC NULLS FIRST, id, risk_analysed_on_date DESC, "
         f"RiskScore_raw DESC NULLS FIRST) AS place FROM {_SEEN}) WHERE place BETWEEN 51 AND 100")(
    lambda s, sf: X.risk_page(risk(s, sf), appr(s, sf), page=2, limit=50))

NEWEST_PRED = """
np_ AS (SELECT * EXCLUDE (_rn) FROM (
  SELECT TRY_CAST(id AS BIGINT) AS id, probability_being_truely_hazardous, probability_being_falsely_hazardous,
         model_prediction,
         row_number() OVER (PARTITION BY TRY_CAST(id AS BIGINT) ORDER BY trained_model_date_used DESC,
                            probability_being_truely_hazardous DESC, probability_being_falsely_hazardous DESC,
                            model_prediction DESC) AS _rn
  FROM predictions) WHERE _rn = 1)"""
NEWEST_RISK = """
nr_ AS (SELECT * EXCLUDE (_rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY risk_analysed_on_date DESC, RiskScorenormManual DESC,
         davg_m DESC, mass_kg DESC, impact_energy_j DESC, Enorm DESC, Rmoid_norm DESC, Phazardous DESC,
         RiskScore_raw DESC, RiskCategoryManual DESC, RiskScorenormDDriven DESC, RiskCategoryDDriven DESC) AS _rn
  FROM risk_analysis) WHERE _rn = 1)"""

register("asteroid_detail",
         f"{W(A, L, PR, RK, NEWEST_PRED, NEWEST_RISK)}"
         f"SELECT l.id, l.name, a0.absolute_magnitude_h, l.min_diameter_km, l.max_diameter_km, l.is_potentially_hazardous, "
         f"l.is_sentry_object, a0.nasa_jpl_url, st.approach_count, st.first_approach_epoch, st.last_approach_epoch, "
         f"p.probability_being_truely_hazardous, p.probability_being_falsely_hazardous, p.model_prediction, "
         f"r.RiskScorenormManual AS risk_score_manual, r.RiskCategoryManual AS risk_category_manual, "
         f"r.RiskScorenormDDriven AS risk_score_dd, r.RiskCategoryDDriven AS risk_category_dd, r.davg_m, r.mass_kg, "
         f"r.impact_energy_j FROM latest l "
         f"JOIN (SELECT id, epoch_date_close_approach, absolute_magnitude_h, nasa_jpl_url FROM approaches) a0 "
         f"  ON a0.id = l.id AND a0.epoch_date_close_approach = l.epoch_date_close_approach "
         f"JOIN (SELECT id, count(*) AS approach_count, min(epoch_date_close_approach) AS first_approach_epoch, "
         f"      max(epoch_date_close_approach) AS last_approach_epoch FROM approaches GROUP BY id) st ON st.id = l.id "
         f"LEFT JOIN np_ p ON p.id = l.id LEFT JOIN nr_ r ON r.id = l.id")(
    lambda s, sf: X.asteroid_detail(appr(s, sf), pred(s, sf), risk(s, sf)))

_IDS = "1032, 104, 1744, 999999, 7, 14, 21"
register("compare_ids",
         f"{W(A, L, PR, RK, NEWEST_PRED, NEWEST_RISK)}"
         f"SELECT w.id, w.position, l.name, l.min_diameter_km, l.max_diameter_km, l.relative_velocity_kps, "
         f"l.miss_distance_km, l.is_potentially_hazardous, l.is_sentry_object, r.RiskScorenormManual AS risk_score_manual, "
         f"r.RiskCategoryManual AS risk_category_manual, r.davg_m, r.mass_kg, r.impact_energy_j, r.Phazardous AS phazardous, "
         f"p.probability_being_truely_hazardous FROM (VALUES (1032, 0), (104, 1), (1744, 2), (999999, 3), (7, 4), (14, 5)) "
         f"w(id, position) JOIN latest l ON l.id = w.id LEFT JOIN nr_ r ON r.id = w.id LEFT JOIN np_ p ON p.id = w.id")(
    lambda s, sf: X.compare_ids(appr(s, sf), pred(s, sf), risk(s, sf), _IDS))

# =============================================================== physics / display
register("physical_metrics",
         f"{W(A)}SELECT *, (CAST(min_diameter_km AS DOUBLE) * 1000.0e0 + CAST(max_diameter_km AS DOUBLE) * 1000.0e0) / 2.0e0 AS davg_m, "
         f"{O.d(P._SPHERE)} * ((((CAST(min_diameter_km AS DOUBLE) * 1000.0e0 + CAST(max_diameter_km AS DOUBLE) * 1000.0e0) / 2.0e0) / 2.0e0) "
         f"* (((CAST(min_diameter_km AS DOUBLE) * 1000.0e0 + CAST(max_diameter_km AS DOUBLE) * 1000.0e0) / 2.0e0) / 2.0e0) "
         f"* (((CAST(min_diameter_km AS DOUBLE) * 1000.0e0 + CAST(max_diameter_km AS DOUBLE) * 1000.0e0) / 2.0e0) / 2.0e0)) * 2600.0e0 AS mass_kg "
         f"FROM approaches")(
    lambda s, sf: P.physical_metrics(appr(s, sf), diameter_unit="km", velocity_unit="km/s").drop("impact_energy_j"))

register("hazard_class",
         f"{W(A, L)}SELECT id, CASE WHEN coalesce(is_potentially_hazardous, false) AND coalesce(is_sentry_object, false) "
         f"THEN 'both' WHEN coalesce(is_potentially_hazardous, false) THEN 'pho' WHEN coalesce(is_sentry_object, false) "
         f"THEN 'sentry' ELSE 'safe' END AS hazard_class FROM latest")(
    lambda s, sf: X.latest_approach(appr(s, sf).select(*X.LATEST_COLUMNS), X.LATEST_COLUMNS).select(
        "id", C.hazard_class().alias("hazard_class")))

_HZ = ("(coalesce(is_potentially_hazardous, false) OR coalesce(risk_score_manual, 0.0e0) >= 0.5 "
       "OR coalesce(probability_being_truely_hazardous, 0.0e0) >= 0.5)")
BOARD_P = """
boardp AS (SELECT b.*, p.probability_being_truely_hazardous FROM board b LEFT JOIN np_ p ON p.id = b.id)"""


def _board_p(s, sf):
    return X.leaderboard_join(appr(s, sf), risk(s, sf)).join(
        X.newest_prediction(pred(s, sf)).select("id", "probability_being_truely_hazardous"), "id", "left")


register("hazard_badge",
         f"{W(A, L, PR, RK, BOARD, NEWEST_PRED, BOARD_P)}SELECT id, risk_score_manual, CASE WHEN {_HZ} AND "
         f"coalesce(is_sentry_object, false) THEN 'both' WHEN {_HZ} THEN 'pho' WHEN coalesce(is_sentry_object, false) "
         f"THEN 'sentry' ELSE 'safe' END AS badge FROM boardp")(
    lambda s, sf: _board_p(s, sf).select("id", "risk_score_manual", C.hazard_badge(
        risk="risk_score_manual", probability="probability_being_truely_hazardous").alias("badge")))


def _z(c: str) -> str:
    return f"coalesce(CASE WHEN {c} <> 0 THEN {c} END, 0.0e0)"


register("radar_axes",
         f"{W(A, L, PR, RK, BOARD, NEWEST_PRED, BOARD_P)}SELECT id, CASE WHEN length(name) > 20 THEN substr(name, 1, 18) "
         f"|| '…' ELSE name END AS label, {_z('relative_velocity_kps')} / 66.0e0 AS axis_velocity, "
         f"{_z('max_diameter_km')} / 2.0e0 AS axis_size, 1.0e0 - {_z('miss_distance_km')} / 75000000.0e0 AS axis_miss, "
         f"{_z('risk_score_manual')} AS axis_risk, coalesce(CASE WHEN probability_being_truely_hazardous <> 0 THEN "
         f"probability_being_truely_hazardous END, CASE WHEN coalesce(is_potentially_hazardous, false) THEN 0.8e0 ELSE "
         f"0.1e0 END) AS axis_probability FROM boardp")(
    lambda s, sf: P.radar_axes(_board_p(s, sf)))

register("earth_scale_ratio",
         f"{W(A, L)}SELECT id, max_diameter_km / 12742.0e0 AS earth_ratio, CASE WHEN max_diameter_km / 12742.0e0 = 0 "
         f"THEN NULL ELSE 1.0e0 / (max_diameter_km / 12742.0e0) END AS earth_ratio_inverse FROM latest")(
    lambda s, sf: P.earth_scale_ratio(X.latest_approach(appr(s, sf).select(*X.LATEST_COLUMNS), X.LATEST_COLUMNS)))

_LOGMAX = O.d(math.log(74794677.0 - 6599.0 + 1.0))
register("orbit_layout",
         f"{W(A, L)}SELECT id, round(3.0e0 + ln(miss_distance_km - 6599.0e0 + 1.0e0) / {_LOGMAX} * 45.0e0, 9) AS orbit_radius, "
         f"greatest(0.015e0, least(1.25e0, (min_diameter_km + max_diameter_km) / 2.0e0 / 12742.0e0 * 2.5e0 * 50.0e0)) "
         f"AS display_size, (id % 1000) / 1000.0e0 * {O.d(math.pi)} * 2.0e0 AS phase, "
         f"coalesce(CASE WHEN relative_velocity_kps <> 0 THEN relative_velocity_kps END, 20.0e0) * "
         f"(CASE WHEN id % 2 = 0 THEN 1.0e0 ELSE -1.0e0 END) * 0.00012e0 AS speed FROM latest")(
    lambda s, sf: P.orbit_layout(X.latest_approach(appr(s, sf).select(*X.LATEST_COLUMNS), X.LATEST_COLUMNS)))

register("sci_notation",
         f"{BR}SELECT id, CASE WHEN impact_energy_j IS NOT NULL AND impact_energy_j <> 0 THEN round(impact_energy_j / "
         f"pow(10.0e0, CAST(floor(log10(abs(impact_energy_j))) AS INTEGER)), 2) END AS impact_energy_j_coef, "
         f"CASE WHEN impact_energy_j IS NOT NULL AND impact_energy_j <> 0 THEN CAST(floor(log10(abs(impact_energy_j))) "
         f"AS INTEGER) END AS impact_energy_j_exp FROM risk_analysis")(
    lambda s, sf: P.sci_notation(risk(s, sf), "impact_energy_j"))

register("display_units",
         f"{W(A, L, PR, RK, BOARD)}SELECT id, round(risk_score_manual * 100.0e0, 1) AS risk_pct, "
         f"round(miss_distance_km / 1000.0e0, 0) AS miss_thousand_km, round(miss_distance_km / 1000000.0e0, 2) AS miss_million_km, "
         f"round(relative_velocity_kps, 2) AS velocity_2dp, round(max_diameter_km, 3) AS max_diameter_3dp FROM board")(
    lambda s, sf: P.display_units(X.leaderboard_join(appr(s, sf), risk(s, sf))))

# =============================================================== features
_ENG = f"""
eng AS (
  SELECT absolute_magnitude_h, epoch_date_close_approach, relative_velocity_kps, miss_distance_km,
         is_potentially_hazardous, is_sentry_object, diameter_range, est_mass_kg, est_kinetic_energy_j, inv_miss_dist,
         ln(1.0e0 + est_kinetic_energy_j * inv_miss_dist) AS impact_risk_index
  FROM (SELECT *, 0.5e0 * est_mass_kg * ((relative_velocity_kps * 1000.0e0) * (relative_velocity_kps * 1000.0e0)) AS est_kinetic_energy_j
        FROM (SELECT *, {O.d(P._SPHERE)} * ((diameter_range / 2.0e0) * (diameter_range / 2.0e0) * (diameter_range / 2.0e0))
                         * 1000000000.0e0 * 2600.0e0 AS est_mass_kg, 1.0e0 / (miss_distance_km + 1e-05) AS inv_miss_dist
              FROM (SELECT *, (max_diameter_km + min_diameter_km) / 2.0e0 AS diameter_range FROM approaches)))
)"""


def _eng(s, sf):
    return FE.engineered_features(appr(s, sf))


register("engineered_features", f"{W(A, _ENG)}SELECT * REPLACE ({r9('ln(1.0e0 + est_kinetic_energy_j * inv_miss_dist)')} AS impact_risk_index) FROM eng")(
    lambda s, sf: rounded(_eng(s, sf), ["impact_risk_index"]))
register("diameter_spread", f"{W(A)}SELECT *, max_diameter_km - min_diameter_km AS diameter_range FROM approaches")(
    lambda s, sf: FE.diameter_spread(appr(s, sf)))
register("drop_columns", f"{W(A)}SELECT * EXCLUDE ({', '.join(DROP_COLUMNS)}) FROM approaches")(
    lambda s, sf: FE.drop_columns(appr(s, sf), DROP_COLUMNS))
register("feature_target_select",
         f"{W(A, _ENG)}SELECT absolute_magnitude_h, epoch_date_close_approach, relative_velocity_kps, miss_distance_km, "
         f"is_sentry_object, diameter_range, est_mass_kg, est_kinetic_energy_j, inv_miss_dist, "
         f"{r9('ln(1.0e0 + est_kinetic_energy_j * inv_miss_dist)')} AS impact_risk_index, is_potentially_hazardous FROM eng")(
    lambda s, sf: rounded(FE.feature_target(_eng(s, sf)), ["impact_risk_index"]))

_MED_COLS = ["absolute_magnitude_h", "epoch_date_close_approach", "relative_velocity_kps", "miss_distance_km",
             "diameter_range", "est_mass_kg", "est_kinetic_energy_j", "inv_miss_dist"]
register("feature_medians",
         f"{W(A, _ENG)}" + " UNION ALL ".join(
             f"SELECT '{c}' AS feature, {r9(f'quantile_cont(CAST({c} AS DOUBLE), 0.5)')} AS median FROM eng"
             for c in _MED_COLS))(
    lambda s, sf: rounded(FE.fit_medians(_eng(s, sf), _MED_COLS), ["median"]))
register("impute_median",
         f"{W(A, _ENG)}SELECT {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in _MED_COLS)} FROM eng")(
    lambda s, sf: FE.impute_median(_eng(s, sf).select(*_MED_COLS), _MED_COLS))
register("skew_transform",
         f"{W(A, _ENG)}SELECT {r9('ln(diameter_range)')} AS diameter_range, {r9('ln(relative_velocity_kps)')} AS "
         f"relative_velocity_kps, sqrt(miss_distance_km) AS miss_distance_km FROM eng")(
    lambda s, sf: rounded(FE.skew_transform(_eng(s, sf)).select("diameter_range", "relative_velocity_kps",
                                                                "miss_distance_km"),
                          ["diameter_range", "relative_velocity_kps"]))

_SC = ["absolute_magnitude_h", "epoch_date_close_approach", "relative_velocity_kps", "miss_distance_km",
       "diameter_range", "est_mass_kg", "inv_miss_dist"]
register("standard_scale",
         f"{W(A, _ENG)}SELECT " + ", ".join(
             f"round(({c} - m_{c}) / (CASE WHEN s_{c} = 0 THEN 1.0e0 ELSE s_{c} END), 6) AS {c}" for c in _SC)
         + " FROM eng CROSS JOIN (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _SC)
         + " FROM eng)")(
    lambda s, sf: rounded(FE.standard_scale(_eng(s, sf).select(*_SC), _SC), _SC, 6))

register("one_hot_sentry",
         f"{W(A)}SELECT id, epoch_date_close_approach, CASE WHEN is_sentry_object = false THEN 1.0e0 WHEN is_sentry_object "
         f"= true THEN 0.0e0 END AS is_sentry_object_false, CASE WHEN is_sentry_object = true THEN 1.0e0 WHEN "
         f"is_sentry_object = false THEN 0.0e0 END AS is_sentry_object_true FROM approaches")(
    lambda s, sf: FE.one_hot(appr(s, sf).select("id", "epoch_date_close_approach", "is_sentry_object"), "is_sentry_object"))

register("label_encode",
         f"{W(A)}SELECT a.id, a.epoch_date_close_approach, a.is_potentially_hazardous, c.idx AS is_potentially_hazardous_index "
         f"FROM approaches a LEFT JOIN (SELECT category, CAST(dense_rank() OVER (ORDER BY category) - 1 AS INTEGER) AS idx FROM "
         f"(SELECT DISTINCT is_potentially_hazardous AS category FROM approaches WHERE is_potentially_hazardous IS NOT NULL)) c "
         f"ON a.is_potentially_hazardous = c.category")(
    lambda s, sf: FE.label_encode(appr(s, sf).select("id", "epoch_date_close_approach", "is_potentially_hazardous"),
                                  "is_potentially_hazardous"))

register("stratified_split",
         f"{W(A)}SELECT id, epoch_date_close_approach, is_potentially_hazardous, "
         f"row_number() OVER (PARTITION BY is_potentially_hazardous ORDER BY h) <= ceil(count(*) OVER "
         f"(PARTITION BY is_potentially_hazardous) * 0.2e0) AS is_test FROM (SELECT *, ('0x' || substr(md5('42:' || "
         f"concat_ws(':', id, epoch_date_close_approach)), 1, 15))::BIGINT AS h FROM approaches)")(
    lambda s, sf: FE.stratified_split(appr(s, sf).select("id", "epoch_date_close_approach", "is_potentially_hazardous"),
                                      "is_potentially_hazardous", ["id", "epoch_date_close_approach"]))

# =============================================================== metrics (E23-E25) over the prediction table
_CM = """
cm AS (SELECT count(*) FILTER (WHERE actual AND model_prediction) AS tp,
              count(*) FILTER (WHERE NOT actual AND model_prediction) AS fp,
              count(*) FILTER (WHERE actual AND NOT model_prediction) AS fn,
              count(*) FILTER (WHERE NOT actual AND NOT model_prediction) AS tn, count(*) AS n FROM predictions)"""
register("confusion_matrix",
         f"{W(A, L, PR, _CM)}SELECT * FROM (SELECT false AS actual, false AS predicted, tn AS count FROM cm UNION ALL "
         f"SELECT false, true, fp FROM cm UNION ALL SELECT true, false, fn FROM cm UNION ALL SELECT true, true, tp FROM cm)")(
    lambda s, sf: M.confusion_matrix(pred(s, sf)))


def _ratio(a: str, b: str) -> str:
    return f"coalesce(CASE WHEN ({b}) = 0 THEN NULL ELSE CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) END, 0.0e0)"


_PREC, _REC = _ratio("tp", "tp + fp"), _ratio("tp", "tp + fn")
register("binary_metrics",
         f"{W(A, L, PR, _CM)}SELECT {r9(_ratio('tp + tn', 'n'))} AS accuracy, {r9('p')} AS precision, {r9('r')} AS recall, "
         f"{r9('CASE WHEN p + r = 0 THEN 0.0e0 ELSE 2.0e0 * p * r / (p + r) END')} AS f1_score FROM "
         f"(SELECT *, {_PREC} AS p, {_REC} AS r FROM cm)")(
    lambda s, sf: rounded(M.binary_metrics(pred(s, sf)), ["accuracy", "precision", "recall", "f1_score"]))

_F1 = "CASE WHEN p + r = 0 THEN 0.0e0 ELSE 2.0e0 * p * r / (p + r) END"
_CLS = f"""
cls AS (
  SELECT 'false' AS label, {_ratio('tn', 'tn + fn')} AS p, {_ratio('tn', 'tn + fp')} AS r, tn + fp AS support FROM cm
  UNION ALL
  SELECT 'true', {_ratio('tp', 'tp + fp')}, {_ratio('tp', 'tp + fn')}, tp + fn FROM cm),
cls2 AS (SELECT label, p AS precision, r AS recall, {_F1} AS f1_score, support FROM cls)"""
register("classification_report",
         f"{W(A, L, PR, _CM, _CLS)}SELECT label, {r9('precision')} AS precision, {r9('recall')} AS recall, "
         f"{r9('f1_score')} AS f1_score, support FROM cls2 UNION ALL SELECT 'macro avg', {r9('avg(precision)')}, "
         f"{r9('avg(recall)')}, {r9('avg(f1_score)')}, sum(support) FROM cls2 UNION ALL SELECT 'weighted avg', "
         f"{r9('sum(precision * support) / sum(support)')}, {r9('sum(recall * support) / sum(support)')}, "
         f"{r9('sum(f1_score * support) / sum(support)')}, sum(support) FROM cls2")(
    lambda s, sf: rounded(M.classification_report(pred(s, sf)), ["precision", "recall", "f1_score"]))

# =============================================================== model history
BL = W(ML_)
register("latest_model", f"{BL}SELECT * FROM model_logs ORDER BY training_date DESC, model_name LIMIT 1")(
    lambda s, sf: ML.latest_model(logs(s, sf)))
register("model_history", f"{BL}SELECT * FROM model_logs ORDER BY training_date DESC, model_name")(
    lambda s, sf: ML.model_history(logs(s, sf)))
register("model_metrics_pct",
         f"{BL}SELECT model_name, training_date, accuracy * 100.0e0 AS accuracy_pct, precision * 100.0e0 AS precision_pct, "
         f"recall * 100.0e0 AS recall_pct, f1_score * 100.0e0 AS f1_score_pct FROM model_logs "
         f"ORDER BY training_date DESC, model_name LIMIT 1")(
    lambda s, sf: ML.model_metrics_pct(logs(s, sf)))
register("model_versions",
         f"{BL}SELECT 'v' || CAST(row_number() OVER (ORDER BY training_date ASC NULLS FIRST, model_name) AS VARCHAR) "
         f"AS version, model_name, substr(training_date, 1, 10) AS trained_on, round(accuracy * 100.0e0, 2) AS accuracy_pct, "
         f"round(precision * 100.0e0, 2) AS precision_pct, round(recall * 100.0e0, 2) AS recall_pct, "
         f"round(f1_score * 100.0e0, 2) AS f1_score_pct FROM model_logs")(
    lambda s, sf: ML.model_versions(logs(s, sf)))
register("latest_artifact",
         f"{BL}SELECT model_name AS name, artifact_uri AS artifact, training_date AS created_at FROM model_logs "
         f"ORDER BY training_date DESC, model_name DESC LIMIT 1")(
    lambda s, sf: REG.latest_artifact(
        logs(s, sf).select(F.col("model_name").alias("name"), F.col("artifact_uri").alias("artifact"),
                           F.col("training_date").alias("created_at"))))

# =============================================================== alerts
register("recipients", f"{W(RC)}SELECT email FROM alert_recipients")(
    lambda s, sf: AL.recipients(FX.alert_recipients(s, sf)))

_TOP = f"""
risky AS (SELECT a.id, a.name FROM approaches a WHERE a.id IN (SELECT id FROM risk_analysis
          WHERE RiskCategoryDDriven = 'High Risk' AND risk_analysed_on_date = {_NEWEST})),
top10 AS (SELECT name, row_number() OVER (ORDER BY name, id) AS slot FROM risky QUALIFY slot <= 10),
slots AS (SELECT CAST(g.range AS INTEGER) AS slot, coalesce(t.name, '—') AS name FROM range(1, 11) g
          LEFT JOIN top10 t ON t.slot = g.range)"""
register("alert_top10", f"{W(A, L, PR, RK, _TOP)}SELECT slot, name FROM slots")(
    lambda s, sf: AL.alert_top10(appr(s, sf), risk(s, sf)))

register("job_weekly_alert",
         f"{W(A, L, PR, RK, RC, WEEK_FLAGS, _TOP)}SELECT '2000-07-02' AS run_date, week_counts.*, "
         + ", ".join(f"(SELECT name FROM slots WHERE slot = {i}) AS asteroid_{i}" for i in range(1, 11))
         + ", (SELECT count(*) FROM alert_recipients) AS recipient_count FROM week_counts")(
    lambda s, sf: AL.weekly_alert(
        appr(s, sf), risk(s, sf), FX.alert_recipients(s, sf), "2000-07-02"))

# =============================================================== weights (E18) and the compare queue


def _week_norms(s, sf):
    phys = P.physical_metrics(R.risk_inputs(appr(s, sf), pred(s, sf), FX.RISK_AS_OF), diameter_unit="km", velocity_unit="km/s")
    return R.clamp_probability(R.risk_minmax(phys))


def _weights_data_driven(s, sf):
    w = R.weights(_week_norms(s, sf), "data-driven", label_col="is_potentially_hazardous")
    return s.createDataFrame([tuple(round(x, 6) for x in w)], "w_energy double, w_miss double, w_probability double")


register("weights_data_driven",
         f"{W(A, L, PR, _RL, O.fitted_weights('late')).replace('WITH', 'WITH RECURSIVE', 1)}SELECT round(w1, 6) AS w_energy, round(w2, 6) AS w_miss, "
         f"round(w3, 6) AS w_probability FROM weights_late")(_weights_data_driven)
# the week's job with fitted weights: what does not depend on them has an oracle
_FITTED = ["id", "davg_m", "mass_kg", "impact_energy_j", "Enorm", "Rmoid_norm", "Phazardous", "RiskScore_raw", "RiskScorenormManual",
           "RiskCategoryManual", "risk_analysed_on_date"]
register("risk_fitted_weights", f"{W(A, L, PR, _RL)}SELECT {', '.join(_FITTED)}, true AS scored FROM risk_late")(
    lambda s, sf: R.risk_table(appr(s, sf), pred(s, sf), FX.RISK_AS_OF).select(
        *_FITTED, (F.col("RiskScorenormDDriven").between(0, 1) & F.col("RiskCategoryDDriven").isNotNull()).alias("scored")))

register("compare_queue",
         f"{W(A)}SELECT id, list_reduce([coalesce(CAST(x AS VARCHAR), '') FOR x IN picked], lambda a, b: a || ',' || b) AS queue FROM ("
         f"SELECT id, [id % 6, id % 4, id % 5 + 10, 20, 21, 22, 23] AS longer, "
         f"[x FOR x, i IN longer IF list_position(longer, x) = i][1:6] AS picked FROM (SELECT DISTINCT id FROM approaches))")(
    lambda s, sf: X.distinct_ids(appr(s, sf)).select("id", F.array_join(X.compare_queue(
        F.array(F.col("id") % 6, F.col("id") % 4), F.array(F.col("id") % 5 + 10, F.lit(20).cast("long"), F.lit(21).cast("long"),
                                                          F.lit(22).cast("long"), F.lit(23).cast("long"))).cast("array<string>"), ",").alias("queue")))
