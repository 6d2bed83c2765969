"""DuckDB twins of the adapters and jobs, used to build ``oracle_sql()`` strings.

Each public builder returns a ``WITH`` clause body (CTE list) that the per-query SQL in
``skyrisk.catalog`` prefixes.  Operation order mirrors the Spark code so doubles are identical.
"""

from __future__ import annotations

from skyrisk.operators.physics import _SPHERE
from skyrisk.schemas import (ISCLOSE_ATOL, ISCLOSE_RTOL, MANUAL_WEIGHTS, PSI_EPS, RISK_EPS)
from skyrisk.sources.fixtures import (DRIFT_CUTOFF, FIRST_TRAINING_DATE, FIXED_DD_WEIGHTS, MISS_MODULUS,
                                      PREDICTION_MODEL_DATE, PREDICTION_OLDER_DATE, RISK_AS_OF,
                                      RISK_EARLIER_AS_OF, TRAINING_STEP_DAYS)


def d(x: float) -> str:
    """A DOUBLE literal."""
    return f"CAST('{float(x)!r}' AS DOUBLE)"


APPROACH_COLS = ("id, name, absolute_magnitude_h, min_diameter_km, max_diameter_km, close_approach_date, "
                 "close_approach_date_full, epoch_date_close_approach, relative_velocity_kps, miss_distance_km, "
                 "orbiting_body, is_potentially_hazardous, is_sentry_object, nasa_jpl_url")
LATEST_COLS = ("id, name, min_diameter_km, max_diameter_km, relative_velocity_kps, miss_distance_km, "
               "is_potentially_hazardous, is_sentry_object, close_approach_date, epoch_date_close_approach")
BOARD_COLS = ("id, name, min_diameter_km, max_diameter_km, relative_velocity_kps, miss_distance_km, "
              "is_potentially_hazardous, is_sentry_object")

APPROACHES = f"""
approaches AS (
  SELECT
    l.l_partkey AS id,
    p.p_name || ' (' || CAST(p.p_partkey AS VARCHAR) || ')' AS name,
    10.0e0 + p.p_size * 0.4e0 AS absolute_magnitude_h,
    p.p_size * 0.01e0 AS min_diameter_km,
    p.p_size * 0.01e0 * 2.2360679775e0 AS max_diameter_km,
    strftime(l.l_shipdate, '%Y-%m-%d') AS close_approach_date,
    strftime(l.l_shipdate, '%Y-%b-%d %H:%M') AS close_approach_date_full,
    epoch_ms(l.l_shipdate) + (l.l_orderkey * 8 + l.l_linenumber) % 86400000 AS epoch_date_close_approach,
    2.0e0 + l.l_extendedprice / 2500.0e0 AS relative_velocity_kps,
    CAST(10000 + l._k AS DOUBLE) AS miss_distance_km,
    CASE WHEN l.l_linestatus = 'F' THEN 'Earth' ELSE 'Venus' END AS orbiting_body,
    (10.0e0 + p.p_size * 0.4e0 <= 22 AND 10000 + l._k <= 20000000) AS is_potentially_hazardous,
    l.l_partkey % 37 = 0 AS is_sentry_object,
    'https://example.invalid/obj/' || CAST(l.l_partkey AS VARCHAR) AS nasa_jpl_url
  FROM (SELECT *, (l_orderkey * 7919 + l_partkey * 104729 + l_linenumber * 1299709) % {MISS_MODULUS} AS _k
        FROM lineitem) l
  JOIN part p ON l.l_partkey = p.p_partkey
)"""

LATEST = """
latest AS (
  SELECT * EXCLUDE (_rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY epoch_date_close_approach DESC NULLS FIRST) AS _rn
    FROM approaches) WHERE _rn = 1
)"""

PREDICTIONS = f"""
pred_base AS (SELECT id, is_potentially_hazardous AS actual FROM latest WHERE id % 3 <> 0),
predictions AS (
  SELECT CAST(id AS VARCHAR) AS id, actual,
         ((id * 7919) % 1000) / 999.0e0 >= 0.5 AS model_prediction,
         1.0e0 - ((id * 7919) % 1000) / 999.0e0 AS probability_being_falsely_hazardous,
         ((id * 7919) % 1000) / 999.0e0 AS probability_being_truely_hazardous,
         '{PREDICTION_MODEL_DATE}' AS trained_model_date_used
  FROM pred_base
  UNION ALL
  SELECT CAST(id AS VARCHAR) AS id, actual,
         ((id * 104729) % 1000) / 999.0e0 >= 0.5 AS model_prediction,
         1.0e0 - ((id * 104729) % 1000) / 999.0e0 AS probability_being_falsely_hazardous,
         ((id * 104729) % 1000) / 999.0e0 AS probability_being_truely_hazardous,
         '{PREDICTION_OLDER_DATE}' AS trained_model_date_used
  FROM pred_base WHERE id % 10 = 0
)"""

MODEL_LOGS = f"""
model_logs AS (
  SELECT 'best_model_' || CAST(n_nationkey AS VARCHAR) AS model_name,
         strftime(DATE '{FIRST_TRAINING_DATE}' + n_nationkey * {TRAINING_STEP_DAYS}, '%Y-%m-%d') || ' 00:00:00' AS training_date,
         0.8e0 + 0.005e0 * n_nationkey AS accuracy,
         0.35e0 + 0.01e0 * n_nationkey AS precision,
         0.7e0 + 0.01e0 * n_nationkey AS recall,
         0.45e0 + 0.01e0 * n_nationkey AS f1_score,
         'run_' || CAST(n_nationkey AS VARCHAR) AS run_id,
         'models/best_model_' || CAST(n_nationkey AS VARCHAR) AS artifact_uri
  FROM nation
)"""

RECIPIENTS = """
alert_recipients AS (SELECT c_name || '@example.invalid' AS email, c_custkey AS recipient_id FROM customer)"""


def finite_or_null(x: str) -> str:
    return f"(CASE WHEN isnan({x}) OR isinf({x}) THEN NULL ELSE {x} END)"


def clip01(x: str) -> str:
    return (f"(CASE WHEN {x} IS NULL OR isnan({x}) THEN {x} WHEN {x} < 0 THEN 0.0e0 "
            f"WHEN {x} > 1 THEN 1.0e0 ELSE {x} END)")


def risk_category(s: str) -> str:
    return (f"(CASE WHEN isnan({s}) THEN 'High Risk' WHEN {s} <= 0.2 THEN 'Very Low Risk' "
            f"WHEN {s} <= 0.5 THEN 'Low Risk' WHEN {s} <= 0.8 THEN 'Medium Risk' ELSE 'High Risk' END)")


def minmax(x: str, lo: str, hi: str) -> str:
    return f"(CASE WHEN {hi} - {lo} = 0 THEN 0.0e0 ELSE ({x} - {lo}) / ({hi} - {lo}) END)"


def normalised(r: str, lo: str, hi: str) -> str:
    return (f"(CASE WHEN abs({hi} - {lo}) <= {d(ISCLOSE_ATOL)} + {d(ISCLOSE_RTOL)} * abs({lo}) THEN 0.0e0 "
            f"ELSE ({r} - {lo}) / ({hi} - {lo}) END)")


def raw_score(w) -> str:
    return f"(({d(w[0])} * Enorm + {d(w[1])} * Rmoid_norm) + {d(w[2])} * Phazardous)"


def week_filter(as_of: str, days: int = 7, col: str = "close_approach_date") -> str:
    return (f"CAST({col} AS DATE) >= DATE '{as_of}' - {days} AND CAST({col} AS DATE) <= DATE '{as_of}'")


def risk_run(tag: str, as_of: str, w_manual=MANUAL_WEIGHTS, w_dd=FIXED_DD_WEIGHTS) -> str:
    """CTEs computing one risk-job run (needs approaches, predictions); final CTE risk_{tag}."""
    s = sum(w_manual)
    wm = tuple(x / s for x in w_manual)
    t = tag
    return f"""
rin_{t} AS (
  SELECT a.id, a.min_diameter_km, a.max_diameter_km, a.relative_velocity_kps, a.miss_distance_km,
         p.probability_being_truely_hazardous, a.is_potentially_hazardous
  FROM approaches a JOIN predictions p ON TRY_CAST(p.id AS BIGINT) = a.id
  WHERE {week_filter(as_of)}
),
rph_{t} AS (
  SELECT *, {d(_SPHERE)} * ((davg_m / 2.0e0) * (davg_m / 2.0e0) * (davg_m / 2.0e0)) * 2600.0e0 AS mass_kg
  FROM (SELECT *, (CAST(min_diameter_km AS DOUBLE) * 1000.0e0 + CAST(max_diameter_km AS DOUBLE) * 1000.0e0) / 2.0e0 AS davg_m
        FROM rin_{t})
),
ren_{t} AS (
  SELECT *, 0.5e0 * mass_kg * ((CAST(relative_velocity_kps AS DOUBLE) * 1000.0e0) * (CAST(relative_velocity_kps AS DOUBLE) * 1000.0e0)) AS impact_energy_j
  FROM rph_{t}
),
rst_{t} AS (
  SELECT *, coalesce({finite_or_null('CAST(impact_energy_j AS DOUBLE)')}, 0.0e0) AS _energy,
         {finite_or_null('CAST(miss_distance_km AS DOUBLE)')} AS _miss
  FROM ren_{t}
),
rin2_{t} AS (
  SELECT r.*, 1.0e0 / (coalesce(r._miss, m._miss_max) + {d(RISK_EPS)}) AS _inv
  FROM rst_{t} r CROSS JOIN (SELECT max(_miss) AS _miss_max FROM rst_{t}) m
),
rnorm_{t} AS (
  SELECT r.*, {minmax('_energy', 'b._e_lo', 'b._e_hi')} AS Enorm, {minmax('_inv', 'b._i_lo', 'b._i_hi')} AS Rmoid_norm,
         {clip01('CAST(probability_being_truely_hazardous AS DOUBLE)')} AS Phazardous
  FROM rin2_{t} r CROSS JOIN (SELECT min(_energy) AS _e_lo, max(_energy) AS _e_hi, min(_inv) AS _i_lo, max(_inv) AS _i_hi
                              FROM rin2_{t}) b
),
rraw_{t} AS (
  SELECT *, {raw_score(wm)} AS RiskScore_raw, {raw_score(w_dd)} AS _raw_dd FROM rnorm_{t}
),
risk_{t} AS (
  SELECT id, davg_m, mass_kg, impact_energy_j, Enorm, Rmoid_norm, Phazardous, RiskScore_raw,
         {normalised('RiskScore_raw', '_m_lo', '_m_hi')} AS RiskScorenormManual,
         {risk_category(normalised('RiskScore_raw', '_m_lo', '_m_hi'))} AS RiskCategoryManual,
         {normalised('_raw_dd', '_d_lo', '_d_hi')} AS RiskScorenormDDriven,
         {risk_category(normalised('_raw_dd', '_d_lo', '_d_hi'))} AS RiskCategoryDDriven,
         '{as_of}' AS risk_analysed_on_date
  FROM rraw_{t} CROSS JOIN (SELECT min(RiskScore_raw) AS _m_lo, max(RiskScore_raw) AS _m_hi,
                                   min(_raw_dd) AS _d_lo, max(_raw_dd) AS _d_hi FROM rraw_{t})
)"""


def fitted_weights(t: str, steps: int = 25) -> str:
    """CTEs (of a WITH RECURSIVE) with the data-driven weights of the run ``t``: Newton steps from zero, each the solution of
    the four normal equations by elimination; final CTE weights_{t} (w1, w2, w3)."""
    axes = ["1.0e0", "x1", "x2", "x3"]
    pairs = [(i, j) for i in range(4) for j in range(i, 4)]
    sums = [f"sum((p - y) * {a}) + {'b' + str(i) if i else '0.0e0'} AS g{i}" for i, a in enumerate(axes)]
    sums += [f"sum(p * (1.0e0 - p) * {axes[i]} * {axes[j]}) + {1.0 if i == j and i else 0.0}e0 AS h{i}{j}" for i, j in pairs]
    names = "k, b0, b1, b2, b3"
    p = "1.0e0 / (1.0e0 + exp(-(b0 + b1 * x1 + b2 * x2 + b3 * x3)))"
    layer = f"SELECT {names}, {', '.join(sums)} FROM (SELECT {names}, x1, x2, x3, y, {p} AS p FROM newton_{t} CROSS JOIN obs_{t} WHERE k < {steps}) GROUP BY {names}"
    for pivot in range(3):  # rows below the pivot lose its column
        rest = range(pivot + 1, 4)
        changed = {f"g{i}": f"g{i} - h{pivot}{i} / h{pivot}{pivot} * g{pivot}" for i in rest}
        changed |= {f"h{i}{j}": f"h{i}{j} - h{pivot}{i} / h{pivot}{pivot} * h{pivot}{j}" for i in rest for j in rest if j >= i}
        kept = [f"g{i}" for i in range(4)] + [f"h{i}{j}" for i, j in pairs]
        layer = f"SELECT {names}, {', '.join(f'{changed.get(c, c)} AS {c}' for c in kept)} FROM ({layer})"
    for i in (3, 2, 1, 0):
        later = "".join(f" - h{i}{j} * d{j}" for j in range(i + 1, 4))
        layer = f"SELECT *, (g{i}{later}) / h{i}{i} AS d{i} FROM ({layer})"
    return f"""
obs_{t} AS (SELECT coalesce(Enorm, 0.0e0) AS x1, coalesce(Rmoid_norm, 0.0e0) AS x2, coalesce(Phazardous, 0.0e0) AS x3,
                   CASE WHEN is_potentially_hazardous THEN 1.0e0 ELSE 0.0e0 END AS y FROM rnorm_{t} WHERE is_potentially_hazardous IS NOT NULL),
newton_{t}(k, b0, b1, b2, b3) AS (
  SELECT 0, 0.0e0, 0.0e0, 0.0e0, 0.0e0 UNION ALL
  SELECT k + 1, b0 - d0, b1 - d1, b2 - d2, b3 - d3 FROM ({layer})),
weights_{t} AS (
  SELECT abs(b1) / s AS w1, abs(b2) / s AS w2, abs(b3) / s AS w3 FROM (SELECT *, abs(b1) + abs(b2) + abs(b3) AS s FROM newton_{t} WHERE k = {steps}))"""


def fitted_risk(t: str) -> str:
    """CTE risk_fitted_{t}: the run's rows with its own data-driven weights; normalised score to six decimals."""
    norm = normalised("raw", "min(raw) OVER ()", "max(raw) OVER ()")
    cols = "id, davg_m, mass_kg, impact_energy_j, Enorm, Rmoid_norm, Phazardous, RiskScore_raw, RiskScorenormManual, RiskCategoryManual"
    return f"""
scored_{t} AS (SELECT *, (w1 * Enorm + w2 * Rmoid_norm) + w3 * Phazardous AS raw FROM risk_{t} CROSS JOIN weights_{t}),
risk_fitted_{t} AS (SELECT {cols}, round(dd, 6) AS RiskScorenormDDriven, {risk_category('dd')} AS RiskCategoryDDriven, risk_analysed_on_date
                    FROM (SELECT *, {norm} AS dd FROM scored_{t}))"""


RISK = (risk_run("early", RISK_EARLIER_AS_OF) + "," + risk_run("late", RISK_AS_OF) + """,
risk_analysis AS (SELECT * FROM risk_early UNION ALL SELECT * FROM risk_late)""")


def with_(*parts: str) -> str:
    return "WITH " + ",".join(p.strip("\n") for p in parts) + "\n"


BASE = with_(APPROACHES, LATEST)
BASE_PRED = with_(APPROACHES, LATEST, PREDICTIONS)
BASE_RISK = with_(APPROACHES, LATEST, PREDICTIONS, RISK)
BASE_LOGS = with_(APPROACHES, MODEL_LOGS)

__all__ = ["APPROACHES", "LATEST", "PREDICTIONS", "MODEL_LOGS", "RECIPIENTS", "RISK", "BASE", "BASE_PRED",
           "BASE_RISK", "BASE_LOGS", "with_", "d", "risk_run", "week_filter", "risk_category", "clip01",
           "minmax", "normalised", "finite_or_null", "PSI_EPS", "DRIFT_CUTOFF"]


DRIFT_NUMERIC = ["absolute_magnitude_h", "epoch_date_close_approach", "relative_velocity_kps", "miss_distance_km",
                 "diameter_range"]
DRIFT_CATEGORICAL = ["is_potentially_hazardous", "is_sentry_object"]


def _prop(c: str, tot: str) -> str:
    return f"greatest({c} / CAST(greatest({tot}, 1) AS DOUBLE), {d(PSI_EPS)})"


def drift_run(t: str, logs_filter: str, run_id: str, created_at: str, buckets: int = 10) -> str:
    """CTEs of one drift run (no p-value branch); final CTE drift_{t}.  Needs approaches, model_logs."""
    qs = ", ".join(f"{i / buckets!r}e0" for i in range(buckets + 1))
    nums = " UNION ALL ".join(f"SELECT _is_base, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM dsp_{t}"
                              for c in DRIFT_NUMERIC)
    cats = " UNION ALL ".join(f"SELECT _is_base, '{c}' AS feature, CAST({c} AS VARCHAR) AS category FROM dsp_{t}"
                              for c in DRIFT_CATEGORICAL)
    e = f"(c.b / CAST(greatest(t.btot, 1) AS DOUBLE) * t.ntot)"
    ef = f"greatest({e}, {d(PSI_EPS)})"
    return f"""
dsp_{t} AS (
  SELECT a.*, a.max_diameter_km - a.min_diameter_km AS diameter_range,
         CAST(a.close_approach_date AS DATE) < c.cut AS _is_base
  FROM approaches a CROSS JOIN (SELECT max(CAST(training_date AS DATE)) AS cut FROM model_logs WHERE {logs_filter}) c
),
dnum_{t} AS (SELECT * FROM ({nums}) WHERE value IS NOT NULL AND NOT isnan(value)),
dq_{t} AS (
  SELECT feature, quantile_cont(value, [{qs}]) AS qs, quantile_cont(value, 0.5e0) AS med, min(value) AS mn, max(value) AS mx
  FROM dnum_{t} WHERE _is_base GROUP BY feature
),
ded_{t} AS (
  SELECT feature, CASE WHEN len(list_distinct(qs)) < 3 THEN [mn, med, mx] ELSE list_sort(list_distinct(qs)) END AS edges
  FROM dq_{t}
),
dh_{t} AS (
  SELECT n.feature, n._is_base,
         least(len(list_filter(e.edges, lambda x: x <= n.value)) - 1, len(e.edges) - 2) AS bin, count(*) AS cnt
  FROM dnum_{t} n JOIN ded_{t} e ON e.feature = n.feature
  WHERE n.value >= e.edges[1] AND n.value <= e.edges[len(e.edges)]
  GROUP BY ALL
),
dg_{t} AS (
  SELECT g.feature, g.bin, coalesce(b.cnt, 0) AS b, coalesce(nn.cnt, 0) AS n
  FROM (SELECT feature, unnest(range(0, len(edges) - 1)) AS bin FROM ded_{t}) g
  LEFT JOIN dh_{t} b ON b.feature = g.feature AND b.bin = g.bin AND b._is_base
  LEFT JOIN dh_{t} nn ON nn.feature = g.feature AND nn.bin = g.bin AND NOT nn._is_base
),
dpsi_{t} AS (
  SELECT g.feature, sum(({_prop('g.b', 't.btot')} - {_prop('g.n', 't.ntot')}) * ln({_prop('g.b', 't.btot')} / {_prop('g.n', 't.ntot')})) AS psi
  FROM dg_{t} g JOIN (SELECT feature, sum(b) AS btot, sum(n) AS ntot FROM dg_{t} GROUP BY feature) t ON t.feature = g.feature
  GROUP BY g.feature
),
dnc_{t} AS (SELECT feature, count(*) FILTER (WHERE _is_base) AS baseline_count, count(*) FILTER (WHERE NOT _is_base) AS new_count
            FROM dnum_{t} GROUP BY feature HAVING count(*) FILTER (WHERE _is_base) > 0 AND count(*) FILTER (WHERE NOT _is_base) > 0),
dcat_{t} AS (SELECT * FROM ({cats}) WHERE category IS NOT NULL),
dcc_{t} AS (SELECT feature, category, count(*) FILTER (WHERE _is_base) AS b, count(*) FILTER (WHERE NOT _is_base) AS n
            FROM dcat_{t} GROUP BY ALL),
dct_{t} AS (SELECT feature, sum(b) AS btot, sum(n) AS ntot, count(*) AS k FROM dcc_{t} GROUP BY feature),
dcs_{t} AS (
  SELECT c.feature,
         sum(({_prop('c.b', 't.btot')} - {_prop('c.n', 't.ntot')}) * ln({_prop('c.b', 't.btot')} / {_prop('c.n', 't.ntot')})) AS psi,
         sum(CASE WHEN {e} > 0 THEN (c.n - {e}) * (c.n - {e}) / {e} ELSE 0.0e0 END) AS chi2_masked,
         sum((c.n - {ef}) * (c.n - {ef}) / {ef}) AS chi2_stat,
         max(t.k) - 1 AS dof
  FROM dcc_{t} c JOIN dct_{t} t ON t.feature = c.feature GROUP BY c.feature
),
dcn_{t} AS (SELECT feature, count(*) FILTER (WHERE _is_base) AS baseline_count, count(*) FILTER (WHERE NOT _is_base) AS new_count
            FROM dcat_{t} GROUP BY feature HAVING count(*) FILTER (WHERE _is_base) > 0 AND count(*) FILTER (WHERE NOT _is_base) > 0),
drift_{t} AS (
  SELECT '{run_id}' AS run_id, p.feature, 'numeric' AS feature_type, 'psi' AS method, round(p.psi, 9) AS psi,
         CAST(NULL AS DOUBLE) AS chi2_stat, CAST(NULL AS DOUBLE) AS chi2_p_value, 0.05e0 AS chi2_alpha,
         CASE WHEN p.psi > 0.2 THEN 'High Drift' WHEN p.psi > 0.1 THEN 'Moderate Drift' ELSE 'No Drift' END AS drift_status,
         n.baseline_count, n.new_count, '{created_at}' AS created_at
  FROM dpsi_{t} p JOIN dnc_{t} n ON n.feature = p.feature
  UNION ALL
  SELECT '{run_id}', s.feature, 'categorical', 'psi', round(s.psi, 9), round(s.chi2_masked, 9), CAST(NULL AS DOUBLE), 0.05e0,
         CASE WHEN s.psi > 0.2 THEN 'High Drift' WHEN s.psi > 0.1 THEN 'Moderate Drift' ELSE 'No Drift' END,
         n.baseline_count, n.new_count, '{created_at}'
  FROM dcs_{t} s JOIN dcn_{t} n ON n.feature = s.feature
)"""
