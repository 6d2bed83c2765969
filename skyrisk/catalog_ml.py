"""Registered ML queries.

Learners are fitted on all training rows.  ``PARAMS`` and ``SPACES`` are small trees, as a caller chooses who wants a
model soon.  ``tune_random_search`` is the whole search: the library's defaults (10 trials of 100 to 500 trees for each
learner, 3 folds) on all resampled training rows.  Folds and meta trees are the defaults.  Every query trains for itself;
nothing is shared between queries.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyrisk import oracle as O
from skyrisk.catalog import appr, register
from skyrisk.operators import ml as MLX
from skyrisk.plans.jobs import Paths, job_predict, job_train
from skyrisk.schemas import NUMERIC_COLUMNS
from skyrisk.session import scratch_path, stored, unstore
from skyrisk.sources import fixtures as FX
from skyrisk.sources.registry import latest_artifact, load_best_model

W = O.with_
NAMES = MLX.model_features()
PARAMS = [{"trees": 12, "depth": 5, "step": 0.3, "gain": 1e-6}, {"trees": 10, "depth": 4, "step": 0.3}]
SMALL = {"trials": 2, "trees": (5, 12), "depth": (3, 5), "lr": (0.1, 0.4)}
SPACES = [MLX.sample_params(**SMALL), MLX.sample_params(**SMALL, seed=43, regularised=False)]
TRAINED_AT = dt.datetime(2000, 6, 20)
SCORE_FROM, SCORE_TO = "2000-05-03", "2000-07-01"


def _split(s, sf) -> tuple[DataFrame, DataFrame]:
    return MLX.split_inputs(MLX.stored_inputs(appr(s, sf)))


def _training_rows(s, sf) -> DataFrame:
    """All labelled training rows, encoded; features rounded to 6 decimals, so that both engines see the same numbers."""
    inputs = MLX.stored_inputs(appr(s, sf))
    split, medians = MLX.split_inputs(inputs)
    train = split.where(~F.col("is_test"))
    rows = MLX.unique_rows(MLX.encode_features(train, MLX.fit_features(train, medians)))
    rows = stored(rows.select(MLX.KEY, *[F.round(c, 6).alias(c) for c in NAMES], MLX.LABEL))
    unstore(inputs)
    return rows


# the same rows in SQL: features, split, scaling over all training rows
_SKEW = {"diameter_range": "ln(diameter_range)", "relative_velocity_kps": "ln(relative_velocity_kps)", "miss_distance_km": "sqrt(miss_distance_km)"}
_ENGINEERED = f"""
eng0 AS (SELECT *, (max_diameter_km + min_diameter_km) / 2.0e0 AS diameter_range FROM approaches),
eng1 AS (SELECT *, {O.d(4.0 / 3.0 * 3.141592653589793)} * ((diameter_range / 2.0e0) * (diameter_range / 2.0e0) * (diameter_range / 2.0e0)) * 1e9 * 2600.0e0 AS est_mass_kg FROM eng0),
eng2 AS (SELECT *, 0.5e0 * est_mass_kg * ((relative_velocity_kps * 1000.0e0) * (relative_velocity_kps * 1000.0e0)) AS est_kinetic_energy_j,
                1.0e0 / (miss_distance_km + 1e-5) AS inv_miss_dist FROM eng1),
eng3 AS (SELECT concat_ws(':', id, epoch_date_close_approach) AS row_key, is_potentially_hazardous AS y, is_sentry_object,
                {', '.join(f"CAST({_SKEW.get(c, 'ln(1 + est_kinetic_energy_j * inv_miss_dist)' if c == 'impact_risk_index' else c)} AS DOUBLE) AS {c}" for c in NUMERIC_COLUMNS)} FROM eng2),
hashed AS (SELECT *, ('0x' || substr(md5('42:' || row_key), 1, 15))::BIGINT AS h FROM eng3),
train AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY h) AS rn, count(*) OVER (PARTITION BY y) AS ny FROM hashed) WHERE rn > ceil(ny * 0.2e0)),
stats AS (SELECT {', '.join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in NUMERIC_COLUMNS)} FROM train),
fit AS (
  SELECT row_key, CASE WHEN y THEN 1.0e0 ELSE 0.0e0 END AS label, {', '.join(f"round(({c} - m_{c}) / (CASE WHEN s_{c} = 0 THEN 1.0e0 ELSE s_{c} END), 6) AS f{i}" for i, c in enumerate(NUMERIC_COLUMNS))},
         CASE WHEN NOT is_sentry_object THEN 1.0e0 ELSE 0.0e0 END AS f{len(NUMERIC_COLUMNS)}, CASE WHEN is_sentry_object THEN 1.0e0 ELSE 0.0e0 END AS f{len(NUMERIC_COLUMNS) + 1}
  FROM train CROSS JOIN stats)"""
_D2 = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in NAMES)

register("training_split",
         f"{W(O.APPROACHES)}SELECT row_key, row_number() OVER (PARTITION BY y ORDER BY h) <= ceil(count(*) OVER (PARTITION BY y) * 0.2e0) AS is_test FROM "
         f"(SELECT row_key, y, ('0x' || substr(md5('42:' || row_key), 1, 15))::BIGINT AS h FROM "
         f"(SELECT concat_ws(':', id, epoch_date_close_approach) AS row_key, is_potentially_hazardous AS y FROM approaches))")(
    lambda s, sf: _split(s, sf)[0].select(MLX.KEY, "is_test"))

_NEAR_MINORITY = f"""
near AS (SELECT a.row_key AS q, arg_min(b.row_key, struct_pack(d := {_D2}, c := b.row_key), 5) AS nn,
                arg_min({_D2}, struct_pack(d := {_D2}, c := b.row_key), 5) AS d2
         FROM fit a JOIN fit b ON a.label = 1 AND b.label = 1 AND a.row_key <> b.row_key GROUP BY 1)"""
register("knn_minority",
         f"{W(O.APPROACHES, _ENGINEERED, _NEAR_MINORITY)}SELECT q, unnest(nn) AS c, round(unnest(d2), 9) AS d2, CAST(unnest(range(1, len(nn) + 1)) AS INTEGER) AS nn_rank FROM near")(
    lambda s, sf: MLX.knn(_training_rows(s, sf).where(F.col(MLX.LABEL) == 1.0), 5, NAMES).withColumn("d2", F.round("d2", 9)))

# Nearest rows in SQL: rows share a cell of _CELL in four columns with all rows that are nearer than _CELL, or with its
# neighbour cells; a row whose nearest there is farther is compared with all rows.
_CELL = 0.4
_AXES = [f"f{NUMERIC_COLUMNS.index(c)}" for c in ("absolute_magnitude_h", "epoch_date_close_approach", "relative_velocity_kps", "miss_distance_km")]


def _links(rows: str) -> str:
    nearest = f"arg_min(struct_pack(c := b.row_key, d := {_D2}), struct_pack(d := {_D2}, c := b.row_key)) AS nn"
    k = range(len(_AXES))
    return f"""
cells AS (SELECT *, {', '.join(f"CAST(floor({c} / {_CELL}) AS INTEGER) AS k{i}" for i, c in enumerate(_AXES))} FROM {rows}),
step AS (SELECT unnest([-1, 0, 1]) AS s),
looks AS (SELECT row_key, label, {', '.join(NAMES)}, {', '.join(f'k{i} + s{i}.s AS k{i}' for i in k)} FROM cells, {', '.join(f'step s{i}' for i in k)}),
beside AS (SELECT a.row_key AS q, a.label AS own, {nearest} FROM looks a JOIN cells b ON {' AND '.join(f'a.k{i} = b.k{i}' for i in k)} AND a.row_key <> b.row_key GROUP BY 1, 2),
sure AS (SELECT * FROM beside WHERE nn.d < {_CELL * _CELL * 0.999}),
others AS (SELECT a.row_key AS q, a.label AS own, {nearest} FROM (SELECT * FROM {rows} r ANTI JOIN sure ON sure.q = r.row_key) a JOIN {rows} b ON a.row_key <> b.row_key GROUP BY 1, 2),
nearest AS (SELECT * FROM sure UNION ALL SELECT * FROM others),
links AS (SELECT x.q AS row_key FROM nearest x JOIN nearest y ON x.nn.c = y.q AND y.nn.c = x.q WHERE x.own <> y.own)"""


register("tomek_links", f"{W(O.APPROACHES, _ENGINEERED, _links('fit'))}SELECT row_key FROM links")(
    lambda s, sf: MLX.tomek_links(_training_rows(s, sf), NAMES))

_U = "('0x' || substr(md5('{seed}:' || row_key || ':' || j), 1, 8))::BIGINT / 4294967296.0e0"
_SMOTE = f"""{_NEAR_MINORITY},
placed AS (SELECT *, row_number() OVER (ORDER BY ('0x' || substr(md5('42:' || row_key), 1, 15))::BIGINT, row_key) - 1 AS place FROM fit WHERE label = 1),
size AS (SELECT count(*) FILTER (label = 1) AS n1, count(*) FILTER (label = 0) - count(*) FILTER (label = 1) AS more FROM fit),
wanted AS (SELECT r % n1 AS place, r // n1 AS j FROM (SELECT unnest(range(more)) AS r, n1 FROM size)),
moved AS (SELECT p.*, j, {_U.format(seed=42)} AS u, nn[1 + CAST(floor({_U.format(seed=44)} * len(nn)) AS INTEGER)] AS c
          FROM wanted JOIN placed p USING (place) JOIN near ON near.q = p.row_key),
made AS (SELECT row_key, label, {', '.join(NAMES)} FROM fit UNION ALL
         SELECT m.row_key || ':s' || j AS row_key, m.label, {', '.join(f'm.{c} + u * (b.{c} - m.{c}) AS {c}' for c in NAMES)} FROM moved m JOIN fit b ON b.row_key = m.c)"""


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select(MLX.KEY, MLX.LABEL, *[F.round(c, 9).alias(c) for c in NAMES])


def _resampled(rows: DataFrame) -> DataFrame:
    return _shown(MLX.smote_tomek(rows, NAMES, done=lambda: unstore(rows)))


_SHOWN = f"row_key, label, {', '.join(f'round({c}, 9) AS {c}' for c in NAMES)}"
register("smote", f"{W(O.APPROACHES, _ENGINEERED, _SMOTE)}SELECT {_SHOWN} FROM made")(lambda s, sf: _shown(MLX.smote(_training_rows(s, sf), NAMES)))
register("smote_tomek", f"{W(O.APPROACHES, _ENGINEERED, _SMOTE, _links('made'))}SELECT {_SHOWN} FROM made ANTI JOIN links USING (row_key)")(
    lambda s, sf: _resampled(_training_rows(s, sf)))


def _tune(s, sf):
    got = MLX.training_inputs(appr(s, sf))
    best = MLX.tune(got.rows, NAMES, MLX.default_spaces())
    for done in (got.rows, got.search):
        unstore(done)
    return s.createDataFrame([(i, p["trees"], p["depth"], p["step"], p["gain"], p["cv_accuracy"]) for i, p in enumerate(best)],
                             "learner int, trees int, depth int, step_size double, min_gain double, cv_accuracy double")


register("tune_random_search", None)(_tune)
register("job_training", None)(lambda s, sf: MLX.job_training(appr(s, sf), spaces=SPACES).metrics)


def _stack(s, sf):
    got = MLX.training_inputs(appr(s, sf))
    return MLX.train_stack(got.rows, NAMES, PARAMS, got.features), got


def _train_stack(s, sf):
    """Probabilities of both learners and the stack's class for every approach."""
    model, _ = _stack(s, sf)
    out = model.transform(appr(s, sf))
    return out.select(MLX.KEY, *[vector_to_array(p)[1].alias(p) for p in ("p0", "p1")], (F.col("prediction") == 1.0).alias("model_prediction"))


register("train_stack", None)(_train_stack)
_TEST = (f"{W(O.APPROACHES)}SELECT row_key, y AS actual, true AS is_probability FROM (SELECT row_key, y, row_number() OVER (PARTITION BY y ORDER BY h) AS k, "
         f"count(*) OVER (PARTITION BY y) AS n FROM (SELECT row_key, y, ('0x' || substr(md5('42:' || row_key), 1, 15))::BIGINT AS h FROM "
         f"(SELECT concat_ws(':', id, epoch_date_close_approach) AS row_key, is_potentially_hazardous AS y FROM approaches))) WHERE k <= ceil(n * 0.2e0)")
register("evaluate_model", _TEST)(
    lambda s, sf: MLX.job_training(appr(s, sf), PARAMS).predictions.select(
        MLX.KEY, "actual", (F.col("p_true").between(0, 1) & F.col("model_prediction").isNotNull()).alias("is_probability")))

# what SQL can say of predictions: whose they are, the model date, and that the two probabilities add up
_CHECKED = ("CAST(id AS VARCHAR) AS id, is_potentially_hazardous AS actual, '2000-06-20 00:00:00' AS trained_model_date_used, 1.0e0 AS p_sum, true AS is_probability")


def _checked(rows: DataFrame) -> DataFrame:
    p, q = F.col("probability_being_truely_hazardous"), F.col("probability_being_falsely_hazardous")
    return rows.select("id", "actual", "trained_model_date_used", F.round(p + q, 9).alias("p_sum"),
                       (p.between(0, 1) & F.col("model_prediction").isNotNull()).alias("is_probability"))


register("predict_batch", f"{W(O.APPROACHES)}SELECT {_CHECKED} FROM approaches")(
    lambda s, sf: _checked(MLX.predict_batch(appr(s, sf), _stack(s, sf)[0], str(TRAINED_AT))))


def _predict_records(s, sf):
    """The two fastest approaches as a caller's records (two rows are the feature here)."""
    model, _ = _stack(s, sf)
    rows = [r.asDict() for r in appr(s, sf).orderBy(F.desc("relative_velocity_kps"), "id", "epoch_date_close_approach").limit(2).collect()]
    return _checked(MLX.predict_records(s, rows, model, str(TRAINED_AT)))


register("predict_records", f"{W(O.APPROACHES)}SELECT {_CHECKED} FROM (SELECT * FROM approaches ORDER BY relative_velocity_kps DESC, id, "
                            f"epoch_date_close_approach LIMIT 2)")(_predict_records)


def _trained_paths(s, sf) -> Paths:
    root = scratch_path(s, f"models-{uuid.uuid4().hex}")
    paths = Paths(approaches=f"{root}/approaches", predictions=f"{root}/predictions", training_logs=f"{root}/logs", artifacts=f"{root}/artifacts", models=f"{root}/models")
    appr(s, sf).write.parquet(paths.approaches)
    job_train(s, paths, "stack_model", TRAINED_AT, "run-fixture", params=PARAMS)
    return paths


def _job_predict(s, sf):
    """Train and save, then windows over the landed feed -> newest model -> append."""
    paths = _trained_paths(s, sf)
    landing = scratch_path(s, f"landing-{uuid.uuid4().hex}")
    FX.land_feed(appr(s, sf), landing)
    return _checked(job_predict(s, landing, paths, SCORE_FROM, SCORE_TO))


register("job_predict", f"{W(O.APPROACHES)}SELECT {_CHECKED} FROM approaches WHERE close_approach_date BETWEEN '{SCORE_FROM}' AND '{SCORE_TO}'")(_job_predict)


def _registry(s, sf):
    """The saved pipeline is found through the newest rows, loaded, and scores all rows."""
    paths = _trained_paths(s, sf)
    logs = s.read.parquet(paths.training_logs)
    scored = MLX.predict_batch(appr(s, sf), load_best_model(logs), str(TRAINED_AT))
    newest = latest_artifact(s.read.parquet(paths.artifacts)).select("name", "created_at")
    log = logs.select("run_id", "training_date", F.col("accuracy").between(0.5, 1.0).alias("learned"))
    return newest.crossJoin(log).crossJoin(scored.agg(F.count("probability_being_truely_hazardous").alias("scored_rows")))


register("model_registry", f"{W(O.APPROACHES)}SELECT 'stack_model' AS name, '2000-06-20 00:00:00' AS created_at, 'run-fixture' AS run_id, "
                           f"'2000-06-20 00:00:00' AS training_date, true AS learned, count(*) AS scored_rows FROM approaches")(_registry)
