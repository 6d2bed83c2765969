"""Hazard classifier: training frame, SMOTE / Tomek links, random-search tuning, 5-fold stacking,
evaluation and batch prediction, with boosted trees (``boosting``) and a ``pyspark.ml`` forest.

What is fitted, and on what: medians, scaling, categories, the resampled set, both boosted learners, their
out-of-fold probabilities and the forest over them on all training rows.  ``tune`` searches on the rows it is given;
``job_training`` gives it ``fit_sample``, at most ``MAX_SEARCH_ROWS`` labelled rows (a documented parameter).  A trained model is one ``PipelineModel``: features
(transform, then impute with the saved medians, scale, encode), two boosted learners, and a random forest over
their probabilities; it is written to shared storage and loaded by the newest training log row.

Randomness is deterministic per row (md5 of seed and key), so splits, folds and synthetic rows are
reproducible and independent of partitioning.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark import inheritable_thread_target, keyword_only
from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyrisk.functions.columns import finite_or_null, uniform
from skyrisk.functions.quantiles import order_statistics
from skyrisk.operators import boosting
from skyrisk.operators.features import (engineered_features, fit_medians, fit_standard, impute_median, skew_transform,
                                        standard_scale, stratified_split)
from skyrisk.operators.metrics import binary_metrics
from skyrisk.operators.neighbors import knn, neighbor_lists, tomek_links
from skyrisk.schemas import (APPROACH, CATEGORICAL_COLUMNS, FEATURE_COLUMNS, META_TREES, NUMERIC_COLUMNS, SEED, SMOTE_K,
                             STACK_FOLDS, TARGET_COLUMN, TUNE_FOLDS, TUNE_TRIALS)
from skyrisk.session import cut_lineage, scratch_path, stored, unstore, working

KEY = "row_key"
LABEL = "label"
MAX_SEARCH_ROWS = 6_000
FITS = 8  # learners fitted at a time
FIT_ROWS = 16_000_000  # rows that the learners fitted at a time hold together, above one learner
SCORE_TASKS = 4  # tasks for each core when rows are scored
NEW_OF_ONE = 100
REPEATED_KEYS = 200_000
CATEGORIES = [False, True]

__all__ = ["knn", "tomek_links", "smote", "smote_tomek", "tune", "train_stack", "job_training"]


# ---------------------------------------------------------------- training frame (J3 front half)
def row_key(cols: Sequence[str] = ("id", "epoch_date_close_approach")) -> Column:
    return F.concat_ws(":", *[F.col(c).cast("string") for c in cols])


def model_features(n_numeric: int = len(NUMERIC_COLUMNS)) -> list[str]:
    return [f"f{i}" for i in range(n_numeric + len(CATEGORIES))]


def _inputs(df: DataFrame) -> DataFrame:
    """B1 and B5 with ``row_key``, ``id`` and the target where there is one."""
    eng = engineered_features(df, drop=False)
    keep = [c for c in ("id", TARGET_COLUMN) if c in eng.columns]
    return eng.select(row_key().alias(KEY), *keep, *[c for c in FEATURE_COLUMNS if c not in keep])


def prepare_features(df: DataFrame, medians: DataFrame | None = None) -> DataFrame:
    """Training order: B1 -> B5 -> B6 (+-inf and NULL to the median) -> B7 (ln / sqrt)."""
    return _prepared(_inputs(df), medians)


def _prepared(inputs: DataFrame, medians: DataFrame | None) -> DataFrame:
    return skew_transform(impute_median(inputs, NUMERIC_COLUMNS, medians))


def stored_inputs(approaches: DataFrame) -> DataFrame:
    """Key, target and engineered features of all approaches, stored once for the many passes of training.  A table
    of fewer files than there are cores (so a small one) is dealt out over all of them."""
    held = stored(_inputs(approaches))
    cores = approaches.sparkSession.sparkContext.defaultParallelism
    if len(held.inputFiles()) >= cores:
        return held
    dealt = stored(held.repartition(cores))
    unstore(held)
    return dealt


def prepare_for_prediction(df: DataFrame, medians: dict[str, float]) -> DataFrame:
    """Prediction order: transform, then whatever is not finite (ln of a zero velocity too) to the
    median, which is transformed alike."""
    x = skew_transform(_inputs(df))
    new = {c: F.coalesce(finite_or_null(F.col(c).cast("double")), F.lit(medians[c])) for c in NUMERIC_COLUMNS}
    return x.withColumns(new)


def _skewed(medians: dict[str, float]) -> dict[str, float]:
    how = {"diameter_range": math.log, "relative_velocity_kps": math.log, "miss_distance_km": math.sqrt}
    return {c: how[c](m) if c in how and m > 0 else m for c, m in medians.items()}


def fit_features(train: DataFrame, medians: DataFrame) -> dict:
    """The fitted numbers of the feature stage: transformed medians, means, deviations, categories."""
    stats = fit_standard(train, NUMERIC_COLUMNS).first()
    return {"medians": _skewed({r["feature"]: r["median"] for r in medians.collect()}),  # a row for each of nine columns
            "mean": {c: stats[f"_mean_{c}"] for c in NUMERIC_COLUMNS}, "std": {c: stats[f"_std_{c}"] for c in NUMERIC_COLUMNS},
            "categories": CATEGORIES}


def encode_features(df: DataFrame, fitted: dict) -> DataFrame:
    """Scaled and one-hot columns ``f0`` ... from prepared rows; an unknown category raises."""
    flag = F.col(CATEGORICAL_COLUMNS[0])
    known = F.when(flag.isNull() | flag.isin(fitted["categories"]), flag).otherwise(
        F.raise_error(F.lit(f"unknown category in {CATEGORICAL_COLUMNS[0]}")))
    names = model_features()
    cols = [((F.col(c) - F.lit(fitted["mean"][c])) / F.lit(fitted["std"][c])).alias(n) for c, n in zip(NUMERIC_COLUMNS, names)]
    cols += [F.coalesce((known == F.lit(v)).cast("double"), F.lit(0.0)).alias(n) for v, n in zip(fitted["categories"], names[len(NUMERIC_COLUMNS):])]
    keep = [c for c in (KEY, "id", TARGET_COLUMN) if c in df.columns]
    out = df.select(*keep, *cols)
    return out.withColumn(LABEL, F.col(TARGET_COLUMN).cast("int").cast("double")) if TARGET_COLUMN in df.columns else out


def training_split(df: DataFrame, seed: int = SEED, test_size: float = 0.2, medians: DataFrame | None = None) -> DataFrame:
    """Prepared rows with ``is_test`` (stratified on the target)."""
    return stratified_split(prepare_features(df, medians), TARGET_COLUMN, [KEY], test_size, seed)


def split_inputs(inputs: DataFrame, seed: int = SEED, test_size: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """``training_split`` of ``stored_inputs``, and their medians.  The split is a plain pass over the stored rows; its
    bounds and the medians need nothing of each other and are found side by side."""
    both = [lambda: cut_lineage(fit_medians(inputs, NUMERIC_COLUMNS, is_stored=True)),
            lambda: stratified_split(inputs, TARGET_COLUMN, [KEY], test_size, seed)]
    medians, split = _side_by_side(inputs.sparkSession, both, lambda step: step(), len(both))
    return _prepared(split, medians), medians


def _hash(seed: int, key: str) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key))), 1, 15), 16, 10).cast("long")


def fit_sample(df: DataFrame, max_rows: int = MAX_SEARCH_ROWS, seed: int = SEED, id_col: str = KEY, label_col: str = LABEL) -> DataFrame:
    """At most ``max_rows`` labelled rows to fit on: of each label its share of them (rounded down, one at
    least), those of least md5(seed + 1, key); keys made unique."""
    labelled = df.where(F.col(label_col).isNotNull()).withColumn("_h", _hash(seed + 1, id_col))
    counts = {r[label_col]: r["n"] for r in labelled.groupBy(label_col).agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    total = sum(counts.values())
    if total > max_rows:
        places = [(y, max(1, n * max_rows // total) - 1) for y, n in counts.items()]
        targets = df.sparkSession.createDataFrame(places, f"{label_col} double, pos long")
        limit = order_statistics(labelled.select(label_col, "_h"), [label_col], "_h", targets).select(label_col, F.col("value").alias("_limit"))
        labelled = labelled.join(F.broadcast(limit), label_col).where(F.col("_h") <= F.col("_limit")).drop("_limit")
    return unique_rows(labelled.select(*df.columns), id_col, label_col)


def unique_rows(df: DataFrame, id_col: str = KEY, label_col: str = LABEL) -> DataFrame:
    """The labelled rows; a key that repeats gets a suffix, so keys are unique.  Hashes of keys tell which may repeat, so that
    only their rows are sorted by key, unless they are many."""
    labelled, code = df.where(F.col(label_col).isNotNull()), F.xxhash64(id_col)
    repeated = stored(labelled.groupBy(code.alias("_code")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select("_code"))
    n = repeated.count()
    if not n or n > REPEATED_KEYS:
        unstore(repeated)
    if not n:
        return labelled
    if n > REPEATED_KEYS:
        return _numbered(labelled, id_col)
    coded = labelled.withColumn("_code", code)
    some = coded.join(F.broadcast(repeated), "_code", "left_semi").select(*df.columns)
    return coded.join(F.broadcast(repeated), "_code", "left_anti").select(*df.columns).unionByName(_numbered(some, id_col))


def _numbered(df: DataFrame, id_col: str) -> DataFrame:
    again = F.row_number().over(Window.partitionBy(id_col).orderBy(*sorted(c for c in df.columns if c != id_col)))
    out = df.withColumn("_n", again)
    return out.withColumn(id_col, F.when(F.col("_n") > 1, F.concat(F.col(id_col), F.lit("#"), F.col("_n").cast("string"))).otherwise(F.col(id_col))).select(*df.columns)


def _placed(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """``df`` with ``_at``, each row's place in the order from 0: sorted by ranges, places within a range by
    the row's number there, and the ranges' sizes added up (a row for each range)."""
    held = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    before = held.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return held.withColumn("_p", part).join(F.broadcast(before), "_p").withColumn("_at", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).select(*df.columns, "_at")


# ---------------------------------------------------------------- SMOTE
def smote(df: DataFrame, feature_cols: Sequence[str], k: int = SMOTE_K, seed: int = SEED, id_col: str = KEY,
          label_col: str = LABEL) -> DataFrame:
    """Oversample the minority label to parity: synthetic row j starts from minority row j modulo their
    number (in md5 order) and moves by u toward one of its k nearest minority neighbours.  Originals are
    kept.  A minority row without a neighbour (the only one) is repeated as it is.  A minority row gives its new rows by
    itself, or, if there are more than ``NEW_OF_ONE`` for each, from a range, so few minority rows against many others
    cost no large row."""
    cols = list(feature_cols)
    spark = df.sparkSession
    counts = {r[label_col]: r["n"] for r in df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return df.select(id_col, *cols, label_col)
    minority = min(counts, key=lambda c: (counts[c], c))
    n_min, n_new = counts[minority], max(counts.values()) - counts[minority]
    mins = df.where(F.col(label_col) == F.lit(minority))
    placed = _placed(mins.select(id_col, *cols), [_hash(seed, id_col), F.col(id_col)])
    lists = neighbor_lists(mins, k, cols, id_col).where(F.size("pairs") > 0).select(
        F.col("vid").alias(id_col), F.transform("pairs", lambda x: x["c"]).alias("_nn"))
    starts = placed.join(lists, id_col, "left")
    if n_new <= NEW_OF_ONE * n_min:
        last = F.floor((F.lit(n_new - 1) - F.col("_at")) / F.lit(n_min))
        gen = starts.where(F.col("_at") < n_new).withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    else:
        gen = spark.range(n_new).select((F.col("id") % n_min).alias("_at"), F.floor(F.col("id") / n_min).alias("_j")).join(starts, "_at")
    new_key = F.concat(F.col(id_col), F.lit(":"), F.col("_j").cast("string"))
    pick = F.floor(uniform(seed + 2, new_key) * F.size("_nn")).cast("int")
    gen = gen.withColumns({"_c": F.coalesce(F.col("_nn")[pick], F.col(id_col)), "_u": uniform(seed, new_key)})
    near = mins.select(F.col(id_col).alias("_c"), *[F.col(c).alias(f"_n_{c}") for c in cols])
    new = gen.join(near, "_c").select(
        F.concat(F.col(id_col), F.lit(":s"), F.col("_j").cast("string")).alias(id_col),
        *[(F.col(c) + F.col("_u") * (F.col(f"_n_{c}") - F.col(c))).alias(c) for c in cols], F.lit(minority).cast("double").alias(label_col))
    return df.select(id_col, *cols, label_col).unionByName(new)


def smote_tomek(df: DataFrame, feature_cols: Sequence[str], k: int = SMOTE_K, seed: int = SEED, id_col: str = KEY,
                label_col: str = LABEL, done: Callable[[], None] = lambda: None) -> DataFrame:
    """``smote``, without the rows of Tomek links.  ``done`` is called when ``df`` is read no more."""
    with working(df.sparkSession):
        more = stored(smote(df, feature_cols, k, seed, id_col, label_col), result=True)
    done()
    return more.join(tomek_links(more, feature_cols, id_col, label_col), id_col, "left_anti")


# ---------------------------------------------------------------- tuning and stacking
def sample_params(trials: int = TUNE_TRIALS, seed: int = SEED, trees=(100, 500), depth=(4, 10), lr=(0.01, 0.2),
                  gain=(1e-6, 1e-3), regularised: bool = True) -> list[dict]:
    """Seeded random search space: trees, depth, log-uniform step and, for the regularised learner, a
    log-uniform least gain of a split (these trees, as Spark's, have no penalty on leaves; 0 for the other)."""
    rng = np.random.default_rng(seed)
    log_uniform = lambda lo, hi: float(math.exp(rng.uniform(math.log(lo), math.log(hi))))
    out = []
    for _ in range(trials):
        p = {"trees": int(rng.integers(trees[0], trees[1] + 1)), "depth": int(rng.integers(depth[0], depth[1] + 1)), "step": log_uniform(*lr)}
        out.append(p | {"gain": log_uniform(*gain) if regularised else 0.0})
    return out


def default_spaces(trials: int = TUNE_TRIALS, seed: int = SEED) -> list[list[dict]]:
    """The whole search of both learners."""
    return [sample_params(trials, seed), sample_params(trials, seed + 1, regularised=False)]


def _fold(folds: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.col(KEY), F.lit(seed)), F.lit(folds)).cast("int").alias("_fold")


def _binned(df: DataFrame, feature_cols: Sequence[str], folds: int, seed: int) -> boosting.Binned:
    held = stored(df.select(KEY, *feature_cols, LABEL, _fold(folds, seed)))
    rows = boosting.binned(held, feature_cols, LABEL, "_fold", KEY, seed)
    unstore(held)
    return rows


def fits_at_a_time(rows: int, fits: int = FITS) -> int:
    """Of few rows many learners are fitted side by side, as one alone leaves cores idle.  Each holds its binned rows and
    their margins, so of many rows fewer are fitted at a time."""
    return max(1, min(fits, FIT_ROWS // max(1, rows)))


def _side_by_side(spark: SparkSession, tasks: Sequence, run: Callable, fits: int) -> list:
    """``run`` of each task in order, ``fits`` at a time: each is a series of Spark jobs, which share the cluster."""
    with ThreadPoolExecutor(max_workers=max(1, min(fits, len(tasks)))) as pool:
        return list(pool.map(inheritable_thread_target(spark)(run), tasks))


def tune(df: DataFrame, feature_cols: Sequence[str], spaces: Sequence[list[dict]], folds: int = TUNE_FOLDS, seed: int = SEED,
         fits: int = FITS) -> list[dict]:
    """For each space its candidate of best mean accuracy over the folds (first of equal ones), with ``cv_accuracy``."""
    rows = _binned(df, feature_cols, folds, seed)
    flat = [p for space in spaces for p in space]
    # long fits first
    tasks = sorted(range(len(flat)), key=lambda t: -flat[t]["trees"] * flat[t]["depth"])
    at_a_time = fits if rows.whole is not None else fits_at_a_time(rows.rows, fits)
    scores = _side_by_side(df.sparkSession, tasks, lambda t: boosting.accuracies(rows, flat[t], range(folds)), at_a_time)
    rows.drop()
    found = {t: [a for a in x if a is not None] for t, x in zip(tasks, scores, strict=True)}
    accuracy = {t: sum(x) / len(x) if x else float("-inf") for t, x in found.items()}
    out, at = [], 0
    for space in spaces:
        best = max(range(at, at + len(space)), key=lambda t: (accuracy[t], -t))
        out.append(flat[best] | {"cv_accuracy": float(accuracy[best])})
        at += len(space)
    return out


class FeatureStage(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Approach rows -> ``f0`` ... : transform, impute with the saved medians, scale, encode.  The fitted numbers are one
    text parameter, so that ``PipelineModel`` can save it."""

    fitted = Param(Params._dummy(), "fitted", "the fitted numbers as text", TypeConverters.toString)

    @keyword_only
    def __init__(self, fitted: str = ""):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        fitted = json.loads(self.getOrDefault("fitted"))
        encoded = encode_features(prepare_for_prediction(dataset, fitted["medians"]), fitted)
        # scoring a row costs far more than moving it, and a table of one row group is read by one task
        tasks = SCORE_TASKS * dataset.sparkSession.sparkContext.defaultParallelism
        return encoded.repartition(tasks, KEY, *model_features()[:3])


def train_stack(df: DataFrame, feature_cols: Sequence[str], params: Sequence[dict], features: dict, folds: int = STACK_FOLDS,
                seed: int = SEED, meta_trees: int = META_TREES, fits: int = FITS) -> PipelineModel:
    """Out-of-fold probabilities of each learner, over all rows -> random forest; learners refitted on all rows.
    The model is written to the shared folder and loaded: a forest just fitted holds its training summary, and with
    it the session, which can't go to the tasks."""
    spark = df.sparkSession
    rows = _binned(df, feature_cols, folds, seed)
    cols, every = [f"p{t}" for t in range(len(params))], [boosting.EVERY, *range(folds)]
    fitted = _side_by_side(spark, params, lambda p: boosting.fit(rows, p, every), fits_at_a_time(rows.rows, fits))
    by_fold = [dict(zip(range(folds), trees[1:], strict=True)) for trees in fitted]
    stacked = stored(boosting.held_out(rows, by_fold, cols, LABEL))
    rows.drop()
    both = stacked.select(LABEL, *[x for c in cols for x in ((F.lit(1.0) - F.col(c)).alias(f"not_{c}"), F.col(c))])
    meta = RandomForestClassifier(featuresCol="features", labelCol=LABEL, numTrees=meta_trees, seed=seed).fit(
        VectorAssembler(inputCols=[x for c in cols for x in (f"not_{c}", c)], outputCol="features").transform(both).select(LABEL, "features"))
    unstore(stacked)
    stages = [FeatureStage(fitted=json.dumps(features)),
              *(boosting.BoostedTrees(trees=trees[0].packed(), inputCols=list(feature_cols), outputCol=c) for trees, c in zip(fitted, cols, strict=True)),
              VectorAssembler(inputCols=cols, outputCol="features"), meta]
    path = scratch_path(spark, f"stack-{uuid.uuid4().hex}")
    PipelineModel(stages).write().save(path)
    return PipelineModel.load(path)


def evaluate(model: PipelineModel, test: DataFrame) -> DataFrame:
    """Held-out predictions: (row_key, actual, model_prediction, p_true)."""
    out = model.transform(test)
    return out.select(KEY, F.col(TARGET_COLUMN).alias("actual"), (F.col("prediction") == 1.0).alias("model_prediction"),
                      vector_to_array("probability")[1].alias("p_true"))


# ---------------------------------------------------------------- prediction
def predict_batch(df: DataFrame, model: PipelineModel, model_date: str) -> DataFrame:
    """prediction_table rows of a batch of approaches (id as text, as the reference stores it)."""
    scored = model.transform(df)
    p = vector_to_array("probability")[1]
    actual = F.col(TARGET_COLUMN) if TARGET_COLUMN in df.columns else F.lit(None).cast("boolean")
    return scored.select(
        F.col("id").cast("string").alias("id"), actual.alias("actual"), (F.col("prediction") == 1.0).alias("model_prediction"),
        (F.lit(1.0) - p).alias("probability_being_falsely_hazardous"), p.alias("probability_being_truely_hazardous"),
        F.lit(model_date).alias("trained_model_date_used"))


def predict_records(spark: SparkSession, records: list[dict], model: PipelineModel, model_date: str) -> DataFrame:
    names = [f.name for f in APPROACH.fields]
    rows = [tuple(r.get(n) for n in names) for r in records]
    return predict_batch(spark.createDataFrame(rows, APPROACH), model, model_date)


# ---------------------------------------------------------------- end-to-end training
@dataclass
class TrainingResult:
    model: PipelineModel
    metrics: DataFrame
    predictions: DataFrame
    params: list[dict]


@dataclass
class FitInputs:
    rows: DataFrame      # resampled training rows, all of them; ``train_stack`` holds them
    search: DataFrame    # the bounded sample for the random search, resampled
    features: dict       # fitted numbers of the feature stage
    test_keys: DataFrame  # keys of held-out rows


def training_inputs(approaches: DataFrame, seed: int = SEED, max_search_rows: int = MAX_SEARCH_ROWS, resample: bool = True) -> FitInputs:
    inputs = stored_inputs(approaches)
    split, medians = split_inputs(inputs, seed)
    train = split.where(~F.col("is_test"))
    features = fit_features(train, medians)
    names = model_features()
    rows = stored(unique_rows(encode_features(train, features)).select(KEY, *names, LABEL))
    test_keys = stored(split.where(F.col("is_test")).select(KEY).distinct())
    unstore(inputs)
    spark = approaches.sparkSession
    if not resample:
        return FitInputs(rows, fit_sample(rows, max_search_rows, seed), features, test_keys)
    # the few rows are many short jobs, which fit in beside those of all rows
    sets = [lambda: rows, lambda: fit_sample(rows, max_search_rows, seed)]
    more, few = _side_by_side(spark, sets, lambda chosen: smote_tomek(chosen(), names, seed=seed), len(sets))
    unstore(rows)
    return FitInputs(more, few, features, test_keys)


def job_training(approaches: DataFrame, params: Sequence[dict] | None = None, trials: int = TUNE_TRIALS, folds: int = TUNE_FOLDS,
                 stack_folds: int = STACK_FOLDS, meta_trees: int = META_TREES, seed: int = SEED, max_search_rows: int = MAX_SEARCH_ROWS,
                 spaces: Sequence[list[dict]] | None = None) -> TrainingResult:
    """Split, resample, tune both learners on the search sample (unless ``params`` are given), stack them on all
    training rows, evaluate on all held-out rows."""
    got = training_inputs(approaches, seed, max_search_rows)
    names = model_features()
    if params is None:
        params = tune(got.search, names, spaces or default_spaces(trials, seed), folds, seed)
    model = train_stack(got.rows, names, params, got.features, stack_folds, seed, meta_trees)
    for done in (got.rows, got.search):
        unstore(done)
    test = approaches.withColumn(KEY, row_key()).join(got.test_keys, KEY, "left_semi").drop(KEY)
    predictions = stored(evaluate(model, test))
    return TrainingResult(model, binary_metrics(predictions), predictions, list(params))
