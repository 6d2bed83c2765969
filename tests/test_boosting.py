"""Boosted trees: the same as Spark's where the candidates are, the same in one task as level by level, whatever the partitions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from conftest import SF001
from skyrisk import catalog_ml as C
from skyrisk.operators import boosting as B
from skyrisk.operators import ml as M
from skyrisk.session import scratch_path

NAMES = ["f0", "f1", "f2"]
P = {"trees": 7, "depth": 4, "step": 0.3, "gain": 1e-6}


@pytest.fixture(scope="module")
def rows(spark):
    """Few values for each feature, so that all midpoints are candidates."""
    rng = np.random.default_rng(4)
    x = np.stack([rng.integers(0, 9, 3000), rng.integers(0, 25, 3000), rng.integers(0, 2, 3000)], 1).astype(float)
    y = (x[:, 0] * 2 + x[:, 1] * x[:, 2] + rng.normal(0, 3, 3000) > 16).astype(float)
    frame = pd.DataFrame({M.KEY: [f"k{i}" for i in range(3000)], **{c: x[:, j] for j, c in enumerate(NAMES)}, M.LABEL: y})
    return spark.createDataFrame(frame).repartition(5).persist()


def _scores(df, column):
    return {r[0]: r[1] for r in df.select(M.KEY, vector_to_array(column)[1]).collect()}


def test_trees_are_those_of_gbt_classifier(spark, rows):
    spark_trees = GBTClassifier(featuresCol="x", maxIter=7, maxDepth=4, stepSize=0.3, minInfoGain=1e-6, maxBins=32, seed=1)
    x = VectorAssembler(inputCols=NAMES, outputCol="x").transform(rows)
    want = _scores(spark_trees.fit(x).transform(x), "probability")
    binned = M._binned(rows, NAMES, 3, 42)
    (trees,) = B.fit(binned, P, [B.EVERY])
    path = scratch_path(spark, f"boosted-{np.random.default_rng().integers(1 << 40)}")
    PipelineModel([B.BoostedTrees(trees=trees.packed(), inputCols=NAMES, outputCol="p")]).write().save(path)
    got = _scores(PipelineModel.load(path).transform(rows), "p")
    assert len(got) == 3000 and max(abs(got[k] - want[k]) for k in want) < 1e-6
    binned.drop()


def test_many_rows_give_the_trees_of_few(spark, rows, monkeypatch):
    """Level by level over blocks, from other partitions, against a task for each fit."""
    folds = [B.EVERY, 0, 1, 2]
    few = M._binned(rows, NAMES, 3, 42)
    want, right = B.fit(few, P, folds), B.accuracies(few, P, range(3))
    monkeypatch.setattr(B, "WHOLE_BYTES", 10)
    monkeypatch.setattr(B, "BLOCK_ROWS", 100)
    monkeypatch.setattr(B, "FILE_BLOCKS", 4)
    many = M._binned(rows.repartition(3, "f1"), NAMES, 3, 42)
    assert many.whole is None and many.blocks.count() > 20
    got = B.fit(many, P, folds)
    for a, b in zip(want, got, strict=True):
        assert (a.feature == b.feature).all() and (a.cut == b.cut).all() and np.allclose(a.leaf, b.leaf)
    assert B.accuracies(many, P, range(3)) == pytest.approx(right)
    models = [dict(zip(range(3), got[1:], strict=True))]
    assert B.held_out(many, models, ["p0"], M.LABEL).agg(F.avg(((F.col("p0") > 0.5) == (F.col(M.LABEL) == 1)).cast("int"))).first()[0] > 0.7
    few.drop()
    many.drop()


def test_a_learner_is_one_job_of_few_rows(spark, rows):
    """``GBTClassifier`` started a job for each level of each tree of each fold."""
    binned = M._binned(rows, NAMES, 3, 42)
    spark.sparkContext.setJobGroup("one-learner", "")
    try:
        B.fit(binned, P, [B.EVERY, 0, 1, 2])
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("one-learner")) == 1
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        binned.drop()


def test_bad_rows_are_refused(spark):
    good = [(f"k{i}", float(i), float(i > 3)) for i in range(8)]
    kinds = f"{M.KEY} string, f0 double, {M.LABEL} double"
    for bad in ([("x", None, 1.0)], [("x", float("nan"), 1.0)], [("x", 1.0, 2.0)], [("x", 1.0, None)]):
        with pytest.raises(Exception, match="null or no number|neither 0 nor 1"):
            M._binned(spark.createDataFrame(good + bad, kinds), ["f0"], 3, 42)
    with pytest.raises(ValueError, match="no rows"):
        M._binned(spark.createDataFrame([], kinds), ["f0"], 3, 42)


def test_one_label_and_one_value(spark):
    rows = spark.createDataFrame([(f"k{i}", 5.0, 1.0) for i in range(20)], f"{M.KEY} string, f0 double, {M.LABEL} double")
    binned = M._binned(rows, ["f0"], 2, 42)
    (trees,) = B.fit(binned, P, [B.EVERY])
    assert (B.probability(trees.margins(np.zeros((1, 3), np.uint8))) > 0.8).all()
    binned.drop()


def test_the_search_query_is_whole(spark, monkeypatch):
    """Ten candidates of 100 to 500 trees for each learner, on all resampled training rows."""
    asked = []

    def seen(df, names, spaces):
        asked.append((df.count(), spaces))
        return [space[0] | {"cv_accuracy": 1.0} for space in spaces]

    monkeypatch.setattr(M, "tune", seen)
    assert C._tune(spark, SF001).count() == 2
    ((n, spaces),) = asked
    assert n > 48_050 > M.MAX_SEARCH_ROWS  # rows of sf0.01 to train on, before resampling
    assert [len(space) for space in spaces] == [M.TUNE_TRIALS] * 2 == [10, 10]
    assert all(100 <= p["trees"] <= 500 and 4 <= p["depth"] <= 10 for space in spaces for p in space)
    assert spaces[1] != spaces[0] and max(p["trees"] for p in spaces[0]) > 250
