"""ML operators on small fixtures: exact kNN against brute force, SMOTE parity and convexity,
Tomek links, split sizes per label, the bounded fit sample, training, persistence and prediction."""

import datetime as dt
import json
import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF001, SF0001
from skyrisk.catalog import appr
from skyrisk.operators import ml as M
from skyrisk.operators import neighbors
from skyrisk.operators.features import stratified_split
from skyrisk.operators.ml import knn, smote, tomek_links
from skyrisk.plans.jobs import Paths, job_train
from skyrisk import session
from skyrisk.schemas import NUMERIC_COLUMNS
from skyrisk.session import cut_lineage
from skyrisk.sources.ingest import append_table
from skyrisk.sources.registry import load_best_model


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    X = np.vstack([rng.normal(size=(120, 3)), np.repeat(rng.normal(size=(1, 3)), 15, axis=0)])
    rows = [(f"k{i}", *map(float, X[i]), float(i % 4 == 0)) for i in range(len(X))]
    return X, spark.createDataFrame(rows, "row_key string, a double, b double, c double, label double")


@pytest.mark.parametrize("rows", [2_000, 10])
def test_knn_exact(points, rows, monkeypatch):
    monkeypatch.setattr(neighbors, "LEAST_CELL_ROWS", rows)
    X, df = points
    got = knn(df, 4, ["a", "b", "c"]).toPandas()
    D = ((X[:, None, :] - X[None, :, :]) ** 2).sum(-1)
    np.fill_diagonal(D, np.inf)
    for i in range(len(X)):
        g = got[got.q == f"k{i}"].sort_values("nn_rank")
        want = sorted((d, f"k{j}") for j, d in enumerate(D[i]) if j != i)[:4]
        assert np.allclose(g.d2.values, [d for d, _ in want], rtol=1e-9, atol=1e-12), i


@pytest.mark.parametrize(("k", "visit"), [(1, 100_000), (3, 7), (7, 50)])
def test_knn_with_ties_copies_and_bad_coordinates(spark, monkeypatch, k, visit):
    """Points on a small grid, so that most distances are equal, a third of all rows in one point."""
    monkeypatch.setattr(neighbors, "LEAST_CELL_ROWS", 15)
    monkeypatch.setattr(neighbors, "CELL_ROWS", 20)
    monkeypatch.setattr(neighbors, "VISIT_ROWS", visit)
    rng = np.random.default_rng(k)
    xy = np.vstack([rng.integers(0, 9, size=(160, 2)), np.full((80, 2), 4), [[100, 100]], [[-0.0, 0.0]]]).astype(float)
    rows = [(f"k{i:04d}", float(a), float(b)) for i, (a, b) in enumerate(xy)]
    bad = [("n1", None, 1.0), ("n2", float("nan"), 1.0), ("n3", 1.0, float("inf"))]
    df = spark.createDataFrame(rows + bad, "row_key string, x double, y double").repartition(5)
    got = {}
    for r in knn(df, k, ["x", "y"]).collect():
        got.setdefault(r.q, {})[r.nn_rank] = (r.d2, r.c)
    assert set(got) == {r[0] for r in rows}
    for i, (q, *_) in enumerate(rows):
        d = ((xy[i] - xy) ** 2).sum(1)
        want = sorted((d[j], rows[j][0]) for j in range(len(rows)) if j != i)[:k]
        assert [got[q][r] for r in range(1, k + 1)] == want, q


def test_knn_of_a_large_cell_of_copies(spark, monkeypatch):
    """Half of all rows in one point: its copies beyond k + 1 stay out of the cell and get the same answers."""
    monkeypatch.setattr(neighbors, "LEAST_CELL_ROWS", 15)
    monkeypatch.setattr(neighbors, "CELL_ROWS", 20)
    rng = np.random.default_rng(5)
    xy = np.vstack([rng.integers(0, 30, size=(200, 2)), np.full((200, 2), 4)]).astype(float)
    rows = [(f"k{i:04d}", float(a), float(b), i % 3) for i, (a, b) in enumerate(xy[rng.permutation(400)])]
    df = spark.createDataFrame(rows, "row_key string, x double, y double, label int").repartition(6)
    at = np.array([r[1:3] for r in rows])
    got = {r.vid: (r.tag, [(x.d2, x.c, x.ctag) for x in r.pairs]) for r in neighbors.neighbor_lists(df, 3, ["x", "y"], tag_col="label").collect()}
    assert len(got) == 400
    for i, (q, _, _, label) in enumerate(rows):
        d = ((at[i] - at) ** 2).sum(1)
        assert got[q] == (label, sorted((d[j], rows[j][0], rows[j][3]) for j in range(400) if j != i)[:3]), q


def _held_rows(monkeypatch, *modules):
    """Counts the rows that are written to the checkpoint folder."""
    held = []

    def count(df):
        out = cut_lineage(df)
        held.append(out.count())
        return out

    for module in modules:
        monkeypatch.setattr(module, "cut_lineage", count)
    return held


def test_links_are_found_without_copies_of_all_rows(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(f"k{i}", *map(float, p), float(p[0] > 0.5)) for i, p in enumerate(rng.uniform(size=(3000, 2)))]
    df = spark.createDataFrame(rows, "row_key string, x double, y double, label double")
    held = _held_rows(monkeypatch, neighbors)
    links = tomek_links(df, ["x", "y"])
    assert links.count() > 0 and sum(held) < len(rows)  # at least five copies of them before


def test_smote_takes_lists_once(spark, monkeypatch):
    """Minority rows are held with their places and with their neighbours, and new rows need no range to be joined with."""
    rng = np.random.default_rng(9)
    rows = [(f"k{i}", *map(float, p), float(i % 5 == 0)) for i, p in enumerate(rng.uniform(size=(1000, 2)))]
    df = spark.createDataFrame(rows, "row_key string, x double, y double, label double")
    held = _held_rows(monkeypatch, neighbors, M)
    out = smote(df, ["x", "y"])
    assert sum(held) < 3 * 200 and "Range" not in out._jdf.queryExecution().optimizedPlan().toString()
    want = sorted(map(tuple, out.collect()))
    monkeypatch.setattr(M, "NEW_OF_ONE", 0)
    assert sorted(map(tuple, smote(df, ["x", "y"]).collect())) == want and len(want) == 1600


def test_training_holds_each_set_of_rows_once(spark, monkeypatch):
    a = appr(spark, SF0001)
    held = _held_rows(monkeypatch, neighbors, M)
    got = M.training_inputs(a)
    resampled = got.rows.count()
    assert got.search.count() > 0 and sum(n >= resampled for n in held) <= 3  # the split, and both sets before links are cut


def _tables(spark):
    from skyrisk.session import checkpoint_dir

    folder = checkpoint_dir(spark).removeprefix("file:")
    return {x for x in os.listdir(folder) if x.startswith("stored-")}


def test_working_tables_are_deleted(spark):
    """What is left of resampling: its rows and the links.  Places, neighbours and answers are deleted as soon as they are used."""
    rng = np.random.default_rng(9)
    rows = [(f"k{i}", *map(float, p), float(i % 5 == 0)) for i, p in enumerate(rng.uniform(size=(1000, 2)))]
    df = spark.createDataFrame(rows, "row_key string, x double, y double, label double")
    before = _tables(spark)
    out = M.smote_tomek(df, ["x", "y"])
    assert len(_tables(spark) - before) == 2 and 0 < out.count() <= 1600
    session.unstore(out)
    assert _tables(spark) == before


def test_fewer_learners_at_a_time_of_many_rows(spark, monkeypatch):
    assert M.fits_at_a_time(0) == M.fits_at_a_time(800_000) == M.FITS
    assert M.fits_at_a_time(5_000_000) == 3 and M.fits_at_a_time(1 << 40) == 1
    rows = spark.createDataFrame([(f"k{i}", float(i % 17), float(i % 17 > 8)) for i in range(200)], "row_key string, f0 double, label double")
    at_a_time, each = [], M._side_by_side
    monkeypatch.setattr(M, "_side_by_side", lambda s, tasks, run, fits: at_a_time.append(fits) or each(s, tasks, run, fits))
    monkeypatch.setattr(M, "FIT_ROWS", 400)
    before = _tables(spark)
    M.train_stack(rows, ["f0"], [{"trees": 1, "depth": 1, "step": 0.1}], {}, folds=2, meta_trees=2)
    assert at_a_time == [2] and _tables(spark) == before


def test_scoring_is_dealt_over_the_cores(spark):
    a = appr(spark, SF0001).coalesce(1)
    fitted = {"medians": {c: 1.0 for c in NUMERIC_COLUMNS}, "mean": {c: 0.0 for c in NUMERIC_COLUMNS},
              "std": {c: 1.0 for c in NUMERIC_COLUMNS}, "categories": M.CATEGORIES}
    out = M.FeatureStage(fitted=json.dumps(fitted)).transform(a)
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == a.count() and len(sizes) >= spark.sparkContext.defaultParallelism and max(sizes) < a.count() / 4


def test_knn_of_few_points(spark):
    df = spark.createDataFrame([("a", 0.0), ("b", 2.0)], "row_key string, x double")
    assert sorted((r.q, r.c, r.d2, r.nn_rank) for r in knn(df, 5, ["x"]).collect()) == [("a", "b", 4.0, 1), ("b", "a", 4.0, 1)]
    assert knn(df.limit(1), 5, ["x"]).collect() == [] and knn(df.limit(0), 5, ["x"]).collect() == []


def test_visits_grow_in_proportion(spark, monkeypatch):
    """Four times the points of one density: visits for each point stay the same, within a fifth."""
    monkeypatch.setattr(neighbors, "CELL_ROWS", 250)
    each = []
    for n in (2_000, 8_000):
        rng = np.random.default_rng(1)
        side = (n / 2_000) ** 0.5
        rows = [(f"k{i}", [f"k{i}"], *map(float, p)) for i, p in enumerate(rng.uniform(0, side, size=(n, 2)))]
        points = spark.createDataFrame(rows, "vid string, keys array<string>, x double, y double")
        placed, own, visits = neighbors.cell_visits(points, 5, ["x", "y"])
        assert placed.groupBy("cell").count().where("count > 1000").count() == 0
        each.append(visits.count() / n)
    assert each[1] < 1.2 * each[0] + 0.1


def test_knn_ties_go_to_the_smallest_key(spark):
    df = spark.createDataFrame([(f"p{i:03d}", 1.0) for i in range(40)], "row_key string, x double").repartition(7)
    got = {r.q: r.c for r in knn(df, 1, ["x"]).collect()}
    assert got == {f"p{i:03d}": "p000" if i else "p001" for i in range(40)}


def test_smote_parity_and_convexity(points):
    X, df = points
    out = smote(df, ["a", "b", "c"], k=3)
    counts = {r.label: r["count"] for r in out.groupBy("label").count().collect()}
    assert counts[0.0] == counts[1.0]
    syn = out.where(F.col("row_key").contains(":s")).toPandas()
    mins = X[[i for i in range(len(X)) if i % 4 == 0]]
    lo, hi = mins.min(0), mins.max(0)
    assert ((syn[["a", "b", "c"]].values >= lo - 1e-12) & (syn[["a", "b", "c"]].values <= hi + 1e-12)).all()
    assert (syn.label == 1.0).all()


def test_tomek_links_are_mutual_and_cross_label(spark):
    rows = [("a", 0.0, 0.0), ("b", 0.1, 1.0), ("c", 5.0, 0.0), ("d", 5.05, 0.0), ("e", 9.0, 1.0)]
    df = spark.createDataFrame(rows, "row_key string, x double, label double")
    assert sorted(r.row_key for r in tomek_links(df, ["x"]).collect()) == ["a", "b"]


def test_stratified_split_sizes(spark):
    df = spark.createDataFrame([(i, i % 5 == 0) for i in range(503)], "k long, y boolean")
    out = stratified_split(df, "y", ["k"], 0.2, 42)
    got = {(r.y, r.is_test): r["count"] for r in out.groupBy("y", "is_test").count().collect()}
    n_true, n_false = 101, 402
    assert got[(True, True)] == int(np.ceil(0.2 * n_true)) and got[(False, True)] == int(np.ceil(0.2 * n_false))


def test_rows_without_a_label_are_split_too(spark):
    df = spark.createDataFrame([(i, None if i % 2 else True) for i in range(100)], "k long, y boolean")
    got = {(r.y, r.is_test): r["count"] for r in stratified_split(df, "y", ["k"], 0.2, 42).groupBy("y", "is_test").count().collect()}
    assert got == {(None, True): 10, (None, False): 40, (True, True): 10, (True, False): 40}


def test_two_value_keys_are_not_shuffled_on(spark):
    df = spark.range(1000).selectExpr("id AS k", "id % 7 = 0 AS y")
    plan = stratified_split(df, "y", ["k"])._jdf.queryExecution().optimizedPlan().toString().splitlines()
    top = next(x for x in plan if "Join" in x)  # of the rows with the thresholds
    assert "LeftOuter" in top and "rightHint=(strategy=broadcast)" in top


def test_fit_sample_keeps_shares_and_unique_keys(spark):
    df = spark.createDataFrame([(f"k{i % 900}", float(i % 10 == 0), float(i)) for i in range(1000)], "row_key string, label double, f0 double")
    few = M.fit_sample(df, 200)
    n = {r.label: r["count"] for r in few.groupBy("label").count().collect()}
    assert 18 <= n[1.0] <= 24 and 175 <= n[0.0] <= 200  # a key that repeats ties with itself
    every = M.fit_sample(df, 10_000)
    assert every.count() == 1000 and every.select("row_key").distinct().count() == 1000


def test_smote_with_few_minority_rows(spark):
    rows = [(f"m{i}", float(i), 1.0) for i in range(3)] + [(f"z{i}", 100.0 + i, 0.0) for i in range(500)]
    out = smote(spark.createDataFrame(rows, "row_key string, a double, label double"), ["a"])
    assert {r.label: r["count"] for r in out.groupBy("label").count().collect()} == {0.0: 500, 1.0: 500}
    assert out.select("row_key").distinct().count() == 1000


def test_a_lone_minority_row_is_repeated(spark):
    rows = [("m", 7.0, 1.0)] + [(f"z{i}", float(i), 0.0) for i in range(5)]
    out = smote(spark.createDataFrame(rows, "row_key string, a double, label double"), ["a"]).collect()
    assert sorted((r.row_key, r.a) for r in out if r.label == 1.0) == [("m", 7.0), *((f"m:s{j}", 7.0) for j in range(4))]


def test_smote_query_takes_all_training_rows(spark):
    from skyrisk.catalog_ml import _split
    from __spark_entry__ import queries

    train = {r.y: r["count"] for r in _split(spark, SF001)[0].where("not is_test").groupBy(F.col(M.TARGET_COLUMN).alias("y")).count().collect()}
    most = max(train.values())
    assert sum(train.values()) > M.MAX_SEARCH_ROWS
    assert {r.label: r["count"] for r in queries()["smote"](spark, SF001).groupBy("label").count().collect()} == {0.0: most, 1.0: most}


def test_training_reads_the_approaches_once(spark):
    from skyrisk.catalog import appr

    split, medians = M.split_inputs(M.stored_inputs(appr(spark, SF001)))
    files = split.inputFiles()
    assert len(files) >= spark.sparkContext.defaultParallelism and all("/stored-" in f for f in files)
    assert split.count() == appr(spark, SF001).count() and medians.count() == 9


def test_places_are_the_rank_in_the_order(spark):
    df = spark.createDataFrame([(f"k{i}", (i * 7919) % 1000) for i in range(1000)], "row_key string, h int").repartition(5)
    got = M._placed(df, [F.col("h"), F.col("row_key")]).collect()
    assert sorted(r._at for r in got) == list(range(1000)) and all(r._at == r.h for r in got)


SMALL = [{"trees": 6, "depth": 4, "step": 0.4, "gain": 1e-6}, {"trees": 5, "depth": 3, "step": 0.4}]


@pytest.fixture(scope="module")
def trained(spark):
    from skyrisk.session import scratch_path

    root = scratch_path(spark, f"ml-test-{np.random.default_rng().integers(1 << 40)}")
    paths = Paths(approaches=f"{root}/approaches", training_logs=f"{root}/logs", artifacts=f"{root}/artifacts", models=f"{root}/models")
    append_table(appr(spark, SF0001), paths.approaches)  # an append, as in a job's session, must not break training
    log = job_train(spark, paths, "stack", dt.datetime(2000, 6, 20), "r1", params=SMALL, meta_trees=10).collect()
    return paths, log


def test_training_reaches_its_floor(trained):
    (row,) = trained[1]
    assert row.accuracy > 0.95 and row.f1_score > 0.85


def test_tuning_takes_the_best_candidate(spark):
    rows = spark.createDataFrame([(f"k{i}", float(i % 17), float(i % 17 > 8)) for i in range(400)], "row_key string, f0 double, label double")
    spaces = [[{"trees": 1, "depth": 1, "step": 0.1, "gain": 10.0}, SMALL[0]], [SMALL[1]]]
    best = M.tune(rows, ["f0"], spaces)
    assert best[0]["trees"] == 6 and best[0]["cv_accuracy"] == 1.0 and best[1]["trees"] == 5


def test_saved_model_predicts_the_same_in_a_new_session(spark, trained):
    paths, _ = trained
    here = M.predict_batch(spark.read.parquet(paths.approaches), load_best_model(spark.read.parquet(paths.training_logs)), "d")
    want = sorted(round(r[0], 12) for r in here.select("probability_being_truely_hazardous").collect())
    code = f"""
import json
from skyrisk.session import local_session
from skyrisk.operators import ml as M
from skyrisk.sources.ingest import append_table
from skyrisk.sources.registry import load_best_model
s = local_session(2, 4, app="other")
out = M.predict_batch(s.read.parquet({paths.approaches!r}), load_best_model(s.read.parquet({paths.training_logs!r})), "d")
print("GOT", json.dumps(sorted(round(r[0], 12) for r in out.select("probability_being_truely_hazardous").collect())))
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    got = json.loads(next(x for x in done.stdout.splitlines() if x.startswith("GOT"))[4:])
    assert got == want


def test_zero_velocity_and_missing_values_are_predicted(spark, trained):
    model = load_best_model(spark.read.parquet(trained[0].training_logs))
    row = spark.read.parquet(trained[0].approaches).first().asDict()
    records = [row, row | {"relative_velocity_kps": 0.0}, row | {"miss_distance_km": None}, row | {"miss_distance_km": float("inf"), "is_sentry_object": None}]
    out = M.predict_records(spark, records, model, "d").collect()
    assert len(out) == 4 and all(0 <= r.probability_being_truely_hazardous <= 1 for r in out)


def test_nothing_to_load(spark, trained):
    assert load_best_model(spark.read.parquet(trained[0].training_logs).limit(0)) is None
