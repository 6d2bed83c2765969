"""Tomek links against brute force: ties, copies, several labels, labels that are null."""

import numpy as np
import pytest

from skyrisk.operators import neighbors
from skyrisk.operators.neighbors import tomek_links


def _brute(rows):
    xy, out = np.array([r[1:3] for r in rows]), set()
    near = []
    for i, r in enumerate(rows):
        d = ((xy[i] - xy) ** 2).sum(1)
        near.append(min((d[j], rows[j][0], j) for j in range(len(rows)) if j != i)[2] if len(rows) > 1 else None)
    for i, j in enumerate(near):
        if j is not None and near[j] == i and None not in (rows[i][3], rows[j][3]) and rows[i][3] != rows[j][3]:
            out.add(rows[i][0])
    return sorted(out)


@pytest.mark.parametrize(("seed", "labels", "visit"), [(0, [0.0, 0.0, 0.0, 1.0], 100_000), (1, [0.0, 1.0, 2.0, 2.0, None], 9), (2, [0.0, 1.0], 50)])
def test_links_equal_brute_force(spark, monkeypatch, seed, labels, visit):
    monkeypatch.setattr(neighbors, "LEAST_CELL_ROWS", 15)
    monkeypatch.setattr(neighbors, "CELL_ROWS", 20)
    monkeypatch.setattr(neighbors, "VISIT_ROWS", visit)
    rng = np.random.default_rng(seed)
    xy = np.vstack([rng.integers(0, 40, (300, 2)), rng.uniform(0, 40, (200, 2)), np.full((120, 2), 4.0), [[99, 99]]])  # a third on a grid, a large cell of copies
    xy = xy[rng.permutation(len(xy))]
    rows = [(f"k{i:04d}", float(a), float(b), labels[rng.integers(len(labels))]) for i, (a, b) in enumerate(xy)]
    df = spark.createDataFrame(rows, "row_key string, x double, y double, label double").repartition(5)
    got = sorted(r.row_key for r in tomek_links(df, ["x", "y"]).collect())
    assert got == _brute(rows) and got


def test_only_rows_of_rarer_labels_ask(spark, monkeypatch):
    """One row in ten is of the rarer label; the answers of the others are not looked for."""
    rng = np.random.default_rng(3)
    rows = [(f"k{i}", *map(float, p), float(i % 10 == 0)) for i, p in enumerate(rng.uniform(size=(2000, 2)))]
    asked, stored = [], neighbors.stored

    def count(df, **kw):
        out = stored(df, **kw)
        asked.append(out.count())
        return out

    monkeypatch.setattr(neighbors, "LEAST_CELL_ROWS", 100)
    monkeypatch.setattr(neighbors, "stored", count)
    got = sorted(r.row_key for r in tomek_links(spark.createDataFrame(rows, "row_key string, x double, y double, label double"), ["x", "y"]).collect())
    assert got == _brute(rows) and max(asked) < 500  # of all 2,000 rows before those that visit other cells were stored


def test_links_of_few_rows(spark):
    kinds = "row_key string, x double, label double"
    for rows in ([], [("a", 1.0, 0.0)], [("a", 1.0, None), ("b", 2.0, None)], [("a", 1.0, 1.0), ("b", 2.0, 1.0)]):
        assert tomek_links(spark.createDataFrame(rows, kinds), ["x"]).collect() == []
    assert sorted(r.row_key for r in tomek_links(spark.createDataFrame([("a", 1.0, 1.0), ("b", 2.0, 0.0)], kinds), ["x"]).collect()) == ["a", "b"]


def _tables(spark):
    import os

    from skyrisk.session import checkpoint_dir

    return {x for x in os.listdir(checkpoint_dir(spark).removeprefix("file:")) if x.startswith("stored-")}


def test_only_rows_of_repeated_keys_are_sorted(spark, monkeypatch):
    from skyrisk.operators import ml as M

    kinds = "row_key string, label double, f0 double"
    once = M.unique_rows(spark.createDataFrame([(f"k{i}", 1.0 if i % 9 else None, float(i)) for i in range(90)], kinds))
    assert once.count() == 80 and "Window" not in once._jdf.queryExecution().optimizedPlan().toString()  # all rows were shuffled by key
    rows = spark.createDataFrame([(f"k{i % 70}" if i % 13 else None, float(i % 2), float(i)) for i in range(100)], kinds)
    want = sorted(map(str, M._numbered(rows, "row_key").select(*rows.columns).collect()))
    assert sorted(map(str, M.unique_rows(rows).collect())) == want
    monkeypatch.setattr(M, "REPEATED_KEYS", 3)
    assert sorted(map(str, M.unique_rows(rows).collect())) == want and any("#2" in x for x in want)


def test_inputs_of_resampling_are_deleted(spark):
    """The engineered rows go when the training rows are there, and these when they are resampled."""
    from conftest import SF0001
    from skyrisk import catalog_ml as C

    before = _tables(spark)
    rows = C._training_rows(spark, SF0001)
    assert len(_tables(spark) - before) == 1
    out = C._resampled(rows)
    assert len(_tables(spark) - before) == 2 and out.count() > 0  # the resampled rows and the links


def test_shuffle_files_of_stored_tables_are_garbage(spark, monkeypatch):
    from skyrisk import session

    calls = []
    monkeypatch.setattr(session, "GARBAGE_SECONDS", 0.0)
    monkeypatch.setattr(session.gc, "collect", lambda: calls.append(1))
    session.unstore(session.stored(spark.range(10).repartition(3)))
    assert calls == [1]
