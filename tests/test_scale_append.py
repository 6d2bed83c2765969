import os

from skyrisk.schemas import APPROACH
from skyrisk.sources import ingest as IN


def _row(i, epoch=1, name="a", miss=5.0):
    return (i, name, 20.0, 0.1, 0.2, "2000-01-01", "2000-Jan-01 00:00", epoch, 10.0, miss, "Earth", False, False, "u")


def test_append_dedupe_keeps_only_keys_aside(spark, tmp_dir, monkeypatch):
    cut, held = IN.cut_lineage, []
    monkeypatch.setattr(IN, "cut_lineage", lambda df: held.append(df.columns) or cut(df))
    path, keys = os.path.join(tmp_dir, "t"), ["id", "epoch_date_close_approach"]
    first = spark.createDataFrame([_row(1), _row(1), _row(2, None), _row(None, 3)], APPROACH)
    more = spark.createDataFrame([_row(1), _row(2, None), _row(None, 3), _row(2, 4), _row(2, 4), _row(None, None)], APPROACH)
    assert IN.append_table(first, path, keys) == 3
    assert IN.append_table(more, path, keys) == 2
    assert IN.append_table(more, path, keys) == 0
    got = [(r.id, r.epoch_date_close_approach) for r in spark.read.parquet(path).collect()]
    assert sorted(got, key=str) == sorted([(1, 1), (2, None), (None, 3), (2, 4), (None, None)], key=str)
    assert held and all(len(c) == 2 for c in held)  # the old code held all 14 columns
