"""Metrics (FIXTURES 3.5), feed flattening cases, sinks, and the streaming detector (FIXTURES 3.6)."""

import os

import pytest
from pyspark.sql import functions as F

from skyrisk.operators.metrics import binary_metrics, classification_report, confusion_matrix
from skyrisk.schemas import APPROACH
from skyrisk.sources.ingest import append_table, feed_windows, flatten_feed, read_feed
from skyrisk.streaming.new_ids import run_available, stream_new_ids, to_events


def test_binary_metrics(spark):
    df = spark.createDataFrame([(True, True), (False, False), (True, False), (True, True)],
                               "actual boolean, model_prediction boolean")
    r = binary_metrics(df).collect()[0]
    assert (r.accuracy, r.precision, r.recall) == (0.75, 1.0, pytest.approx(2 / 3))
    assert r.f1_score == pytest.approx(0.8)
    none = spark.createDataFrame([(True, False), (False, False)], "actual boolean, model_prediction boolean")
    z = binary_metrics(none).collect()[0]
    assert z.precision == 0.0 and z.f1_score == 0.0
    cm = {(r.actual, r.predicted): r["count"] for r in confusion_matrix(df).collect()}
    assert cm == {(False, False): 1, (False, True): 0, (True, False): 1, (True, True): 2}
    rep = {r.label: r for r in classification_report(df).collect()}
    assert rep["true"].support == 3 and rep["false"].support == 1
    assert rep["macro avg"].recall == pytest.approx((2 / 3 + 1.0) / 2)


FEED_DOC = """{"near_earth_objects": {"2015-01-05": [
 {"id": "2085990", "name": "85990 (1999 JV6)", "absolute_magnitude_h": 20.27,
  "estimated_diameter": {"kilometers": {"estimated_diameter_min": 0.234723, "estimated_diameter_max": 0.524856}},
  "is_potentially_hazardous_asteroid": true, "is_sentry_object": false, "nasa_jpl_url": "u1",
  "close_approach_data": [
    {"close_approach_date": "2015-01-05", "close_approach_date_full": "2015-Jan-05 11:16",
     "epoch_date_close_approach": 1420456560000, "relative_velocity": {"kilometers_per_second": "7.694743"},
     "miss_distance": {"kilometers": "12463290"}, "orbiting_body": "Earth"},
    {"close_approach_date": "2016-02-01", "close_approach_date_full": "2016-Feb-01 01:00",
     "epoch_date_close_approach": 1454288400000, "relative_velocity": {},
     "miss_distance": {"kilometers": "1000"}, "orbiting_body": "Earth"}]},
 {"id": "3", "name": "no approaches", "absolute_magnitude_h": 1.0,
  "estimated_diameter": {"kilometers": {"estimated_diameter_min": 1.0, "estimated_diameter_max": 2.0}},
  "is_potentially_hazardous_asteroid": false, "is_sentry_object": false, "nasa_jpl_url": "u3"}]}}"""


def test_flatten_feed_cases(spark, tmp_dir):
    path = os.path.join(tmp_dir, "page.json")
    with open(path, "w") as f:
        f.write(FEED_DOC)
    rows = flatten_feed(read_feed(spark, path, multi_line=True)).orderBy("epoch_date_close_approach").collect()
    assert len(rows) == 2 and {r.id for r in rows} == {2085990}
    assert rows[0].relative_velocity_kps == 7.694743 and rows[0].miss_distance_km == 12463290.0
    assert rows[1].relative_velocity_kps == 0.0
    assert rows[0].min_diameter_km == 0.234723 and rows[0].is_potentially_hazardous is True


def test_feed_windows(spark):
    w = feed_windows(spark, "2024-01-01", "2024-01-17").collect()
    assert [(str(r.window_start), str(r.window_end)) for r in w] == [
        ("2024-01-01", "2024-01-07"), ("2024-01-08", "2024-01-14"), ("2024-01-15", "2024-01-17")]


def test_append_table(spark, tmp_dir):
    df = spark.createDataFrame([(1, 10), (2, 20)], "id long, epoch_date_close_approach long")
    path = os.path.join(tmp_dir, "t")
    assert append_table(df, path) == 2
    assert append_table(df.limit(0), path) == 0
    assert append_table(df, path) == 2
    assert spark.read.parquet(path).count() == 4
    assert append_table(df, path, dedupe_keys=["id", "epoch_date_close_approach"]) == 0


def _approach(id_, epoch):
    return (id_, f"n{id_}", 20.0, 0.1, 0.2, "2000-01-01", "2000-Jan-01 00:00", epoch, 5.0, 1e6, "Earth", False,
            False, "u")


@pytest.mark.parametrize("with_baseline", [False, True])
def test_stream_new_ids_two_drops(spark, tmp_dir, with_baseline):
    inp, out, ck = (os.path.join(tmp_dir, x) for x in ("in", "out", "ck"))
    spark.createDataFrame([_approach(1, 10), _approach(1, 20), _approach(2, 5)], APPROACH) \
        .repartition(2).write.parquet(os.path.join(inp, "d1"))
    stream = spark.readStream.schema(APPROACH).parquet(os.path.join(inp, "*"))
    baseline = spark.createDataFrame([(1,), (2,)], "id long") if with_baseline else None
    found = stream_new_ids(stream, baseline)
    run_available(found, out, ck)
    first = sorted((r.id, r.epoch_date_close_approach) for r in spark.read.parquet(out).collect())
    spark.createDataFrame([_approach(1, 99), _approach(3, 7)], APPROACH).write.parquet(os.path.join(inp, "d2"))
    run_available(found, out, ck)
    total = sorted((r.id, r.epoch_date_close_approach) for r in spark.read.parquet(out).collect())
    if with_baseline:
        assert first == [] and total == [(3, 7)]
    else:
        assert first == [(1, 20), (2, 5)] and total == [(1, 20), (2, 5), (3, 7)]


def test_to_events(spark):
    df = spark.createDataFrame([(5, "x")], "id long, name string")
    payload = to_events(df).collect()[0].payload
    assert payload == '{"event":"new_asteroid","data":{"id":5,"name":"x"}}'
