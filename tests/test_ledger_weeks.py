"""Commits of whole runs, the fact table by week, and the live count."""

import datetime as dt
import os

import pytest
from conftest import SF0001
from pyspark.sql import functions as F

from skyrisk.catalog import appr, logs, pred
from skyrisk.operators import explore as X
from skyrisk.plans.jobs import Paths, job_drift, job_ingest_week, job_risk_analysis
from skyrisk.schemas import APPROACH, PREDICTION, TRAINING_LOG
from skyrisk.sources import fixtures as FX
from skyrisk.sources import ledger as L
from skyrisk.sources.ingest import append_both
from skyrisk.sources.weeks import write_weeks
from skyrisk.streaming import new_ids as ST


def frame(spark, *ids):
    return spark.createDataFrame([(i, f"n{i}") for i in ids], "id long, name string")


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_a_run_counts_once_and_can_be_replaced(spark, tmp_dir):
    ledger, t = L.Ledger(spark, f"{tmp_dir}/ledger"), f"{tmp_dir}/t"
    schema = frame(spark, 1).schema
    assert ids(ledger.read(t, schema)) == []
    assert ledger.append("w1", {t: frame(spark, 1, 2)}) == {t: 2}
    assert ledger.append("w1", {t: frame(spark, 1, 2)}) == {t: 0}
    assert ledger.append("w2", {t: frame(spark, 3)}) == {t: 1}
    assert ledger.append("empty", {t: frame(spark, 3).limit(0)}) == {t: 0} and ledger.committed("empty")
    assert ids(ledger.read(t, schema)) == [1, 2, 3]
    assert ledger.append("w1", {t: frame(spark, 7)}, replace=True) == {t: 1}
    assert ids(ledger.read(t, schema)) == [3, 7] and ids(ledger.read(t, schema, ["w2"])) == [3]
    with pytest.raises(ValueError, match="run id"):
        ledger.append("../x", {t: frame(spark, 1)})


def test_a_failure_between_two_tables_leaves_nothing_and_the_next_attempt_one_copy(spark, tmp_dir):
    ledger, a, b = f"{tmp_dir}/ledger", f"{tmp_dir}/a", f"{tmp_dir}/b"
    rows = frame(spark, 1, 2, 3)
    broken = rows.withColumn("name", F.when(F.col("id") == 3, F.raise_error(F.lit("disk full"))).otherwise(F.col("name")))
    with pytest.raises(Exception, match="disk full"):
        L.Ledger(spark, ledger).append("w1", {a: rows, b: broken})
    assert os.listdir(a) == ["run=w1"]  # the first table's files are there, and in no reader's way
    assert ids(L.Ledger(spark, ledger).read(a, rows.schema)) == [] and not L.Ledger(spark, ledger).committed("w1")
    for _ in range(2):
        append_both(rows, a, b, ledger, "w1")
    assert ids(L.Ledger(spark, ledger).read(a, rows.schema)) == ids(L.Ledger(spark, ledger).read(b, rows.schema)) == [1, 2, 3]


def test_a_failure_before_the_commit_leaves_nothing(spark, tmp_dir, monkeypatch):
    ledger, t = L.Ledger(spark, f"{tmp_dir}/ledger"), f"{tmp_dir}/t"
    monkeypatch.setattr(L.Ledger, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        ledger.append("w1", {t: frame(spark, 1)})
    monkeypatch.undo()
    assert ids(ledger.read(t, frame(spark, 1).schema)) == []
    ledger.append("w1", {t: frame(spark, 1)})
    assert ids(ledger.read(t, frame(spark, 1).schema)) == [1]


def test_compaction_keeps_rows_and_run_ids(spark, tmp_dir):
    ledger, t, other = L.Ledger(spark, f"{tmp_dir}/ledger"), f"{tmp_dir}/t", f"{tmp_dir}/o"
    schema = frame(spark, 1).schema
    for i in range(6):
        ledger.append(f"w{i}", {t: frame(spark, i)})
    ledger.append("pair", {t: frame(spark, 100), other: frame(spark, 100)})
    assert ledger.compact(t, schema, "base") == 6
    assert ids(ledger.read(t, schema)) == [0, 1, 2, 3, 4, 5, 100]
    assert {r.run_id for r in ledger.runs().collect()} == {"base", "pair"}
    assert ledger.append("w3", {t: frame(spark, 3)}) == {t: 0}  # still known
    assert ledger.compact(t, schema, "again") == 0 or ids(ledger.read(t, schema)) == [0, 1, 2, 3, 4, 5, 100]


def test_jobs_run_twice_leave_one_copy(spark, tmp_dir):
    a = appr(spark, SF0001)
    paths = Paths(approaches=f"{tmp_dir}/approaches", approaches_copy=f"{tmp_dir}/copy", predictions=f"{tmp_dir}/pred", risk=f"{tmp_dir}/risk",
                  drift=f"{tmp_dir}/drift", training_logs=f"{tmp_dir}/logs", ledger=f"{tmp_dir}/ledger")
    ledger = L.Ledger(spark, paths.ledger)
    FX.feed_documents(a).write.json(f"{tmp_dir}/landing")
    n = a.where(F.col("close_approach_date").between("2000-01-01", "2000-07-01")).count()
    assert [job_ingest_week(spark, f"{tmp_dir}/landing", paths, "2000-01-01", "2000-07-01") for _ in range(2)] == [n, 0]
    assert ledger.read(paths.approaches, APPROACH).count() == ledger.read(paths.approaches_copy, APPROACH).count() == n
    ledger.append("history", {paths.approaches: a.where(F.col("close_approach_date") < "2000-01-01")})
    ledger.append("given", {paths.predictions: pred(spark, SF0001).select(*PREDICTION.names), paths.training_logs: logs(spark, SF0001).select(*TRAINING_LOG.names)})
    first, second = (job_drift(spark, paths, "d1", dt.datetime(2000, 7, 1, 9)).count() for _ in range(2))
    assert first == second > 0
    first, second = (job_risk_analysis(spark, paths, analysed_on="2000-07-02", dd_weights=(0.5, 0.3, 0.2)).count() for _ in range(2))
    assert first == second > 0


def test_one_week_reads_its_own_files(spark, tmp_dir):
    a = appr(spark, SF0001)
    short, long = f"{tmp_dir}/short", f"{tmp_dir}/long"
    write_weeks(a.where(F.col("close_approach_date") >= "2000-01-01"), short)
    write_weeks(a, long)
    week = X.week_window(spark.read.parquet(long), FX.RISK_AS_OF)
    plan = week._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(approach_week" in plan
    read = lambda p: len({r.f for r in X.week_window(spark.read.parquet(p), FX.RISK_AS_OF).select(F.input_file_name().alias("f")).collect()})
    assert 1 <= read(long) <= 2 and read(long) == read(short)
    assert len(week.inputFiles()) > 100  # the history is there
    log = logs(spark, SF0001)
    base, new = X.baseline_split(spark.read.parquet(long), log)
    plain = X.baseline_split(a, log)
    assert (base.count(), new.count()) == (plain[0].count(), plain[1].count()) and base.columns == plain[0].columns
    assert "PartitionFilters: [isnotnull(approach_week" in new._jdf.queryExecution().executedPlan().toString()


def test_rows_without_a_date_are_kept(spark, tmp_dir):
    df = spark.createDataFrame([(1, "2000-01-05"), (2, None)], "id long, close_approach_date string")
    write_weeks(df, f"{tmp_dir}/w")
    got = {r.id: r.approach_week for r in spark.read.parquet(f"{tmp_dir}/w").collect()}
    assert got == {1: dt.date(2000, 1, 3), 2: None}
    assert ids(X.week_window(spark.read.parquet(f"{tmp_dir}/w"), "2000-01-06")) == [1]


def test_live_count_by_batch_and_a_batch_run_again(spark, tmp_dir):
    schema = "id long, name string"
    counts = ST.live_count(spark.readStream.schema(schema).parquet(f"{tmp_dir}/in/*"), baseline=frame(spark, 1))
    for n, drop in enumerate(([1, 2, 2, 3], [3, None, 1], [4, 2])):
        spark.createDataFrame([(i, "x") for i in drop], schema).write.parquet(f"{tmp_dir}/in/d{n}")
        ST.run_live_count(counts, f"{tmp_dir}/counts", f"{tmp_dir}/ckpt")
    want = [(0, 2), (1, 2), (2, 3)]
    got = lambda: sorted((r.batch_id, r.live_count) for r in ST.live_counts(spark, f"{tmp_dir}/counts").collect())
    assert got() == want
    os.remove(f"{tmp_dir}/ckpt/commits/2")  # the driver is lost after the sink's write and before the commit
    if os.path.exists(f"{tmp_dir}/ckpt/commits/.2.crc"):
        os.remove(f"{tmp_dir}/ckpt/commits/.2.crc")
    ST.run_live_count(counts, f"{tmp_dir}/counts", f"{tmp_dir}/ckpt")
    assert got() == want


def test_sketches_unite_over_weeks_and_read_new_weeks_only(spark, tmp_dir):
    from skyrisk.operators import sketches as S

    a = appr(spark, SF0001)
    fact, path, ledger = f"{tmp_dir}/fact", f"{tmp_dir}/sketches", f"{tmp_dir}/ledger"
    assert S.hero_counters(spark, path, ledger).first().asDict() == {
        "ids_estimate": 0, "hazardous_estimate": 0, "sentry_estimate": 0, "total_approaches": 0, "closest_km": None, "fastest_kps": None, "latest_date": None}
    early = F.col("close_approach_date") < "1999-01-04"
    write_weeks(a.where(early), fact)
    first = S.update_sketches(spark, fact, path, ledger)
    write_weeks(a.where(~early), fact)
    second = S.update_sketches(spark, fact, path, ledger)
    assert min(second) > max(first) and S.update_sketches(spark, fact, path, ledger) == []
    exact = lambda df: (df.select("id").distinct().count(), df.where("is_potentially_hazardous").select("id").distinct().count())
    for got, rows in ((S.hero_counters(spark, path, ledger).first(), a), (S.hero_counters(spark, path, ledger, first=min(second)).first(), a.where(~early))):
        ids_, hazardous = exact(rows)
        assert abs(got.ids_estimate - ids_) <= 0.03 * ids_ and abs(got.hazardous_estimate - hazardous) <= 0.03 * hazardous + 1
        assert got.total_approaches == rows.count() and got.latest_date == rows.agg(F.max("close_approach_date")).first()[0]
