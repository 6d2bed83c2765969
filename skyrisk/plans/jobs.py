"""End-to-end jobs (the weekly batch chain).  Tables are the hand-off between jobs, as in the
reference; every clock, run id and seed is an argument, so reruns are deterministic.

Each ``job_*`` returns the DataFrame of rows it wrote (read back from the sink), so a caller can
inspect the result without recomputing the lineage.

With ``Paths.ledger`` every append is a run of the ledger: all its tables or none, and once for each run id.  The
default run ids name the job and its dates, so a job that is started again for the same week adds nothing.
"""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyrisk.operators.alerts import weekly_alert
from skyrisk.operators.drift import drift_report
from skyrisk.operators.explore import baseline_split
from skyrisk.operators.features import diameter_spread, drop_columns
from skyrisk.operators.ml import job_training, predict_batch
from skyrisk.operators.risk import risk_table
from skyrisk.schemas import APPROACH, ARTIFACT, DRIFT, DROP_COLUMNS, MANUAL_WEIGHTS, PREDICTION, RISK, TRAINING_LOG
from skyrisk.sources.ingest import append_both, append_table, feed_windows, flatten_feed, read_feed
from skyrisk.sources.ledger import Ledger
from skyrisk.sources.registry import load_best_model, log_training_run, newest_run, save_pipeline


@dataclass
class Paths:
    """Table locations on shared storage."""
    approaches: str
    predictions: str | None = None
    risk: str | None = None
    drift: str | None = None
    training_logs: str | None = None
    approaches_copy: str | None = None
    artifacts: str | None = None
    models: str | None = None
    ledger: str | None = None


def _table(spark: SparkSession, paths: Paths, path: str, schema: T.StructType) -> DataFrame:
    """A job's input table: its committed runs, or all its files where no ledger is kept."""
    if paths.ledger is None:
        return spark.read.parquet(path)
    return Ledger(spark, paths.ledger).read(path, schema)


def _appended(spark: SparkSession, paths: Paths, path: str, rows: DataFrame, run_id: str) -> DataFrame:
    """Append a job's rows; the table with them."""
    if paths.ledger is None:
        append_table(rows, path)
        return spark.read.parquet(path)
    ledger = Ledger(spark, paths.ledger)
    ledger.append(run_id, {path: rows})
    return ledger.read(path, rows.schema)


def drift_inputs(approaches: DataFrame, logs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """C6 -> B3 -> B4: split on the last training date, spread diameter, drop the drop-list and the
    joined cutoff column (a constant, not a feature)."""
    base, new = baseline_split(approaches, logs)
    prep = [drop_columns(diameter_spread(x), DROP_COLUMNS + ["model_last_trained"]) for x in (base, new)]
    return prep[0], prep[1]


def drift_rows(approaches: DataFrame, logs: DataFrame, run_id: str, created_at, **kw) -> DataFrame:
    base, new = drift_inputs(approaches, logs)
    return drift_report(base, new, run_id, created_at, **kw)


def job_drift(spark: SparkSession, paths: Paths, run_id: str | None = None,
              created_at: dt.datetime | None = None) -> DataFrame:
    """Drift report appended to the drift table."""
    approaches = _table(spark, paths, paths.approaches, APPROACH)
    logs = _table(spark, paths, paths.training_logs, TRAINING_LOG)
    run_id = run_id or str(uuid.uuid4())
    created_at = created_at or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    rows = drift_rows(approaches, logs, run_id, created_at)
    return _appended(spark, paths, paths.drift, rows, f"drift-{run_id}").where(F.col("run_id") == run_id)


def newest_drift_date(drift: DataFrame):
    """Scalar column source: date of the newest drift row (the risk job's as-of)."""
    return drift.agg(F.max(F.to_date("created_at")).alias("as_of"))


def job_risk_analysis(spark: SparkSession, paths: Paths, as_of: str | dt.date | None = None,
                      analysed_on: str | dt.date | None = None, dd_weights=None,
                      manual=MANUAL_WEIGHTS) -> DataFrame:
    """Week window (as-of = newest drift run unless given) -> join predictions -> physics ->
    normalise -> weights -> both scores -> append."""
    approaches = _table(spark, paths, paths.approaches, APPROACH)
    pred = _table(spark, paths, paths.predictions, PREDICTION)
    if as_of is None:
        row = newest_drift_date(_table(spark, paths, paths.drift, DRIFT)).first()
        as_of = row["as_of"]
    analysed_on = analysed_on or dt.date.today()
    rows = risk_table(approaches, pred, str(as_of), dd_weights=dd_weights, manual=manual, analysed_on=str(analysed_on))
    return _appended(spark, paths, paths.risk, rows, f"risk-{as_of}-{analysed_on}").where(F.col("risk_analysed_on_date") == F.lit(str(analysed_on)).cast("date"))


def job_weekly_alert(spark: SparkSession, paths: Paths, recipients: DataFrame, run_date=None) -> DataFrame:
    """One payload row (summary, ten names, recipient count); sending mail is out of scope."""
    approaches = _table(spark, paths, paths.approaches, APPROACH)
    risk = _table(spark, paths, paths.risk, RISK)
    return weekly_alert(approaches, risk, recipients, run_date or dt.date.today())


def landed_week(spark: SparkSession, feed_dir: str, start, today, multi_line: bool = False) -> DataFrame:
    """A2 -> A1: flat rows of the landed feed whose date lies in one of the seven-day windows from
    ``start`` to ``today`` (a row for each week, so the windows are broadcast)."""
    rows = flatten_feed(read_feed(spark, feed_dir, multi_line))
    windows = feed_windows(spark, start, today)
    inside = F.to_date("close_approach_date").between(F.col("window_start"), F.col("window_end"))
    return rows.join(F.broadcast(windows), inside).select(*rows.columns)


def job_ingest_week(spark: SparkSession, feed_dir: str, paths: Paths, start, today, multi_line: bool = False) -> int:
    """Windows -> landed feed pages -> flat rows -> appended to both fact tables."""
    rows = landed_week(spark, feed_dir, start, today, multi_line)
    return append_both(rows, paths.approaches, paths.approaches_copy or paths.approaches + "_copy", paths.ledger, f"ingest-{start}-{today}")


def job_train(spark: SparkSession, paths: Paths, name: str, trained_at: dt.datetime, run_id: str, **budget) -> DataFrame:
    """J3 with its storage: train on the approaches table, save the pipeline, append its registry row and
    the training log row; returns the log."""
    done = job_training(_table(spark, paths, paths.approaches, APPROACH), **budget)
    uri = f"{paths.models}/{name}-{run_id}"
    m = done.metrics.first()
    if paths.ledger is None:
        save_pipeline(done.model, uri, paths.artifacts, name, trained_at)
        log_training_run(spark, paths.training_logs, name, str(trained_at), m.accuracy, m.precision, m.recall, m.f1_score, run_id, uri)
        return spark.read.parquet(paths.training_logs)
    done.model.write().overwrite().save(uri)  # the registry row and the log row appear together, after the model is there
    artifact = spark.createDataFrame([(name, uri, trained_at)], ARTIFACT)
    log = spark.createDataFrame([(name, str(trained_at), m.accuracy, m.precision, m.recall, m.f1_score, run_id, uri)], TRAINING_LOG)
    ledger = Ledger(spark, paths.ledger)
    ledger.append(f"train-{name}-{run_id}", {paths.artifacts: artifact, paths.training_logs: log})
    return ledger.read(paths.training_logs, TRAINING_LOG)


def job_predict(spark: SparkSession, feed_dir: str, paths: Paths, start, today, multi_line: bool = False) -> DataFrame:
    """Windows -> landed feed -> prediction with the newest model -> append; the model date is the
    newest log row's.  Returns the rows of that model date."""
    logs = _table(spark, paths, paths.training_logs, TRAINING_LOG)
    date = newest_run(logs)["training_date"]
    rows = predict_batch(landed_week(spark, feed_dir, start, today, multi_line), load_best_model(logs), date)
    run_id = f"predict-{start}-{today}-{date}".replace(":", ".")
    return _appended(spark, paths, paths.predictions, rows, run_id).where(F.col("trained_model_date_used") == date)
