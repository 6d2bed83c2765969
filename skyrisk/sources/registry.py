"""Model / artifact registry: fitted pipelines are saved as ``PipelineModel`` directories on shared
storage, and an append-only registry table records (name, artifact path, created_at).  The
newest row wins, as in the reference (which stored pickles in a table)."""

from __future__ import annotations

import datetime as dt

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyrisk.schemas import ARTIFACT, TRAINING_LOG
from skyrisk.sources.ingest import append_table


def latest_artifact(registry: DataFrame, name: str | None = None) -> DataFrame:
    """Newest row by created_at (empty frame when the table is empty)."""
    rows = registry if name is None else registry.where(F.col("name") == F.lit(name))
    return rows.orderBy(F.desc_nulls_last("created_at"), F.desc("name")).limit(1)


def save_pipeline(model, path: str, registry_path: str, name: str, created_at: dt.datetime) -> int:
    """Write the fitted ``PipelineModel`` (features with their fitted numbers, learners, stack), then append
    its registry row."""
    spark = SparkSession.getActiveSession()
    model.write().overwrite().save(path)
    row = spark.createDataFrame([(name, path, created_at)], ARTIFACT)
    return append_table(row, registry_path)


def log_training_run(spark: SparkSession, path: str, model_name: str, training_date: str, accuracy: float,
                     precision: float, recall: float, f1_score: float, run_id: str, artifact_uri: str) -> int:
    row = spark.createDataFrame([(model_name, training_date, float(accuracy), float(precision), float(recall),
                                  float(f1_score), run_id, artifact_uri)], TRAINING_LOG)
    return append_table(row, path)


def newest_run(logs: DataFrame):
    """The newest training log row, or None."""
    return logs.orderBy(F.desc_nulls_last("training_date"), F.desc("model_name")).first()


def load_best_model(logs: DataFrame) -> PipelineModel | None:
    """Newest training log row -> its artifact directory -> ``PipelineModel.load``."""
    newest = newest_run(logs)
    return PipelineModel.load(newest["artifact_uri"]) if newest else None
