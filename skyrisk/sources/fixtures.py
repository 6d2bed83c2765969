"""Adapters from the driver's TPC-H-like tables to the asteroid tables.

The driver has no asteroid data, so the close-approach fact table is derived from
``lineitem JOIN part``.  Every expression here has a DuckDB twin in ``skyrisk.oracle``;
both sides use the same operation order so double results are bit-identical.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyrisk.schemas import APPROACH_COLUMNS

# Fixed adapter parameters (shared with the DuckDB oracle).
MISS_MODULUS = 74000000
PREDICTION_MODEL_DATE = "2000-06-20 00:00:00"
PREDICTION_OLDER_DATE = "2000-01-15 00:00:00"
FIRST_TRAINING_DATE = "1998-07-01"
TRAINING_STEP_DAYS = 30
RISK_AS_OF = "2000-07-01"
RISK_EARLIER_AS_OF = "2000-06-24"
DRIFT_CUTOFF = "2000-07-01"
FIXED_DD_WEIGHTS = (0.5, 0.3, 0.2)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _epoch_millis(c: str, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {c})")
    if isinstance(dtype, T.DateType):
        return F.expr(f"unix_date({c})").cast("long") * F.lit(86400000)
    return F.unix_millis(F.col(c))


def approaches_from(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """One row per close approach (14 columns), derived from lineitem x part."""
    l = lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice",
                        "l_linestatus", "l_shipdate")
    p = part.select("p_partkey", "p_name", "p_size")
    ship_type = lineitem.schema["l_shipdate"].dataType
    k = (F.col("l_orderkey") * 7919 + F.col("l_partkey") * 104729
         + F.col("l_linenumber") * 1299709) % MISS_MODULUS
    magnitude = F.lit(10.0) + F.col("p_size") * F.lit(0.4)
    joined = l.join(p, l.l_partkey == p.p_partkey)
    out = joined.select(
        F.col("l_partkey").alias("id"),
        F.concat(F.col("p_name"), F.lit(" ("), F.col("p_partkey").cast("string"), F.lit(")")).alias("name"),
        magnitude.alias("absolute_magnitude_h"),
        (F.col("p_size") * F.lit(0.01)).alias("min_diameter_km"),
        (F.col("p_size") * F.lit(0.01) * F.lit(2.2360679775)).alias("max_diameter_km"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("close_approach_date"),
        F.date_format("l_shipdate", "yyyy-MMM-dd HH:mm").alias("close_approach_date_full"),
        (_epoch_millis("l_shipdate", ship_type)
         + (F.col("l_orderkey") * 8 + F.col("l_linenumber")) % 86400000).alias("epoch_date_close_approach"),
        (F.lit(2.0) + F.col("l_extendedprice") / F.lit(2500.0)).alias("relative_velocity_kps"),
        (F.lit(10000) + k).cast("double").alias("miss_distance_km"),
        F.when(F.col("l_linestatus") == "F", F.lit("Earth")).otherwise(F.lit("Venus")).alias("orbiting_body"),
        ((magnitude <= 22) & ((F.lit(10000) + k) <= 20000000)).alias("is_potentially_hazardous"),
        ((F.col("l_partkey") % 37) == 0).alias("is_sentry_object"),
        F.concat(F.lit("https://example.invalid/obj/"), F.col("l_partkey").cast("string")).alias("nasa_jpl_url"),
    )
    return out.select(*APPROACH_COLUMNS)


def approaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return approaches_from(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part"))


def _probability(id_col: Column, multiplier: int) -> Column:
    return ((id_col * multiplier) % 1000) / F.lit(999.0)


def predictions_from(approach_df: DataFrame) -> DataFrame:
    """prediction_table: ids not divisible by 3 get a prediction dated 2000-06-20; ids divisible by
    10 get a second, older one (fan-out).  ``actual`` is the id's newest hazard flag; ids are text."""
    from skyrisk.operators.explore import latest_approach

    latest = latest_approach(approach_df.select("id", "epoch_date_close_approach", "is_potentially_hazardous"))
    base = latest.where(F.col("id") % 3 != 0).select("id", F.col("is_potentially_hazardous").alias("actual"))

    def rows(src: DataFrame, multiplier: int, model_date: str) -> DataFrame:
        p = _probability(F.col("id"), multiplier)
        return src.select(
            F.col("id").cast("string").alias("id"),
            F.col("actual"),
            (p >= 0.5).alias("model_prediction"),
            (F.lit(1.0) - p).alias("probability_being_falsely_hazardous"),
            p.alias("probability_being_truely_hazardous"),
            F.lit(model_date).alias("trained_model_date_used"),
        )

    newest = rows(base, 7919, PREDICTION_MODEL_DATE)
    older = rows(base.where(F.col("id") % 10 == 0), 104729, PREDICTION_OLDER_DATE)
    return newest.unionByName(older)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions_from(approaches(spark, sf_dir))


def model_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model_training_logs: one run per nation row, 30 days apart (newest 2000-06-20)."""
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        F.concat(F.lit("best_model_"), k.cast("string")).alias("model_name"),
        F.concat(F.date_format(F.date_add(F.lit(FIRST_TRAINING_DATE).cast("date"), k * TRAINING_STEP_DAYS),
                               "yyyy-MM-dd"), F.lit(" 00:00:00")).alias("training_date"),
        (F.lit(0.80) + F.lit(0.005) * k).alias("accuracy"),
        (F.lit(0.35) + F.lit(0.01) * k).alias("precision"),
        (F.lit(0.70) + F.lit(0.01) * k).alias("recall"),
        (F.lit(0.45) + F.lit(0.01) * k).alias("f1_score"),
        F.concat(F.lit("run_"), k.cast("string")).alias("run_id"),
        F.concat(F.lit("models/best_model_"), k.cast("string")).alias("artifact_uri"),
    )


def alert_recipients(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.concat(F.col("c_name"), F.lit("@example.invalid")).alias("email"),
                    F.col("c_custkey").alias("recipient_id"))


def feed_documents(approach_df: DataFrame) -> DataFrame:
    """Re-nest the fact table into feed documents (one document per approach, no shuffle):
    ``near_earth_objects: map<date, array<asteroid{..., close_approach_data: array<approach>}>>``."""
    approach = F.struct(
        F.col("close_approach_date"),
        F.col("close_approach_date_full"),
        F.col("epoch_date_close_approach"),
        F.struct(F.col("relative_velocity_kps").cast("string").alias("kilometers_per_second")).alias("relative_velocity"),
        F.struct(F.col("miss_distance_km").cast("string").alias("kilometers")).alias("miss_distance"),
        F.col("orbiting_body"),
    )
    asteroid = F.struct(
        F.col("id").cast("string").alias("id"),
        F.col("name"),
        F.col("absolute_magnitude_h"),
        F.struct(F.struct(F.col("min_diameter_km").alias("estimated_diameter_min"),
                          F.col("max_diameter_km").alias("estimated_diameter_max")).alias("kilometers"))
        .alias("estimated_diameter"),
        F.col("is_potentially_hazardous").alias("is_potentially_hazardous_asteroid"),
        F.col("is_sentry_object"),
        F.col("nasa_jpl_url"),
        F.array(approach).alias("close_approach_data"),
    )
    return approach_df.select(
        F.create_map(F.col("close_approach_date"), F.array(asteroid)).alias("near_earth_objects"))


def land_feed(approach_df: DataFrame, path: str) -> None:
    """Feed documents landed as compressed JSON lines (keys and names repeat in every document), a file for each task."""
    feed_documents(approach_df).write.json(path, compression="gzip")
