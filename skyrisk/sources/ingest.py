"""Feed flattening, scans and append-only sinks.

Sinks write Parquet (the table format on the cluster's shared storage).  ``append_table``
never de-duplicates unless asked (the reference appends blindly); with ``dedupe_keys`` it
finds the batch's keys that are not stored (a shuffle of key columns only), and shuffles the rows of these keys
to drop repeated ones.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyrisk.schemas import APPROACH_COLUMNS, FEED
from skyrisk.session import cut_lineage
from skyrisk.sources.ledger import Ledger


def _to_double_or_zero(c) -> F.Column:
    """float(text) with 0.0 only when the key is absent; a malformed value stays an error."""
    return F.when(c.isNull(), F.lit(0.0)).otherwise(c.cast("double"))


def flatten_feed(feed: DataFrame) -> DataFrame:
    """Nested feed documents -> one row per (asteroid, close approach), 14 typed columns.
    An asteroid without close_approach_data yields no row."""
    days = feed.select(F.explode("near_earth_objects").alias("_date", "_asteroids"))
    asteroids = days.select(F.explode("_asteroids").alias("a"))
    rows = asteroids.select("a", F.explode("a.close_approach_data").alias("ca"))
    return rows.select(
        F.col("a.id").try_cast("bigint").alias("id"),
        F.col("a.name").alias("name"),
        F.col("a.absolute_magnitude_h").alias("absolute_magnitude_h"),
        F.col("a.estimated_diameter.kilometers.estimated_diameter_min").alias("min_diameter_km"),
        F.col("a.estimated_diameter.kilometers.estimated_diameter_max").alias("max_diameter_km"),
        F.col("ca.close_approach_date").alias("close_approach_date"),
        F.col("ca.close_approach_date_full").alias("close_approach_date_full"),
        F.col("ca.epoch_date_close_approach").alias("epoch_date_close_approach"),
        _to_double_or_zero(F.col("ca.relative_velocity.kilometers_per_second")).alias("relative_velocity_kps"),
        _to_double_or_zero(F.col("ca.miss_distance.kilometers")).alias("miss_distance_km"),
        F.col("ca.orbiting_body").alias("orbiting_body"),
        F.col("a.is_potentially_hazardous_asteroid").alias("is_potentially_hazardous"),
        F.col("a.is_sentry_object").alias("is_sentry_object"),
        F.col("a.nasa_jpl_url").alias("nasa_jpl_url"),
    ).select(*APPROACH_COLUMNS)


def read_feed(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Landed feed documents with the explicit feed schema: JSON lines (one document per line,
    splittable) or, with ``multi_line``, one pretty-printed page per file as the feed API returns."""
    return spark.read.schema(FEED).option("multiLine", multi_line).json(path)


def feed_windows(spark: SparkSession, start, today, days: int = 7) -> DataFrame:
    """Consecutive ``days``-long windows from ``start`` to ``today``; the last is clamped."""
    s = F.lit(str(start)).cast("date")
    t = F.lit(str(today)).cast("date")
    return window_rows(spark.range(1).select(s.alias("_s"), t.alias("_t")), days)


def window_rows(bounds: DataFrame, days: int = 7) -> DataFrame:
    """``bounds`` has columns _s, _t (dates); returns (window_start, window_end) rows."""
    seq = F.sequence(F.col("_s"), F.col("_t"), F.expr(f"INTERVAL {int(days)} DAYS"))
    starts = bounds.where(F.col("_s") <= F.col("_t")).select(F.explode(seq).alias("window_start"), "_t")
    return starts.select("window_start", F.least(F.date_add("window_start", days - 1), F.col("_t")).alias("window_end"))


def feed_windows_for(df: DataFrame, date_col: str = "close_approach_date", days: int = 7) -> DataFrame:
    """Windows covering the span of dates present in ``df``."""
    d = F.to_date(F.col(date_col))
    bounds = df.agg(F.min(d).alias("_s"), F.max(d).alias("_t"))
    return window_rows(bounds, days)


def scan_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(path)


def csv_snapshot(df: DataFrame, path: str) -> DataFrame:
    """Write the table as CSV with a header (overwrite) and read it back with the same schema."""
    df.write.mode("overwrite").option("header", True).csv(path)
    return df.sparkSession.read.schema(df.schema).option("header", True).csv(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark's file system has ``path``."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _written_rows(batch: DataFrame, paths: Sequence[str]) -> int:
    """Append ``batch``, which has rows, to each path; they are counted on the way of the first write."""
    seen = Observation()
    batch.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(paths[0])
    for path in paths[1:]:
        batch.write.mode("append").parquet(path)
    return seen.get["n"]


def append_table(df: DataFrame, path: str, dedupe_keys: Sequence[str] | None = None) -> int:
    """Append (create if absent).  Empty input writes nothing.  Returns rows appended.  With
    ``dedupe_keys`` one row of each key stays, and none whose key is stored (NULL equals NULL)."""
    batch = df
    if dedupe_keys and path_exists(df.sparkSession, path):
        keys = list(dedupe_keys)
        named = lambda x, side: x.select(*[F.col(k).alias(f"_{side}_{k}") for k in keys]).distinct()
        same = lambda left, right: reduce(and_, [F.col(f"{left}{k}").eqNullSafe(F.col(f"{right}{k}")) for k in keys])
        fresh = named(df, "new").join(named(df.sparkSession.read.parquet(path), "stored"), same("_new_", "_stored_"), "left_anti")
        fresh = cut_lineage(fresh)  # the write must not read the folder it appends to
        batch = df.join(fresh, same("", "_new_"), "left_semi") if not fresh.isEmpty() else fresh
    if batch.isEmpty():
        return 0
    return _written_rows(batch.dropDuplicates(list(dedupe_keys)) if dedupe_keys else batch, [path])


def append_both(df: DataFrame, path_a: str, path_b: str, ledger: str | None = None, run_id: str | None = None) -> int:
    """Same batch appended to two tables: materialised once in the shared folder, so both get the same rows.  With a
    ``ledger`` both are committed together under ``run_id``, once (see :mod:`skyrisk.sources.ledger`)."""
    if ledger is not None:
        return Ledger(df.sparkSession, ledger).append(run_id, {path_a: df, path_b: df})[path_a]
    batch = cut_lineage(df)
    return 0 if batch.isEmpty() else _written_rows(batch, [path_a, path_b])


def attach_constants(df: DataFrame, **values) -> DataFrame:
    """Run constants on every row (model date, analysis date, run id, created_at...)."""
    out = df
    for k, v in values.items():
        if isinstance(v, dt.datetime):
            out = out.withColumn(k, F.lit(v.isoformat(sep=" ")).cast("timestamp"))
        elif isinstance(v, dt.date):
            out = out.withColumn(k, F.lit(v.isoformat()).cast("date"))
        else:
            out = out.withColumn(k, F.lit(v))
    return out
