"""Hero counters from sketches stored by week.

A week of the fact table becomes one row: HyperLogLog sketches of its ids, of the hazardous and of the sentry ones, its
row count and its extremes.  Sketches of weeks unite into that of all ids, so the counters of the whole history read
one small row for each week, and an update reads new weeks only.  Counts of rows and extremes are exact; the three
distinct counts have a relative standard error of 1.04 / sqrt(2 ** ``BITS``), 0.8 %.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyrisk.operators.profile import of_weeks, unseen_weeks
from skyrisk.sources.ledger import Ledger
from skyrisk.sources.weeks import WEEK

BITS = 14
_SETS = {"ids": lambda: F.col("id").isNotNull(), "hazardous": lambda: F.col("is_potentially_hazardous"), "sentry": lambda: F.col("is_sentry_object")}
SKETCHES = T.StructType([*(T.StructField(s, T.BinaryType()) for s in _SETS), T.StructField("total_approaches", T.LongType()),
                         T.StructField("closest_km", T.DoubleType()), T.StructField("fastest_kps", T.DoubleType()), T.StructField("latest_date", T.StringType()),
                         T.StructField(WEEK, T.DateType())])


def week_sketches(rows: DataFrame) -> DataFrame:
    """A row for each week of ``rows``."""
    of = [F.hll_sketch_agg(F.when(which(), F.col("id")), BITS).alias(name) for name, which in _SETS.items()]
    return rows.groupBy(WEEK).agg(*of, F.count(F.lit(1)).alias("total_approaches"), F.min("miss_distance_km").alias("closest_km"),
                                  F.max("relative_velocity_kps").alias("fastest_kps"), F.max("close_approach_date").alias("latest_date")).select(*SKETCHES.names)


def update_sketches(spark: SparkSession, fact_path: str, path: str, ledger_path: str, again: Iterable[dt.date] = ()) -> list[dt.date]:
    """Sketch the weeks that have none, in one committed run; their Mondays.  ``again`` as in ``update_profile``."""
    ledger = Ledger(spark, ledger_path)
    weeks, stale = unseen_weeks(spark, fact_path, path, ledger, again)
    if weeks:
        rows = week_sketches(of_weeks(spark, fact_path, weeks)).coalesce(1)  # a row for each week
        ledger.append(f"sketch-{weeks[0]}-{weeks[-1]}-{uuid.uuid4().hex[:8]}", {path: rows}, [WEEK], replaces=stale)
    return weeks


def hero_counters(spark: SparkSession, path: str, ledger_path: str, first: dt.date | None = None, last: dt.date | None = None) -> DataFrame:
    """One row: estimated distinct ids (all, hazardous, sentry), rows, closest, fastest, latest date, of all weeks or of
    those whose Mondays lie in [``first``, ``last``]."""
    rows = Ledger(spark, ledger_path).read(path, SKETCHES)
    rows = rows.where(F.col(WEEK) >= F.lit(first)) if first else rows
    rows = rows.where(F.col(WEEK) <= F.lit(last)) if last else rows
    distinct = [F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(s)), F.lit(0)).cast("long").alias(f"{s}_estimate") for s in _SETS]
    return rows.agg(*distinct, F.coalesce(F.sum("total_approaches"), F.lit(0)).alias("total_approaches"), F.min("closest_km").alias("closest_km"),
                    F.max("fastest_kps").alias("fastest_kps"), F.max("latest_date").alias("latest_date"))
