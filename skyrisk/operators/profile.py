"""Incremental drift: a stored profile of the fact table, from which a report needs no row of it.

The profile counts, for each day, how often each value of each feature occurs.  It is a table by week beside the fact
table by week (:mod:`skyrisk.sources.weeks`) and is kept in a ledger: an update profiles the weeks that have none yet and
reads their folders only.  Sums of the days before and from the cutoff are the two sides' value counts, so quantile
edges, histograms, PSI and chi-square are exactly those of ``drift_report`` on the rows.  The profile grows with the
distinct values of a day, not with its rows.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyrisk.operators.drift import align_columns, report_from_counts
from skyrisk.operators.features import diameter_spread, drop_columns
from skyrisk.schemas import DROP_COLUMNS
from skyrisk.sources.ledger import Ledger
from skyrisk.sources.weeks import WEEK, folder_weeks

PROFILE = T.StructType([T.StructField("day", T.DateType()), T.StructField("numeric", T.BooleanType()), T.StructField("feature", T.StringType()),
                        T.StructField("value", T.DoubleType()), T.StructField("category", T.StringType()), T.StructField("n", T.LongType()),
                        T.StructField(WEEK, T.DateType())])
_DAY = "_profile_day"


def profile_rows(approaches: DataFrame, date_col: str = "close_approach_date") -> DataFrame:
    """Counts of every feature's values by day, of rows with a date."""
    dated = diameter_spread(approaches).withColumn(_DAY, F.to_date(F.col(date_col))).where(F.col(_DAY).isNotNull())
    features = drop_columns(dated, [*DROP_COLUMNS, WEEK, _DAY])
    _, _, numeric, categorical = align_columns(features, features)

    def counts(cols: list[str], is_numeric: bool) -> DataFrame:
        key = "value" if is_numeric else "category"
        kv = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double" if is_numeric else "string").alias(key)) for c in cols])).alias("kv")
        rows = dated.select(_DAY, kv).select(_DAY, "kv.*").where(F.col(key).isNotNull() & (~F.isnan(key) if is_numeric else F.lit(True)))
        n = rows.groupBy(_DAY, "feature", key).agg(F.count(F.lit(1)).alias("n"))
        other = F.lit(None).cast("string" if is_numeric else "double").alias("category" if is_numeric else "value")
        return n.select(F.col(_DAY).alias("day"), F.lit(is_numeric).alias("numeric"), "feature", key, other, "n").select(
            "day", "numeric", "feature", "value", "category", "n", F.trunc("day", "week").alias(WEEK))

    parts = [counts(cols, kind) for cols, kind in ((numeric, True), (categorical, False)) if cols]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def unseen_weeks(spark: SparkSession, fact_path: str, table: str, ledger: Ledger, again: Iterable[dt.date] = ()) -> tuple[list[dt.date], set[str]]:
    """The fact table's weeks that no committed run of ``table`` covers, with those of runs that cover a week of ``again``;
    and these runs' ids.  Read from folder names."""
    known: dict[dt.date, str] = {}
    for run in ledger.runs().where(F.col("table") == table.rstrip("/")).collect():  # a row for each run
        known |= {week: run.run_id for week in folder_weeks(spark, run.folder)}
    stale = {known[w] for w in again if w in known}
    return sorted(w for w in folder_weeks(spark, fact_path) if w not in known or known[w] in stale), stale


def of_weeks(spark: SparkSession, fact_path: str, weeks: list[dt.date]) -> DataFrame:
    """Rows of the weeks: a range for the scan to prune by, and the list for weeks within it that are known."""
    return spark.read.parquet(fact_path).where(F.col(WEEK).between(F.lit(weeks[0]), F.lit(weeks[-1])) & F.col(WEEK).isin(weeks))


def update_profile(spark: SparkSession, fact_path: str, profile_path: str, ledger_path: str, again: Iterable[dt.date] = ()) -> list[dt.date]:
    """Profile the weeks of the fact table that have no profile, all in one committed run; their Mondays.  ``again`` are
    weeks whose rows have changed: their runs are replaced as a whole.  One update at a time."""
    ledger = Ledger(spark, ledger_path)
    weeks, stale = unseen_weeks(spark, fact_path, profile_path, ledger, again)
    if weeks:
        rows = profile_rows(of_weeks(spark, fact_path, weeks))
        ledger.append(f"profile-{weeks[0]}-{weeks[-1]}-{uuid.uuid4().hex[:8]}", {profile_path: rows}, [WEEK], replaces=stale)
    return weeks


def drift_from_profile(spark: SparkSession, profile_path: str, ledger_path: str, cutoff: dt.date, run_id: str, created_at: dt.datetime | str, **kw) -> DataFrame:
    """``drift_report`` of the days before ``cutoff`` against those from it on."""
    profile = Ledger(spark, ledger_path).read(profile_path, PROFILE)
    before = F.col("day") < F.lit(cutoff)
    sides = [F.sum(F.when(before, F.col("n")).otherwise(F.lit(0))).alias("b"), F.sum(F.when(before, F.lit(0)).otherwise(F.col("n"))).alias("n")]
    values = profile.where("numeric").select("feature", "value", *[F.when(x, F.col("n")).otherwise(F.lit(0)).alias(c) for x, c in ((before, "b"), (~before, "n"))])
    categories = profile.where("not numeric").groupBy("feature", "category").agg(*sides)
    return report_from_counts(spark, values, categories, run_id, created_at, **kw)
