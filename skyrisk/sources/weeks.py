"""The fact table by week: one folder for each week of close approaches.

A week's rows are read from its own folders, however long the history is: the date filters (``week_window``,
``baseline_split``) add a condition on the partition column where the table has one, and Spark lists and reads only
those folders.  Rows without a date go to the default partition.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WEEK = "approach_week"


def with_week(df: DataFrame, date_col: str = "close_approach_date") -> DataFrame:
    """``df`` with the Monday of each row's date."""
    return df.withColumn(WEEK, F.trunc(F.to_date(F.col(date_col)), "week"))


def write_weeks(df: DataFrame, path: str, mode: str = "append") -> None:
    """Append rows to the table by week.  A week's rows come together before the write, in as many tasks as its size
    needs (a rebalance splits a large week), so a folder gets few files."""
    with_week(df).hint("rebalance", WEEK).write.mode(mode).partitionBy(WEEK).parquet(path)


def folder_weeks(spark: SparkSession, path: str) -> list[dt.date]:
    """The weeks a table has folders for, from their names; no file is opened."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    names = [x.getPath().getName().partition("=") for x in fs.listStatus(folder)]
    return sorted(dt.date.fromisoformat(value) for column, _, value in names if column == WEEK and not value.startswith("__"))


def monday(day: dt.date) -> dt.date:
    return day - dt.timedelta(days=day.weekday())


def in_weeks(df: DataFrame, first: dt.date | None = None, last: dt.date | None = None) -> Column:
    """The condition on the partition column that rows dated ``first`` to ``last`` fulfil; true without one."""
    out = F.lit(True)
    if WEEK in df.columns:
        if first is not None:
            out = out & (F.col(WEEK) >= F.lit(monday(first)))
        if last is not None:
            out = out & (F.col(WEEK) <= F.lit(monday(last)))
    return out
