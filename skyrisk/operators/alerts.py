"""Weekly alert payload: risky names, summary counts, padded top-10, recipients."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyrisk.functions.columns import pad_slot
from skyrisk.operators.explore import weekly_risky, weekly_summary
from skyrisk.schemas import ALERT_SLOTS


def alert_top10(df: DataFrame, risk: DataFrame, slots: int = ALERT_SLOTS) -> DataFrame:
    """Slots 1..10 filled with the first risky names (name order, then id), padded with a dash.
    The first ``slots`` names are a top-k (per-partition top-k + merge), never a full sort."""
    names = weekly_risky(df, risk)
    top = names.orderBy("name", "id").limit(slots)
    ranked = top.withColumn("slot", F.row_number().over(
        Window.orderBy("name", "id")))
    grid = df.sparkSession.range(1, slots + 1).select(F.col("id").cast("int").alias("slot"))
    return grid.join(ranked.select("slot", "name"), "slot", "left").select("slot", pad_slot("name").alias("name"))


def recipients(recipient_table: DataFrame) -> DataFrame:
    return recipient_table.select("email")


def weekly_alert(df: DataFrame, risk: DataFrame, recipient_table: DataFrame, run_date) -> DataFrame:
    """One payload row: run date, summary counts, the ten slots as an array, recipient count."""
    summary = weekly_summary(df, risk)
    slots = alert_top10(df, risk).agg(F.sort_array(F.collect_list(F.struct("slot", "name"))).alias("_s"))
    rcount = recipients(recipient_table).agg(F.count(F.lit(1)).alias("recipient_count"))
    out = summary.crossJoin(F.broadcast(slots)).crossJoin(F.broadcast(rcount))
    return out.select(F.lit(str(run_date)).alias("run_date"), "total_asteroids", "hazardous", "non_hazardous",
                      *[F.col("_s")[i]["name"].alias(f"asteroid_{i + 1}") for i in range(ALERT_SLOTS)],
                      "recipient_count")
