"""Classification metrics as aggregates (one pass, no driver-side arrays)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _b(c: str):
    return F.col(c).cast("boolean")


def confusion_matrix(df: DataFrame, actual: str = "actual", predicted: str = "model_prediction") -> DataFrame:
    """2x2 counts (actual, predicted, count), zero cells included."""
    a, p = _b(actual), _b(predicted)
    counts = df.agg(
        F.count_if(~a & ~p).alias("ff"), F.count_if(~a & p).alias("ft"),
        F.count_if(a & ~p).alias("tf"), F.count_if(a & p).alias("tt"))
    cells = F.array(
        F.struct(F.lit(False).alias("actual"), F.lit(False).alias("predicted"), F.col("ff").alias("count")),
        F.struct(F.lit(False).alias("actual"), F.lit(True).alias("predicted"), F.col("ft").alias("count")),
        F.struct(F.lit(True).alias("actual"), F.lit(False).alias("predicted"), F.col("tf").alias("count")),
        F.struct(F.lit(True).alias("actual"), F.lit(True).alias("predicted"), F.col("tt").alias("count")))
    return counts.select(F.inline(cells))


def binary_metrics(df: DataFrame, actual: str = "actual", predicted: str = "model_prediction") -> DataFrame:
    """accuracy, precision, recall, F1 of the positive class; 0 where undefined."""
    a, p = _b(actual), _b(predicted)
    c = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(a & p).alias("tp"), F.count_if(~a & p).alias("fp"),
               F.count_if(a & ~p).alias("fn"), F.count_if(~a & ~p).alias("tn"))
    prec = F.coalesce(F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fp")).cast("double")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fn")).cast("double")), F.lit(0.0))
    out = c.select(
        F.coalesce(F.try_divide((F.col("tp") + F.col("tn")).cast("double"), F.col("n").cast("double")),
                   F.lit(0.0)).alias("accuracy"),
        prec.alias("precision"), rec.alias("recall"))
    f1 = F.when(F.col("precision") + F.col("recall") == 0, F.lit(0.0)).otherwise(
        F.lit(2.0) * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    return out.withColumn("f1_score", f1)


def classification_report(df: DataFrame, actual: str = "actual", predicted: str = "model_prediction") -> DataFrame:
    """Per class (false / true): precision, recall, f1, support; plus macro avg and weighted avg rows."""
    cm = confusion_matrix(df, actual, predicted)
    per = cm.groupBy().agg(
        F.sum(F.when(~F.col("actual") & ~F.col("predicted"), F.col("count"))).alias("ff"),
        F.sum(F.when(~F.col("actual") & F.col("predicted"), F.col("count"))).alias("ft"),
        F.sum(F.when(F.col("actual") & ~F.col("predicted"), F.col("count"))).alias("tf"),
        F.sum(F.when(F.col("actual") & F.col("predicted"), F.col("count"))).alias("tt"))

    def cls(label: str, tp: str, fp: str, fn: str):
        p = F.coalesce(F.try_divide(F.col(tp).cast("double"), (F.col(tp) + F.col(fp)).cast("double")), F.lit(0.0))
        r = F.coalesce(F.try_divide(F.col(tp).cast("double"), (F.col(tp) + F.col(fn)).cast("double")), F.lit(0.0))
        f = F.when(p + r == 0, F.lit(0.0)).otherwise(F.lit(2.0) * p * r / (p + r))
        return F.struct(F.lit(label).alias("label"), p.alias("precision"), r.alias("recall"), f.alias("f1_score"),
                        (F.col(tp) + F.col(fn)).alias("support"))

    rows = per.select(F.inline(F.array(cls("false", "ff", "tf", "ft"), cls("true", "tt", "ft", "tf"))))
    totals = rows.agg(
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1_score").alias("mf"),
        (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("wp"),
        (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("wr"),
        (F.sum(F.col("f1_score") * F.col("support")) / F.sum("support")).alias("wf"),
        F.sum("support").alias("n"))
    avgs = totals.select(F.inline(F.array(
        F.struct(F.lit("macro avg").alias("label"), F.col("mp").alias("precision"), F.col("mr").alias("recall"),
                 F.col("mf").alias("f1_score"), F.col("n").alias("support")),
        F.struct(F.lit("weighted avg").alias("label"), F.col("wp").alias("precision"), F.col("wr").alias("recall"),
                 F.col("wf").alias("f1_score"), F.col("n").alias("support")))))
    return rows.unionByName(avgs)
