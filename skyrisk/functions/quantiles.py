"""Exact order statistics without gathering a group into one task.

``percentile`` / ``median`` keep every distinct value of a group in one aggregation buffer, so a
feature of a 100 TB table would end up in a single task.  Here:

1. value counts per (group, value) - a partial aggregate, so hot values collapse map-side;
2. a global ``orderBy(group, value)`` - Spark range-partitions the distinct values over all tasks;
3. one ``mapInPandas`` pass adds the partition id and a running count inside each partition
   (input order is the sorted order, no extra shuffle); the result is checkpointed to the
   reliable checkpoint folder so partition ids stay fixed if an executor is lost;
4. per-(partition, group) totals (a tiny table: partitions x groups) give each partition's
   offset; the requested ranks are matched to the one partition that holds them.

Of more than ``NARROW_ROWS`` rows only a small part is sorted: pivots from a bounded sample part the values into
intervals (they decide sizes only, never results), one pass counts each interval, and only the intervals that hold a
requested position go through these steps, the position less the values before its interval.

Positions are 0-based ranks into the ascending order of non-null values of the group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyrisk.session import cut_lineage, stored

NARROW_ROWS = 200_000
PIVOT_SAMPLE = 200_000
PIVOTS = 1_000  # for each group


def _running_counts(group_cols: Sequence[str]):
    """mapInPandas body: partition id + running count that restarts at each group change."""
    group_cols = list(group_cols)

    def run(batches):
        import numpy as np
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        last_key = None
        running = 0
        for pdf in batches:
            if pdf.empty:
                continue
            n = len(pdf)
            new_group = np.zeros(n, dtype=bool)
            for c in group_cols:
                col = pdf[c].to_numpy(dtype=object)
                new_group[1:] |= col[1:] != col[:-1]
            if last_key is None:
                new_group[0] = True
            else:
                new_group[0] = any(pdf[c].iloc[0] != k for c, k in zip(group_cols, last_key))
            seg = np.cumsum(new_group)
            cnt = pdf["_cnt"].to_numpy(dtype=np.int64)
            total = np.cumsum(cnt)
            # running sum restarting at every segment start
            starts = np.flatnonzero(new_group)
            base = np.zeros(n, dtype=np.int64)
            if len(starts):
                prior = np.concatenate([[0], total])[starts]
                base = np.where(seg == 0, 0, prior[np.maximum(seg - 1, 0)])
            local = total - base
            if not new_group[0]:
                local = np.where(seg == 0, local + running, local)
            pdf = pdf.assign(_pid=np.int32(pid), _cum=local.astype(np.int64))
            running = int(local[-1])
            last_key = tuple(pdf[c].iloc[-1] for c in group_cols)
            yield pdf

    return run


def ranked_values(values: DataFrame, group_cols: Sequence[str], value_col: str, count_col: str | None = None) -> DataFrame:
    """(group..., value, _cnt, _pid, _cum) with _cum the running count inside the partition;
    checkpointed.  With ``count_col`` the rows are value counts already."""
    g = list(group_cols)
    known = values.where(F.col(value_col).isNotNull())
    if count_col:
        vc = known.where(F.col(count_col) > 0).select(*g, value_col, F.col(count_col).alias("_cnt"))
    else:
        vc = known.groupBy(*g, value_col).agg(F.count(F.lit(1)).alias("_cnt"))
    ordered = vc.orderBy(*[F.asc(c) for c in g], F.asc(value_col))
    schema = T.StructType(list(vc.schema.fields) + [T.StructField("_pid", T.IntegerType()),
                                                   T.StructField("_cum", T.LongType())])
    return cut_lineage(ordered.mapInPandas(_running_counts(g), schema))


def order_statistics(values: DataFrame, group_cols: Sequence[str], value_col: str, targets: DataFrame,
                     pos_col: str = "pos", count_col: str | None = None) -> DataFrame:
    """Value at each requested 0-based position.

    ``targets`` has the group columns and ``pos_col`` (long); returns targets + ``value``.
    Positions outside [0, n) give NULL."""
    g = list(group_cols)
    kept = values.where(F.col(value_col).isNotNull())
    kept = kept.where(F.col(count_col) > 0) if count_col else kept
    rows = kept.count()
    if rows <= NARROW_ROWS:
        return _ranked_statistics(values, g, value_col, targets, pos_col, count_col)
    targets = cut_lineage(targets)  # read below by three joins
    n = F.col(count_col) if count_col else F.lit(1)
    placed = _in_intervals(kept.select(*g, value_col, n.cast("long").alias("_n")), g, value_col, rows)
    sizes = placed.groupBy(*g, "_interval").agg(F.sum("_n").alias("_size"))  # at most groups x pivots rows
    before = Window.partitionBy(*g).orderBy("_interval").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    inside = (F.col(pos_col) >= F.col("_before")) & (F.col(pos_col) < F.col("_before") + F.col("_size"))
    located = cut_lineage(targets.join(sizes, g).where(inside).select(*g, pos_col, "_interval", (F.col(pos_col) - F.col("_before")).alias("_at")))
    few = placed.join(F.broadcast(located.select(*g, "_interval").distinct()), [*g, "_interval"])
    few = few.groupBy(*g, "_interval", value_col).agg(F.sum("_n").alias("_n"))
    found = _ranked_statistics(few, [*g, "_interval"], value_col, located.select(*g, "_interval", "_at").distinct(), "_at", "_n")
    return targets.join(located.join(found, [*g, "_interval", "_at"]).select(*g, pos_col, "value"), [*g, pos_col], "left")


def _in_intervals(values: DataFrame, g: list[str], value_col: str, rows: int) -> DataFrame:
    """``values`` with ``_interval``, which never falls as the value grows: its place among the pivots of all groups."""
    held = values.withColumn("_v", F.col(value_col).cast("double") + F.lit(0.0))
    some = held.sample(min(1.0, PIVOT_SAMPLE / rows), seed=11).where(~F.isnan("_v"))
    cuts = some.groupBy(*g).agg(F.percentile_approx("_v", [i / PIVOTS for i in range(1, PIVOTS)], 10 * PIVOTS).alias("_p"))
    inner = sorted({r["_p"] for r in cuts.select(F.explode("_p").alias("_p")).distinct().collect()} - {float("inf"), float("-inf")})  # of a bounded sample
    parts = Bucketizer(splits=[float("-inf"), *(inner or [0.0]), float("inf")], inputCol="_v", outputCol="_interval", handleInvalid="keep")
    return parts.transform(held).drop("_v")


def _ranked_statistics(values: DataFrame, g: list[str], value_col: str, targets: DataFrame, pos_col: str, count_col: str | None) -> DataFrame:
    ranked = ranked_values(values, g, value_col, count_col)
    part = ranked.groupBy("_pid", *g).agg(F.max("_cum").alias("_pcnt"))
    before = Window.partitionBy(*g).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    part = part.withColumn("_off", F.coalesce(F.sum("_pcnt").over(before), F.lit(0)))
    # which partition holds each target position
    located = targets.join(part, g, "inner").where(
        (F.col(pos_col) >= F.col("_off")) & (F.col(pos_col) < F.col("_off") + F.col("_pcnt"))
    ).select(*g, pos_col, "_pid", "_off")
    hits = ranked.join(F.broadcast(located), [*g, "_pid"]).where(
        (F.col(pos_col) - F.col("_off") < F.col("_cum"))
        & (F.col(pos_col) - F.col("_off") >= F.col("_cum") - F.col("_cnt"))
    ).select(*g, pos_col, F.col(value_col).alias("value"))
    return targets.join(hits, [*g, pos_col], "left")


def group_counts(values: DataFrame, group_cols: Sequence[str], value_col: str, count_col: str | None = None) -> DataFrame:
    n = F.sum(count_col) if count_col else F.count(F.lit(1))
    return values.where(F.col(value_col).isNotNull()).groupBy(*group_cols).agg(n.alias("n")).where("n > 0")


def exact_quantiles(values: DataFrame, group_cols: Sequence[str], value_col: str,
                    probabilities: Sequence[float], count_col: str | None = None) -> DataFrame:
    """Linear-interpolation quantiles (NumPy's default rule) per group.

    Returns (group..., q_index, q, quantile).  h = (n-1)*q; result = x[floor h] +
    (h - floor h) * (x[floor h + 1] - x[floor h])."""
    g = list(group_cols)
    spark = values.sparkSession
    qs = spark.createDataFrame([(i, float(q)) for i, q in enumerate(probabilities)], "q_index int, q double")
    counts = cut_lineage(group_counts(values, g, value_col, count_col))  # a row for each group, read several times
    h = (F.col("n") - 1) * F.col("q")
    grid = (counts.crossJoin(F.broadcast(qs))
            .select(*g, "q_index", "q", "n", h.alias("_h"), F.floor(h).cast("long").alias("_lo")))
    lo_hi = (grid.select(*g, F.col("_lo").alias("pos"))
             .union(grid.select(*g, F.least(F.col("_lo") + 1, F.col("n") - 1).alias("pos")))
             .distinct())
    stats = order_statistics(values, g, value_col, lo_hi, count_col=count_col)
    lo = stats.select(*g, F.col("pos").alias("_lo"), F.col("value").alias("_xlo"))
    hi = stats.select(*g, (F.col("pos") - 1).alias("_lo"), F.col("value").alias("_xhi"))
    out = grid.join(lo, [*g, "_lo"], "left").join(hi, [*g, "_lo"], "left")
    frac = F.col("_h") - F.col("_lo")
    value = F.when(F.col("_xhi").isNull() | (frac == 0), F.col("_xlo")).otherwise(
        F.col("_xlo") + frac * (F.col("_xhi") - F.col("_xlo")))
    return out.select(*g, "q_index", "q", value.alias("quantile"))


def exact_medians(df: DataFrame, columns: Sequence[str], is_stored: bool = False) -> DataFrame:
    """One row per column: (feature, median), exact and interpolated.  Several passes read ``df``; its columns are
    stored for them unless the caller has done so (``is_stored``)."""
    held = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    held = held if is_stored else stored(held)
    long = held.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in columns
    ])).alias("_kv")).select("_kv.feature", "_kv.value")
    q = exact_quantiles(long, ["feature"], "value", [0.5])
    return q.select("feature", F.col("quantile").alias("median"))
