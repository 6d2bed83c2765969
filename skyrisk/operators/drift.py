"""Data-drift report: PSI (numeric and categorical) and chi-square goodness of fit.

All features are handled at once in long form (feature, value): the few columns of both sides are materialised
once, and edges, histograms and row counts are passes over them, none of which sorts or shuffles all values; one grouped
count serves the categories.  The per-feature edge arrays (<= buckets + 1 values per feature) are the only
broadcast.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyrisk.functions.columns import drift_status
from skyrisk.functions.quantiles import exact_quantiles
from skyrisk.functions.special import chi2_sf
from skyrisk.schemas import CHI2_ALPHA, NUMERIC_BUCKETS, PSI_ALERT, PSI_EPS, PSI_WARN
from skyrisk.session import cut_lineage

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
_CATEGORICAL = (T.StringType, T.BooleanType)


def align_columns(base: DataFrame, new: DataFrame, include: Sequence[str] | None = None,
                  exclude: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame, list[str], list[str]]:
    """Common columns (base order), filtered by include / exclude; split numeric vs categorical
    (string / boolean).  Other types (dates, timestamps) are left out."""
    common = [c for c in base.columns if c in set(new.columns)]
    if include is not None:
        common = [c for c in common if c in set(include)]
    if exclude is not None:
        common = [c for c in common if c not in set(exclude)]
    types = {f.name: f.dataType for f in base.schema.fields}
    numeric = [c for c in common if isinstance(types[c], _NUMERIC)]
    categorical = [c for c in common if isinstance(types[c], _CATEGORICAL)]
    return base.select(*common), new.select(*common), numeric, categorical


def numeric_long(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(feature, value) for non-null, non-NaN values, with the columns ``keep``."""
    kv = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"))
                             for c in cols])).alias("_kv")
    long = df.select(kv, *keep).select("_kv.feature", "_kv.value", *keep)
    return long.where(F.col("value").isNotNull() & ~F.isnan("value"))


def categorical_long(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    kv = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("category"))
                             for c in cols])).alias("_kv")
    return df.select(kv, *keep).select("_kv.feature", "_kv.category", *keep).where(F.col("category").isNotNull())


def value_counts(base_long: DataFrame, new_long: DataFrame) -> DataFrame:
    """(feature, value, b, n): how often each value occurs on either side.  One pass over each side,
    materialised once; edges, histograms and row counts all come from it."""
    tagged = base_long.select("feature", "value", F.lit(1).alias("b"), F.lit(0).alias("n")).unionByName(
        new_long.select("feature", "value", F.lit(0).alias("b"), F.lit(1).alias("n")))
    return cut_lineage(tagged.groupBy("feature", "value").agg(F.sum("b").alias("b"), F.sum("n").alias("n")))


def baseline_edges(base_long: DataFrame, buckets: int = NUMERIC_BUCKETS, count_col: str | None = None) -> DataFrame:
    """(feature, edges): exact linear-interpolation quantiles at 0, 1/b, ..., 1 of the baseline,
    de-duplicated and sorted; fewer than 3 edges -> [min, median, max].  ``count_col``: the rows are
    value counts."""
    probs = sorted({i / buckets for i in range(buckets + 1)} | {0.5})
    q = exact_quantiles(base_long, ["feature"], "value", probs, count_col)
    grid = [i / buckets for i in range(buckets + 1)]
    per = q.groupBy("feature").agg(
        F.array_sort(F.array_distinct(F.collect_list(F.when(F.col("q").isin(grid), F.col("quantile"))))).alias("_e"),
        F.min("quantile").alias("_min"),
        F.max(F.when(F.col("q") == 0.5, F.col("quantile"))).alias("_median"),
        F.max("quantile").alias("_max"))
    edges = F.when(F.size("_e") < 3, F.array("_min", "_median", "_max")).otherwise(F.col("_e"))
    # one row per feature: materialised once, then read by the bin grid and both histograms
    return cut_lineage(per.select("feature", edges.alias("edges")))


def _bins(long: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows with their ``bin``: half-open bins, the last one closed; values outside the edges are
    dropped (searchsorted counting, so repeated edges behave like NumPy's histogram)."""
    j = long.join(F.broadcast(edges), "feature")
    n_bins = F.size("edges") - 1
    in_range = (F.col("value") >= F.element_at("edges", 1)) & (F.col("value") <= F.element_at("edges", -1))
    most = edges.agg(F.max(F.size("edges"))).first()[0] or 0  # a few edges for each feature
    le = reduce(add, (F.coalesce((F.get("edges", F.lit(i)) <= F.col("value")).cast("int"), F.lit(0)) for i in range(most)), F.lit(0))
    return j.where(in_range).withColumn("bin", F.least(le - 1, n_bins - 1).cast("long")).drop("edges")


def histogram_on_edges(long: DataFrame, edges: DataFrame) -> DataFrame:
    """(feature, bin, count) of the values on the edges."""
    return _bins(long, edges).groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("count"))


def _psi_terms(b: str, n: str, btot: str, ntot: str):
    bp = F.greatest(F.col(b) / F.greatest(F.col(btot), F.lit(1)).cast("double"), F.lit(PSI_EPS))
    np_ = F.greatest(F.col(n) / F.greatest(F.col(ntot), F.lit(1)).cast("double"), F.lit(PSI_EPS))
    return (bp - np_) * F.ln(bp / np_)


def psi_numeric_bins(counts: DataFrame, buckets: int = NUMERIC_BUCKETS) -> DataFrame:
    """Per (feature, bin) of ``value_counts``: baseline and new counts (zero-filled) and totals."""
    edges = baseline_edges(counts, buckets, "b")
    bins = edges.select("feature", F.explode(F.sequence(F.lit(0).cast("long"), (F.size("edges") - 2).cast("long"))).alias("bin"))
    held = _bins(counts, edges).groupBy("feature", "bin").agg(F.sum("b").alias("b"), F.sum("n").alias("n"))
    g = bins.join(held, ["feature", "bin"], "left").select("feature", "bin", F.coalesce("b", F.lit(0)).alias("b"), F.coalesce("n", F.lit(0)).alias("n"))
    tot = g.groupBy("feature").agg(F.sum("b").alias("btot"), F.sum("n").alias("ntot"))
    return g.join(tot, "feature")


def psi_numeric(base_long: DataFrame | None, new_long: DataFrame | None, buckets: int = NUMERIC_BUCKETS, counts: DataFrame | None = None) -> DataFrame:
    """(feature, psi) with bins on baseline quantiles."""
    g = psi_numeric_bins(counts if counts is not None else value_counts(base_long, new_long), buckets)
    return g.groupBy("feature").agg(F.sum(_psi_terms("b", "n", "btot", "ntot")).alias("psi"))


def category_counts(base_long: DataFrame, new_long: DataFrame) -> DataFrame:
    """(feature, category, b, n) over the union of categories, zero-filled, plus side totals."""
    return with_totals(category_sides(base_long, new_long))


def category_sides(base_long: DataFrame, new_long: DataFrame) -> DataFrame:
    tagged = (base_long.select("feature", "category", F.lit(True).alias("_base"))
              .unionByName(new_long.select("feature", "category", F.lit(False).alias("_base"))))
    return tagged.groupBy("feature", "category").agg(F.count_if(F.col("_base")).alias("b"), F.count_if(~F.col("_base")).alias("n"))


def with_totals(c: DataFrame) -> DataFrame:
    tot = c.groupBy("feature").agg(F.sum("b").alias("btot"), F.sum("n").alias("ntot"),
                                   F.count(F.lit(1)).alias("k"))
    return c.join(tot, "feature")


def categorical_stats(base_long: DataFrame | None, new_long: DataFrame | None, counts: DataFrame | None = None) -> DataFrame:
    """(feature, psi, chi2_masked, chi2_stat, dof, baseline_count, new_count): PSI on proportions; chi-square with expected =
    baseline share x new total, masked (expected 0 skipped) and floored at 1e-12 (for the test)."""
    c = with_totals(counts) if counts is not None else category_counts(base_long, new_long)
    expected = F.col("b") / F.greatest(F.col("btot"), F.lit(1)).cast("double") * F.col("ntot")
    floored = F.greatest(expected, F.lit(PSI_EPS))
    masked = F.when(expected > 0, (F.col("n") - expected) * (F.col("n") - expected) / expected).otherwise(F.lit(0.0))
    return c.groupBy("feature").agg(
        F.sum(_psi_terms("b", "n", "btot", "ntot")).alias("psi"),
        F.sum(masked).alias("chi2_masked"),
        F.sum((F.col("n") - floored) * (F.col("n") - floored) / floored).alias("chi2_stat"),
        (F.max("k") - 1).alias("dof"), F.max("btot").alias("baseline_count"), F.max("ntot").alias("new_count"))


def drift_report(base: DataFrame, new: DataFrame, run_id: str, created_at: dt.datetime | str,
                 numeric_buckets: int = NUMERIC_BUCKETS, psi_warn: float = PSI_WARN, psi_alert: float = PSI_ALERT,
                 chi2_alpha: float = CHI2_ALPHA, include: Sequence[str] | None = None,
                 exclude: Sequence[str] | None = None, with_p_value: bool = True) -> DataFrame:
    """One row per feature (numeric first, then categorical); features with an empty side skipped."""
    b, n, num, cat = align_columns(base, new, include, exclude)
    sides = cut_lineage(reduce(DataFrame.unionByName, [x.select(*[F.col(c).cast("double").alias(c) for c in num], *[F.col(c) if b.schema[c].dataType == n.schema[c].dataType else F.col(c).cast("string").alias(c) for c in cat],
                                                                F.lit(side).alias("_b"), F.lit(1 - side).alias("_n")) for x, side in ((b, 1), (n, 0))]))
    values = numeric_long(sides, num, ["_b", "_n"]).withColumnsRenamed({"_b": "b", "_n": "n"}) if num else None
    categories = categorical_long(sides, cat, ["_b", "_n"]).groupBy("feature", "category").agg(F.sum("_b").alias("b"), F.sum("_n").alias("n")) if cat else None
    return report_from_counts(base.sparkSession, values, categories, run_id, created_at, numeric_buckets, psi_warn, psi_alert, chi2_alpha, with_p_value)


def report_from_counts(spark: SparkSession, values: DataFrame | None, categories: DataFrame | None, run_id: str, created_at: dt.datetime | str,
                       numeric_buckets: int = NUMERIC_BUCKETS, psi_warn: float = PSI_WARN, psi_alert: float = PSI_ALERT,
                       chi2_alpha: float = CHI2_ALPHA, with_p_value: bool = True) -> DataFrame:
    """The report from counts of both sides: (feature, value, b, n), which may repeat a value, and (feature, category, b, n).
    The report, a row for each feature, is materialised, as its readers ask it more than once."""
    ts = F.lit(str(created_at)).cast("timestamp")
    parts = []
    if values is not None:
        counts = values.groupBy("feature").agg(F.sum("b").alias("baseline_count"), F.sum("n").alias("new_count"))
        psi = psi_numeric(None, None, numeric_buckets, values).join(counts.where("baseline_count > 0 AND new_count > 0"), "feature")
        parts.append(psi.select(
            "feature", F.lit("numeric").alias("feature_type"), F.lit("psi").alias("method"), "psi",
            F.lit(None).cast("double").alias("chi2_stat"), F.lit(None).cast("double").alias("chi2_p_value"),
            drift_status(F.col("psi"), None, psi_warn, psi_alert).alias("drift_status"),
            "baseline_count", "new_count"))
    if categories is not None:
        st = categorical_stats(None, None, categories).where("baseline_count > 0 AND new_count > 0")
        if with_p_value:
            p = F.when(F.col("dof") > 0, chi2_sf(F.col("chi2_stat"), F.col("dof").cast("double")))
            method, stat = F.lit("psi+chi2"), F.col("chi2_stat")
        else:
            p, method, stat = F.lit(None).cast("double"), F.lit("psi"), F.col("chi2_masked")
        st = st.withColumn("chi2_p_value", p)
        parts.append(st.select(
            "feature", F.lit("categorical").alias("feature_type"), method.alias("method"), "psi",
            stat.alias("chi2_stat"), "chi2_p_value",
            drift_status(F.col("psi"), F.col("chi2_p_value"), psi_warn, psi_alert, chi2_alpha).alias("drift_status"),
            "baseline_count", "new_count"))
    if not parts:
        schema = "run_id string, feature string, feature_type string, method string, psi double, chi2_stat double, " \
                 "chi2_p_value double, chi2_alpha double, drift_status string, baseline_count long, " \
                 "new_count long, created_at timestamp"
        return spark.createDataFrame([], schema)
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    out = cut_lineage(out)
    return out.select(F.lit(run_id).alias("run_id"), "feature", "feature_type", "method", "psi", "chi2_stat",
                      "chi2_p_value", F.lit(float(chi2_alpha)).alias("chi2_alpha"), "drift_status",
                      F.col("baseline_count").cast("long"), F.col("new_count").cast("long"), ts.alias("created_at"))
