"""Training features: engineering, cleansing, scaling, encoding and the stratified split.

Fitted statistics (medians, means, population std, category lists) are small one-row or
one-row-per-column frames joined back by broadcast: their size is bounded by the number of
columns, not by the data.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyrisk.functions.columns import finite_or_null
from skyrisk.functions.quantiles import exact_medians, order_statistics
from skyrisk.operators.physics import sphere_mass
from skyrisk.schemas import (DENSITY_KG_M3, DROP_COLUMNS, FEATURE_COLUMNS, FEATURE_EPS, SEED,
                             SPLIT_TEST_SIZE, TARGET_COLUMN)
from skyrisk.session import cut_lineage


def engineered_features(df: DataFrame, density: float = DENSITY_KG_M3, drop: bool = True) -> DataFrame:
    """diameter_range (mean of min/max, km), est_mass_kg, est_kinetic_energy_j, inv_miss_dist,
    impact_risk_index = log1p(E * inv); then the drop-list columns are removed."""
    dr = (F.col("max_diameter_km") + F.col("min_diameter_km")) / F.lit(2.0)
    r = F.col("diameter_range") / F.lit(2.0)
    volume_km3 = F.lit(4.0 / 3.0 * math.pi) * (r * r * r)
    v = F.col("relative_velocity_kps") * F.lit(1000.0)
    out = (df.withColumn("diameter_range", dr)
           .withColumn("est_mass_kg", volume_km3 * F.lit(1e9) * F.lit(float(density)))
           .withColumn("est_kinetic_energy_j", F.lit(0.5) * F.col("est_mass_kg") * (v * v))
           .withColumn("inv_miss_dist", F.lit(1.0) / (F.col("miss_distance_km") + F.lit(FEATURE_EPS)))
           .withColumn("impact_risk_index", F.log1p(F.col("est_kinetic_energy_j") * F.col("inv_miss_dist"))))
    return drop_columns(out, DROP_COLUMNS) if drop else out


def diameter_spread(df: DataFrame) -> DataFrame:
    """The drift-side diameter_range: max - min."""
    return df.withColumn("diameter_range", F.col("max_diameter_km") - F.col("min_diameter_km"))


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop listed columns; names not present are ignored."""
    return df.drop(*[c for c in cols if c in df.columns])


def feature_target(df: DataFrame, features: Sequence[str] = FEATURE_COLUMNS, target: str = TARGET_COLUMN) -> DataFrame:
    return df.select(*features, target)


def fit_medians(df: DataFrame, cols: Sequence[str], is_stored: bool = False) -> DataFrame:
    """(feature, median) over finite values, exact; ``is_stored`` as in ``exact_medians``."""
    clean = df.select(*[finite_or_null(F.col(c).cast("double")).alias(c) for c in cols])
    return exact_medians(clean, cols, is_stored)


def impute_median(df: DataFrame, cols: Sequence[str], fitted: DataFrame | None = None) -> DataFrame:
    """+-inf / NaN -> NULL, NULL -> the column's exact median (from ``fitted`` when given,
    else from ``df`` itself).  The medians are one row per column, broadcast back."""
    cols = list(cols)
    med = fitted if fitted is not None else fit_medians(df, cols)
    wide = med.groupBy().pivot("feature", cols).agg(F.first("median"))
    wide = wide.select(*[F.col(c).alias(f"_med_{c}") for c in cols])
    joined = df.crossJoin(F.broadcast(wide))
    out = joined.select(*[
        F.coalesce(finite_or_null(F.col(c).cast("double")), F.col(f"_med_{c}")).alias(c) if c in cols else F.col(c)
        for c in df.columns
    ])
    return out


def skew_transform(df: DataFrame) -> DataFrame:
    """ln(diameter_range), ln(velocity), sqrt(miss)."""
    return (df.withColumn("diameter_range", F.ln("diameter_range"))
            .withColumn("relative_velocity_kps", F.ln("relative_velocity_kps"))
            .withColumn("miss_distance_km", F.sqrt("miss_distance_km")))


def fit_standard(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row: mean and population std per column (zero std -> 1)."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"_mean_{c}"), F.stddev_pop(c).alias(f"_std_{c}")]
    stats = df.agg(*aggs)
    return stats.select(*[F.col(f"_mean_{c}") for c in cols],
                        *[F.when(F.col(f"_std_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"_std_{c}")).alias(f"_std_{c}")
                          for c in cols])


def standard_scale(df: DataFrame, cols: Sequence[str], fitted: DataFrame | None = None) -> DataFrame:
    """(x - mean) / population std; statistics from ``fitted`` (one row) or from ``df``."""
    cols = list(cols)
    stats = fitted if fitted is not None else fit_standard(df, cols)
    joined = df.crossJoin(F.broadcast(stats))
    return joined.select(*[
        ((F.col(c) - F.col(f"_mean_{c}")) / F.col(f"_std_{c}")).alias(c) if c in cols else F.col(c)
        for c in df.columns
    ])


MAX_CATEGORIES = 10_000


def fit_categories(df: DataFrame, col: str) -> DataFrame:
    """Sorted distinct categories with their index (0..k-1); more than ``MAX_CATEGORIES`` raise, as the
    result is broadcast and its window is one task."""
    cats = df.select(F.col(col).alias("category")).where(F.col("category").isNotNull()).distinct()
    if cats.limit(MAX_CATEGORIES + 1).count() > MAX_CATEGORIES:
        raise ValueError(f"{col} has more than {MAX_CATEGORIES} categories")
    return cats.withColumn("index", F.dense_rank().over(Window.orderBy("category")) - 1)


def one_hot(df: DataFrame, col: str, categories: Sequence | None = None) -> DataFrame:
    """One 0/1 column per sorted category, nothing dropped; an unseen value raises."""
    if categories is None:
        categories = [r["category"] for r in fit_categories(df, col).orderBy("index").collect()]
    names = [f"{col}_{str(v).lower()}" for v in categories]
    known = F.col(col).isin(list(categories))
    checked = F.when(known | F.col(col).isNull(), F.col(col)).otherwise(
        F.raise_error(F.concat(F.lit(f"unknown category in {col}: "), F.col(col).cast("string"))))
    out = df.withColumn(col, checked)
    for v, n in zip(categories, names):
        out = out.withColumn(n, (F.col(col) == F.lit(v)).cast("double"))
    return out.drop(col)


def label_encode(df: DataFrame, col: str, fitted: DataFrame | None = None, out_col: str | None = None) -> DataFrame:
    """Sorted classes -> 0..k-1 (joined from the fitted class table)."""
    classes = fitted if fitted is not None else fit_categories(df, col)
    out_col = out_col or f"{col}_index"
    m = classes.select(F.col("category").alias(col), F.col("index").alias(out_col))
    return df.join(F.broadcast(m), col, "left")  # fit_categories bounds the classes


def split_key(key_cols: Sequence[str]):
    return F.concat_ws(":", *[F.col(c).cast("string") for c in key_cols])


def stratified_split(df: DataFrame, label: str, key_cols: Sequence[str], test_size: float = SPLIT_TEST_SIZE,
                     seed: int = SEED) -> DataFrame:
    """Adds ``is_test``: per label, the ceil(test_size * n_label) rows with the smallest
    deterministic hash u = md5(seed:key) are test rows; rows without a label are split like one more
    label.  The per-label threshold is an exact order statistic (no window over a whole label), and
    only the thresholds, a row for each label, are broadcast."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), split_key(key_cols))), 1, 15), 16, 10).cast("long")
    keyed = df.withColumns({"_h": h, "_y": F.coalesce(F.col(label).cast("string"), F.lit("no label"))})
    counts = keyed.groupBy("_y").agg(F.count(F.lit(1)).alias("_n"))
    targets = counts.select("_y", (F.ceil(F.col("_n") * F.lit(float(test_size))) - 1).cast("long").alias("pos"))
    thresholds = order_statistics(keyed.select("_y", "_h"), ["_y"], "_h", targets.where(F.col("pos") >= 0))
    t = cut_lineage(thresholds.select("_y", F.col("value").alias("_thr")))  # a row for each label, found once
    out = keyed.join(F.broadcast(t), "_y", "left")
    return out.withColumn("is_test", F.coalesce(F.col("_h") <= F.col("_thr"), F.lit(False))).drop("_h", "_y", "_thr")
