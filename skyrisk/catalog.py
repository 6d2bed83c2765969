"""Registered queries: name -> (spark callable(spark, sf_dir) -> DataFrame, DuckDB oracle SQL or None).

Every query reads the driver tables (through the adapters) over their whole extent; parameters
(an id to look up, a page, a week) are the features being exercised, not row caps.
"""

from __future__ import annotations

from collections.abc import Callable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyrisk import oracle as O
from skyrisk.operators import explore as X
from skyrisk.sources import fixtures as FX
from skyrisk.sources.ingest import scan_table

QueryFn = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}


def dates_as_text(df: DataFrame) -> DataFrame:
    """Date / timestamp columns as ISO text, so both engines hash the same value."""
    from pyspark.sql import types as T

    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            cols.append(F.col(f.name).cast("string").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def register(name: str, sql: str | None):
    def deco(fn: QueryFn) -> QueryFn:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return dates_as_text(fn(spark, sf_dir))

        run.__name__ = name
        _REGISTRY[name] = (run, sql)
        return fn
    return deco


# ---------------------------------------------------------------- shared inputs
def appr(spark, sf):
    return FX.approaches(spark, sf)


def pred(spark, sf):
    return FX.predictions_from(appr(spark, sf))


def risk(spark, sf):
    from skyrisk.operators.risk import risk_table

    a, p = appr(spark, sf), pred(spark, sf)
    early = risk_table(a, p, FX.RISK_EARLIER_AS_OF, dd_weights=FX.FIXED_DD_WEIGHTS)
    late = risk_table(a, p, FX.RISK_AS_OF, dd_weights=FX.FIXED_DD_WEIGHTS)
    return early.unionByName(late)


def logs(spark, sf):
    return FX.model_logs(spark, sf)


B, BP, BR, BL = O.BASE, O.BASE_PRED, O.BASE_RISK, O.BASE_LOGS
LC, BC = O.LATEST_COLS, O.BOARD_COLS
KNOWN_BEFORE = "1995-06-01"  # ids seen before this date form the "known" set

# ---------------------------------------------------------------- F1 / scans
register("latest_approach", f"{B}SELECT {LC} FROM latest")(
    lambda s, sf: X.latest_approach(appr(s, sf).select(*X.LATEST_COLUMNS), X.LATEST_COLUMNS))

register("scan_table", "SELECT * FROM part")(
    lambda s, sf: scan_table(s, f"{sf}/part.parquet", FX.table(s, sf, "part").schema))

register("approaches", f"{B}SELECT * FROM approaches")(lambda s, sf: appr(s, sf))

# ---------------------------------------------------------------- C filters
register("filter_flags", f"{B}SELECT * FROM approaches WHERE is_potentially_hazardous = true AND is_sentry_object = false")(
    lambda s, sf: X.filter_flags(appr(s, sf), hazardous=True, sentry=False))

register("search_name", f"{B}SELECT * FROM approaches WHERE name ILIKE '%red w%'")(
    lambda s, sf: X.search_name(appr(s, sf), "  red w "))

register("lookup_id", f"{B}SELECT * FROM approaches WHERE id = 1032")(
    lambda s, sf: X.lookup_id(appr(s, sf), 1032))

register("week_window", f"{B}SELECT * FROM approaches WHERE {O.week_filter(FX.RISK_AS_OF)}")(
    lambda s, sf: X.week_window(appr(s, sf), FX.RISK_AS_OF))

_CUT = "(SELECT CAST(max(CAST(training_date AS DATE)) AS VARCHAR) AS model_last_trained FROM model_logs)"
register("baseline_split",
         f"{BL}SELECT a.*, c.model_last_trained FROM approaches a CROSS JOIN {_CUT} c "
         f"WHERE CAST(a.close_approach_date AS DATE) < CAST(c.model_last_trained AS DATE)")(
    lambda s, sf: X.baseline_split(appr(s, sf), logs(s, sf))[0])
register("current_split",
         f"{BL}SELECT a.*, c.model_last_trained FROM approaches a CROSS JOIN {_CUT} c "
         f"WHERE CAST(a.close_approach_date AS DATE) >= CAST(c.model_last_trained AS DATE)")(
    lambda s, sf: X.baseline_split(appr(s, sf), logs(s, sf))[1])
register("last_training_date", f"{BL}SELECT * FROM {_CUT} t")(
    lambda s, sf: X.training_cutoff(logs(s, sf)))

for _mode, _where in (("pho", "is_potentially_hazardous"), ("sentry", "is_sentry_object"),
                      ("safe", "NOT coalesce(is_potentially_hazardous, false) AND NOT coalesce(is_sentry_object, false)")):
    register(f"population_{_mode}", f"{B}SELECT {LC} FROM latest WHERE {_where}")(
        (lambda m: lambda s, sf: X.population_filter(appr(s, sf), m))(_mode))
register("population_count_safe",
         f"{B}SELECT count(*) AS visible FROM latest WHERE NOT coalesce(is_potentially_hazardous, false) "
         f"AND NOT coalesce(is_sentry_object, false)")(
    lambda s, sf: X.population_count(appr(s, sf), "safe"))

# ---------------------------------------------------------------- D joins
register("join_predictions",
         f"{BP}SELECT a.*, p.actual, p.model_prediction, p.probability_being_falsely_hazardous, "
         f"p.probability_being_truely_hazardous, p.trained_model_date_used "
         f"FROM approaches a JOIN predictions p ON TRY_CAST(p.id AS BIGINT) = a.id")(
    lambda s, sf: X.join_predictions(appr(s, sf), pred(s, sf)))

register("predictions", f"{BP}SELECT * FROM predictions")(lambda s, sf: pred(s, sf))

register("new_ids",
         f"{B}SELECT DISTINCT id FROM approaches EXCEPT SELECT DISTINCT id FROM approaches "
         f"WHERE close_approach_date < '{KNOWN_BEFORE}'")(
    lambda s, sf: X.new_ids(appr(s, sf), appr(s, sf).where(F.col("close_approach_date") < KNOWN_BEFORE)))
register("new_ids_except",
         f"{B}SELECT id FROM approaches EXCEPT SELECT id FROM approaches WHERE close_approach_date < '{KNOWN_BEFORE}'")(
    lambda s, sf: X.new_ids_except(appr(s, sf), appr(s, sf).where(F.col("close_approach_date") < KNOWN_BEFORE)))

# ---------------------------------------------------------------- E aggregates
register("global_stats",
         f"{B[:-1]}, per_id AS (SELECT id, count(*) AS n, bool_or(coalesce(is_potentially_hazardous, false)) AS pho, "
         f"bool_or(coalesce(is_sentry_object, false)) AS sentry, min(miss_distance_km) AS near, max(relative_velocity_kps) AS fast, "
         f"max(close_approach_date) AS newest FROM approaches GROUP BY id) "
         f"SELECT count(id) AS unique_asteroids, CAST(sum(n) AS BIGINT) AS total_approaches, "
         f"count(CASE WHEN pho THEN id END) AS unique_pho, count(CASE WHEN sentry THEN id END) AS unique_sentry, "
         f"min(near) AS min_miss_distance_km, max(fast) AS max_velocity_kps, max(newest) AS last_approach_date FROM per_id")(
    lambda s, sf: X.global_stats(appr(s, sf)))

register("distinct_ids", f"{B}SELECT DISTINCT id FROM approaches")(lambda s, sf: X.distinct_ids(appr(s, sf)))

register("filtered_total", f"{B}SELECT count(DISTINCT id) AS total FROM approaches WHERE is_potentially_hazardous = true")(
    lambda s, sf: X.filtered_total(appr(s, sf), hazardous=True))

# ---------------------------------------------------------------- F sorts / pages
register("list_page",
         f"{B}SELECT {LC} FROM latest WHERE is_potentially_hazardous = true ORDER BY id LIMIT 100 OFFSET 100")(
    lambda s, sf: X.list_page(appr(s, sf), page=2, limit=100, hazardous=True))

register("approach_timeline",
         f"{B}SELECT close_approach_date, close_approach_date_full, epoch_date_close_approach, relative_velocity_kps, "
         f"miss_distance_km, orbiting_body FROM approaches WHERE id = 1032")(
    lambda s, sf: X.approach_timeline(appr(s, sf), 1032))


def registry() -> dict[str, tuple[QueryFn, str | None]]:
    # import side modules that register more queries
    # ML queries register last: they are the slowest and run after everything else
    from skyrisk import catalog_more  # noqa: F401
    from skyrisk import catalog_drift  # noqa: F401
    from skyrisk import catalog_stream  # noqa: F401
    from skyrisk import catalog_ml  # noqa: F401
    return dict(_REGISTRY)
