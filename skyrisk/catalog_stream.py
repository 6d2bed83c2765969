"""Registered ingest and streaming queries.

Streams read file drops derived from the fact table: drop 1 = approaches before 1995-06-01,
drop 2 = the rest (ids first seen in drop 2 are the "new" ids).  Each drop is processed by its
own ``availableNow`` run over the same checkpoint, i.e. genuinely incremental micro-batches.
Scratch output lives under the session's checkpoint folder.
"""

from __future__ import annotations

import datetime
import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyrisk import oracle as O
from skyrisk.catalog import appr, register
from skyrisk.operators import explore as X
from skyrisk.operators.explore import LATEST_COLUMNS
from skyrisk.plans.jobs import Paths, job_ingest_week
from skyrisk.session import scratch_path
from skyrisk.sources import fixtures as FX
from skyrisk.sources import ingest as IN
from skyrisk.sources.ledger import Ledger
from skyrisk.sources.weeks import write_weeks
from skyrisk.streaming import new_ids as ST

W = O.with_
DROP_AT = "1995-06-01"
LC = O.LATEST_COLS


def _scratch(spark, tag: str) -> str:
    return scratch_path(spark, f"{tag}-{uuid.uuid4().hex}")


# ------------------------------------------------------------------ A1-A6, B19
def _feed_flatten(s, sf):
    landing = _scratch(s, "landing")
    FX.land_feed(appr(s, sf), landing)
    return IN.flatten_feed(IN.read_feed(s, landing))


register("feed_flatten", f"{W(O.APPROACHES)}SELECT * FROM approaches")(_feed_flatten)

register("feed_windows",
         f"{W(O.APPROACHES)}SELECT CAST(ws AS VARCHAR) AS window_start, CAST(least(ws + 6, t) AS VARCHAR) AS window_end "
         f"FROM (SELECT CAST(unnest(generate_series(s, t, INTERVAL 7 DAY)) AS DATE) AS ws, t FROM "
         f"(SELECT min(CAST(close_approach_date AS DATE)) AS s, max(CAST(close_approach_date AS DATE)) AS t FROM approaches))")(
    lambda s, sf: IN.feed_windows_for(appr(s, sf)))


def _csv(s, sf):
    return IN.csv_snapshot(appr(s, sf), _scratch(s, "csv"))


register("csv_snapshot", f"{W(O.APPROACHES)}SELECT * FROM approaches")(_csv)


def _append_twice(s, sf):
    path = _scratch(s, "append")
    a = appr(s, sf)
    IN.append_table(a, path)
    IN.append_table(a.limit(0), path)          # empty input writes nothing
    IN.append_table(a, path)
    return s.read.parquet(path)


register("append_sink", f"{W(O.APPROACHES)}SELECT * FROM approaches UNION ALL SELECT * FROM approaches")(_append_twice)


def _append_dedupe(s, sf):
    path = _scratch(s, "dedupe")
    a = appr(s, sf)
    IN.append_table(a, path, dedupe_keys=["id", "epoch_date_close_approach"])
    IN.append_table(a, path, dedupe_keys=["id", "epoch_date_close_approach"])
    return s.read.parquet(path)


register("append_dedupe", f"{W(O.APPROACHES)}SELECT * FROM approaches")(_append_dedupe)


def _dual(s, sf):
    pa, pb = _scratch(s, "dual-a"), _scratch(s, "dual-b")
    a, ledger = appr(s, sf), _scratch(s, "dual-ledger")
    for _ in range(2):  # the second time nothing is added
        IN.append_both(a, pa, pb, ledger, "run-1")
    return Ledger(s, ledger).read(pa, a.schema).unionByName(Ledger(s, ledger).read(pb, a.schema))


register("dual_sink", f"{W(O.APPROACHES)}SELECT * FROM approaches UNION ALL SELECT * FROM approaches")(_dual)

register("attach_constant",
         f"{W(O.APPROACHES)}SELECT *, '{FX.PREDICTION_MODEL_DATE}' AS trained_model_date_used, "
         f"'{FX.RISK_AS_OF}' AS risk_analysed_on_date, 'run-fixture' AS run_id FROM approaches")(
    lambda s, sf: IN.attach_constants(appr(s, sf), trained_model_date_used=FX.PREDICTION_MODEL_DATE,
                                      risk_analysed_on_date=datetime.date(2000, 7, 1),
                                      run_id="run-fixture"))


# ------------------------------------------------------------------ H1-H4
def _run_new_ids_table(s, sf, with_baseline: bool, events: bool = False):
    root = _scratch(s, "newids-table")
    a = appr(s, sf)
    inp, out, known, ckpt = f"{root}/in", f"{root}/out", f"{root}/known", f"{root}/ckpt"
    a.where(F.col("close_approach_date") < DROP_AT).write.parquet(f"{inp}/d1")
    stream = s.readStream.schema(a.schema).parquet(f"{inp}/*")
    baseline = a.where(F.col("close_approach_date") < DROP_AT).select("id") if with_baseline else None
    ST.run_new_ids_table(stream, out, known, ckpt, baseline)
    a.where(F.col("close_approach_date") >= DROP_AT).write.parquet(f"{inp}/d2")
    ST.run_new_ids_table(stream, out, known, ckpt, baseline)
    found = s.read.parquet(out).select(*LATEST_COLUMNS)
    return ST.to_events(found) if events else found


def _run_new_ids(s, sf, with_baseline: bool, events: bool = False):
    root = _scratch(s, "newids")
    a = appr(s, sf)
    inp, out, ckpt = f"{root}/in", f"{root}/out", f"{root}/ckpt"
    a.where(F.col("close_approach_date") < DROP_AT).write.parquet(f"{inp}/d1")
    stream = s.readStream.schema(a.schema).parquet(f"{inp}/*")
    baseline = a.where(F.col("close_approach_date") < DROP_AT).select("id") if with_baseline else None
    found = ST.stream_new_ids(stream, baseline)
    sink = ST.to_events(found) if events else found
    ST.run_available(sink, out, ckpt)                                                   # micro-batch(es) for drop 1
    a.where(F.col("close_approach_date") >= DROP_AT).write.parquet(f"{inp}/d2")
    ST.run_available(sink, out, ckpt)                                                   # drop 2, same state
    return s.read.schema(sink.schema).parquet(f"{out}/batch=*")


_L1 = f"""
d1 AS (SELECT * FROM approaches WHERE close_approach_date < '{DROP_AT}'),
d2 AS (SELECT * FROM approaches WHERE close_approach_date >= '{DROP_AT}'),
l1 AS (SELECT * EXCLUDE (_rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY epoch_date_close_approach DESC NULLS FIRST) AS _rn FROM d1) WHERE _rn = 1),
l2 AS (SELECT * EXCLUDE (_rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY epoch_date_close_approach DESC NULLS FIRST) AS _rn
       FROM d2 WHERE id NOT IN (SELECT id FROM d1)) WHERE _rn = 1)"""
register("stream_new_ids", f"{W(O.APPROACHES, _L1)}SELECT {LC} FROM l1 UNION ALL SELECT {LC} FROM l2")(
    lambda s, sf: _run_new_ids_table(s, sf, with_baseline=False))
register("stream_new_ids_state", f"{W(O.APPROACHES, _L1)}SELECT {LC} FROM l1 UNION ALL SELECT {LC} FROM l2")(
    lambda s, sf: _run_new_ids(s, sf, with_baseline=False))
register("stream_new_ids_baseline", f"{W(O.APPROACHES, _L1)}SELECT {LC} FROM l2")(
    lambda s, sf: _run_new_ids_table(s, sf, with_baseline=True))
register("stream_new_ids_state_baseline", f"{W(O.APPROACHES, _L1)}SELECT {LC} FROM l2")(
    lambda s, sf: _run_new_ids(s, sf, with_baseline=True))
# the payload is read back field by field, as the two engines space JSON differently
_PAYLOAD = {"id": "bigint", "name": "string", "miss_distance_km": "double", "relative_velocity_kps": "double", "close_approach_date": "string"}


def _events(s, sf):
    found = _run_new_ids_table(s, sf, with_baseline=True, events=True)
    text = found.columns[-1]
    data = F.get_json_object(F.col(text), "$.event").alias("event")
    return found.select(data, *[F.get_json_object(F.col(text), f"$.data.{c}").cast(t).alias(c) for c, t in _PAYLOAD.items()])


register("stream_new_id_events", f"{W(O.APPROACHES, _L1)}SELECT 'new_asteroid' AS event, {', '.join(_PAYLOAD)} FROM l2")(_events)


LIVE_DROPS = ["1993-01-01", "1995-06-01", "9999-12-31"]  # three drops: rows before each date that came in no earlier one


def _live_count(s, sf):
    """Three drops, each counted by its own run over the same state: the ids seen so far after each."""
    root = _scratch(s, "live")
    a = appr(s, sf)
    counts = ST.live_count(s.readStream.schema(a.schema).parquet(f"{root}/in/*"))
    for n, (first, after) in enumerate(zip([""] + LIVE_DROPS, LIVE_DROPS, strict=False)):
        a.where((F.col("close_approach_date") >= first) & (F.col("close_approach_date") < after)).write.parquet(f"{root}/in/d{n}")
        ST.run_live_count(counts, f"{root}/counts", f"{root}/ckpt")
    return ST.live_counts(s, f"{root}/counts")


register("stream_live_count",
         f"{W(O.APPROACHES)}SELECT CAST(n AS BIGINT) AS batch_id, (SELECT count(DISTINCT id) FROM approaches WHERE close_approach_date < after) AS live_count "
         f"FROM (VALUES {', '.join(f"({n}, '{d}')" for n, d in enumerate(LIVE_DROPS))}) t(n, after)")(_live_count)


def _by_week(s, sf):
    path = _scratch(s, "weeks")
    write_weeks(appr(s, sf), path)
    return s.read.parquet(path)


register("week_partitions", f"{W(O.APPROACHES)}SELECT *, CAST(date_trunc('week', CAST(close_approach_date AS DATE)) AS VARCHAR)[:10] AS approach_week FROM approaches")(_by_week)
register("week_window_pruned", f"{W(O.APPROACHES)}SELECT id, close_approach_date, epoch_date_close_approach FROM approaches WHERE {O.week_filter(FX.RISK_AS_OF)}")(
    lambda s, sf: X.week_window(_by_week(s, sf), FX.RISK_AS_OF).select("id", "close_approach_date", "epoch_date_close_approach"))


def _committed_runs(s, sf):
    """Two runs, the second started twice, one that stopped before its commit, and the first two compacted: one copy."""
    root = _scratch(s, "ledger")
    a = appr(s, sf)
    ledger, table = Ledger(s, f"{root}/ledger"), f"{root}/table"
    ledger.append("before", {table: a.where(F.col("close_approach_date") < DROP_AT)})
    after = a.where(F.col("close_approach_date") >= DROP_AT)
    after.write.parquet(f"{table}/run=after/attempt=stopped")
    ledger.append("after", {table: after})
    ledger.append("after", {table: after})
    ledger.compact(table, a.schema, "both")
    return ledger.read(table, a.schema)


register("ledger_append", f"{W(O.APPROACHES)}SELECT * FROM approaches")(_committed_runs)


def _feed_ingest(s, sf):
    """Two drops of landed documents; both tables are returned."""
    root = _scratch(s, "feed")
    a = appr(s, sf)
    paths = f"{root}/landing/*", f"{root}/train", f"{root}/test", f"{root}/ckpt"
    FX.land_feed(a.where(F.col("close_approach_date") < DROP_AT), f"{root}/landing/week=1")
    ST.stream_feed_ingest(s, *paths)
    FX.land_feed(a.where(F.col("close_approach_date") >= DROP_AT), f"{root}/landing/week=2")
    ST.stream_feed_ingest(s, *paths)
    return reduce(DataFrame.unionAll, [s.read.schema(a.schema).parquet(f"{p}/*").withColumn("table", F.lit(t)) for p, t in ((paths[1], "train"), (paths[2], "test"))])


register("stream_feed_ingest", f"{W(O.APPROACHES)}SELECT a.*, t.table FROM approaches a, (VALUES ('train'), ('test')) t(\"table\")")(_feed_ingest)


def _job_ingest_week(s, sf):
    """Two months of landed pages, by windows, appended to both tables."""
    root = _scratch(s, "ingest-week")
    FX.land_feed(appr(s, sf), f"{root}/landing")
    paths = Paths(approaches=f"{root}/train", approaches_copy=f"{root}/test")
    job_ingest_week(s, f"{root}/landing", paths, WEEK_START, WEEK_END)
    return reduce(DataFrame.unionAll, [s.read.parquet(p).withColumn("table", F.lit(t)) for p, t in ((paths.approaches, "train"), (paths.approaches_copy, "test"))])


WEEK_START, WEEK_END = "1995-05-03", "1995-07-01"
register("job_ingest_week", f"{W(O.APPROACHES)}SELECT a.*, t.table FROM approaches a, (VALUES ('train'), ('test')) t(\"table\") "
                            f"WHERE close_approach_date BETWEEN '{WEEK_START}' AND '{WEEK_END}'")(_job_ingest_week)
