"""Structured Streaming jobs: new-id detector (H1, H2, H4) and feed ingest (H3).

New-id detector
---------------
The reference polls ``SELECT DISTINCT id`` every 60 s and announces ids it has not seen, with the
id's newest approach.  Here the fact table's landed files are a stream:

1. optional stream-static ``left_anti`` join against a baseline of known ids (the reference's
   silent first pass);
2. a streaming aggregate by id holds its newest row with the times of the first and the last
   micro-batch that had the id; its partial aggregate is the map-side combine that keeps a hot id
   from sending all its rows of a micro-batch to one task;
3. in update mode a micro-batch gives the ids it has; those whose first and last batch are one are
   new, and their row is the newest of that batch.

State is one row per id ever seen (unbounded, like the reference's id set); use the RocksDB
state store provider on a cluster.  Ids vanishing and coming back cannot happen on an append-only
fact table, so they are never announced twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyrisk.operators.explore import EPOCH, LATEST_COLUMNS, latest_approach
from skyrisk.schemas import FEED, NEW_ASTEROID_EVENT
from skyrisk.session import cut_lineage
from skyrisk.sources.ingest import flatten_feed, path_exists


def stream_new_ids(stream: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """Streaming frame of first sightings: one row per id ever, the newest approach of the
    micro-batch in which it first appears (epoch DESC with NULL epochs first, remaining columns as
    tie-break, NULL first), for update mode."""
    src = stream.select(*LATEST_COLUMNS)
    if baseline is not None:
        src = src.join(baseline.select("id").distinct(), "id", "left_anti").select(*LATEST_COLUMNS)
    order = [EPOCH, *[c for c in LATEST_COLUMNS if c not in ("id", EPOCH)]]
    packed = F.struct(*[x for c in order for x in (F.col(c).isNull().alias(f"_null_{c}"), F.col(c))])
    src = src.withColumn("_time", F.current_timestamp())  # one value for all rows of a micro-batch, also when it is run again
    seen = src.groupBy("id").agg(F.max(packed).alias("_latest"), F.min("_time").alias("_first"), F.max("_time").alias("_last"))
    return seen.where(F.col("_first") == F.col("_last")).select(*[F.col(c) if c == "id" else F.col(f"_latest.{c}").alias(c) for c in LATEST_COLUMNS])


def to_events(df: DataFrame) -> DataFrame:
    """JSON payload {"event": "new_asteroid", "data": {...}} per announced id."""
    data = F.struct(*[F.col(c) for c in df.columns])
    return df.select("id", F.to_json(F.struct(F.lit(NEW_ASTEROID_EVENT).alias("event"), data.alias("data")))
                     .alias("payload"))


def run_available(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet") -> None:
    """Process everything available now, then stop.  Each micro-batch goes to ``batch=<id>`` of ``path`` with overwrite,
    so a batch that is run again replaces its own rows."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").format(fmt).save(f"{path}/batch={batch_id}")

    q = df.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def live_count(stream: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """H4: the running number of ids a stream has shown, a streaming aggregate for complete mode.  The first sighting of
    an id is kept in state, once for each id; with ``baseline`` its ids are not counted."""
    src = stream.select("id").where(F.col("id").isNotNull())
    if baseline is not None:
        src = src.join(baseline.select("id").distinct(), "id", "left_anti")
    return src.dropDuplicates(["id"]).agg(F.count(F.lit(1)).alias("live_count"))


def run_live_count(counts: DataFrame, path: str, checkpoint: str) -> None:
    """Every micro-batch writes the count so far to ``batch=<id>``, a row for each batch.  State and batch ids come
    from the checkpoint, so a batch that is run again writes the same row to the same place."""
    q = (counts.writeStream.outputMode("complete").foreachBatch(lambda batch, i: put_live_count(batch, i, path))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def put_live_count(batch: DataFrame, batch_id: int, path: str) -> None:
    batch.select(F.lit(batch_id).cast("long").alias("batch_id"), "live_count").coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def live_counts(spark: SparkSession, path: str) -> DataFrame:
    """``batch_id, live_count`` of every batch so far."""
    return spark.read.schema("batch_id long, live_count long").parquet(f"{path}/batch=*")


def stream_feed_ingest(spark: SparkSession, in_dir: str, path_a: str, path_b: str, checkpoint: str) -> None:
    """H3: landed feed documents (JSON lines) -> flat rows -> appended to both tables per
    micro-batch.  Each batch is written to its own ``batch=<id>`` folder with overwrite, so a
    retried batch replaces its own output instead of duplicating it."""
    feed = spark.readStream.schema(FEED).json(in_dir)
    rows = flatten_feed(feed)

    def write(batch: DataFrame, batch_id: int) -> None:
        b = batch.persist()
        try:
            for path in (path_a, path_b):
                b.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        finally:
            b.unpersist()

    q = (rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def detect_new_ids_batch(batch: DataFrame, batch_id: int, events_path: str, known_path: str) -> None:
    """One micro-batch of the table-backed detector: newest row per id in the batch (partial
    aggregate, JVM side), anti-joined with the ids announced by earlier batches, written to
    ``batch=<id>`` folders of the event and known-id tables.  A retried batch overwrites its own
    folders and ignores them when reading the known set, so output is exactly once."""
    spark = batch.sparkSession
    newest = latest_approach(batch.select(*LATEST_COLUMNS), LATEST_COLUMNS)
    fresh = newest
    if path_exists(spark, known_path):
        known = spark.read.schema("id long, batch long").parquet(known_path).where(F.col("batch") < F.lit(batch_id)).select("id")
        fresh = newest.join(known, "id", "left_anti")
    fresh = cut_lineage(fresh)  # both tables get the same rows
    fresh.write.mode("overwrite").parquet(f"{events_path}/batch={batch_id}")
    fresh.select("id").write.mode("overwrite").parquet(f"{known_path}/batch={batch_id}")


def run_new_ids_table(stream: DataFrame, events_path: str, known_path: str, checkpoint: str,
                      baseline: DataFrame | None = None) -> None:
    """Table-backed new-id detector (same output as ``stream_new_ids``): the set of announced ids
    is an append-only table instead of state-store entries, so every step stays in the JVM."""
    src = stream.select(*LATEST_COLUMNS)
    if baseline is not None:
        src = src.join(baseline.select("id").distinct(), "id", "left_anti").select(*LATEST_COLUMNS)
    q = (src.writeStream.foreachBatch(lambda b, i: detect_new_ids_batch(b, i, events_path, known_path))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
