"""Sharding by extendible hashing: a directory over the leading bits of a hash; only a bucket over the
byte limit splits, on its next bit, until every shard fits.

The hash is the first 60 bits of ``md5(id)``, so neighbouring ids and a hot source spread evenly.  A
shard is named by the bits all its members share (``""`` is the whole table).

How it runs: one pass sums bytes by the leading ``d`` bits (with map-side sums; ``d`` from the total and
the limit, so about 16 cells a shard), the sums are rolled up level by level over cells alone, and the
shallowest prefix that fits is the leaf of all cells below it.  Cells of ``d`` bits that don't fit go on
alone with more bits, and only their rows are read again.  The directory stays a table and is joined to
the rows by cell, never collected.

Defined cases: null and empty texts have 0 bytes; rows with one id (or with a null id, hashed as '')
share a hash and can't be parted: such a unit over the limit, a single huge document above all, is a shard of
its own with ``oversized`` true; an empty table has no shards; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyrisk.llm.common import written

LIMIT_BYTES = 1 << 20
HASH_BITS = 60
MORE_BITS = 10


def hash_bits(col) -> F.Column:
    """The first 60 bits of md5 as a text of 0 and 1."""
    number = F.conv(F.substring(F.md5(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), 1, HASH_BITS // 4), 16, 2)
    return F.lpad(number, HASH_BITS, "0")


def _cells(units: DataFrame, depth: int) -> DataFrame:
    return units.groupBy(F.substring("bits", 1, depth).alias("cell")).agg(F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n_docs"))


def directory(units: DataFrame, limit: int, total: int) -> DataFrame:
    """``cell, shard, depth``: the leaf that each cell (a prefix of at least the leaf's bits) belongs to."""
    depth = min(HASH_BITS, max(4, (16 * total // max(1, limit)).bit_length()))
    start, found, left = 0, None, units
    while True:
        cells, _ = written(_cells(left, depth), "cells")
        levels = cells.select("cell", "n_bytes", F.explode(F.sequence(F.lit(start), F.lit(depth))).alias("depth"))
        sums = levels.groupBy("depth", F.expr("substring(cell, 1, depth)").alias("shard")).agg(F.sum("n_bytes").alias("n_bytes"))
        fits = sums.where((F.col("n_bytes") <= limit) | (F.col("depth") == HASH_BITS))
        ways = cells.select("cell", F.explode(F.sequence(F.lit(start), F.lit(depth))).alias("depth")).withColumn("shard", F.expr("substring(cell, 1, depth)"))
        leaf, _ = written(ways.join(fits.select("depth", "shard"), ["depth", "shard"]).groupBy("cell").agg(F.min("depth").alias("depth")), "directory")
        found = leaf if found is None else found.unionAll(leaf)
        over = cells.where(F.col("n_bytes") > limit).select("cell")
        if depth == HASH_BITS or over.isEmpty():
            return found
        left, _ = written(left.withColumn("cell", F.substring("bits", 1, depth)).join(over, "cell", "left_semi").drop("cell"), "oversized")
        start, depth = depth + 1, min(HASH_BITS, depth + MORE_BITS)


def assign_shards(docs: DataFrame, limit: int = LIMIT_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, shard, depth, n_bytes, shard_bytes, shard_docs, oversized``: one row per document."""
    units, _ = written(docs.select(F.col(id_col).alias("doc_id"), hash_bits(F.col(id_col)).alias("bits"),
                                   F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long").alias("n_bytes")), "units")
    total = units.agg(F.sum("n_bytes")).first()[0] or 0
    cells = directory(units, limit, total)
    depths = [r[0] for r in cells.select(F.length("cell")).distinct().collect()]  # one for each round of splits
    placed = None
    for d in sorted(depths):
        own = (units.withColumn("cell", F.substring("bits", 1, d))
               .join(cells.where(F.length("cell") == d), "cell").select("doc_id", F.expr("substring(bits, 1, depth)").alias("shard"), "depth", "n_bytes"))
        placed = own if placed is None else placed.unionAll(own)
    if placed is None:
        placed = units.select("doc_id", F.lit("").alias("shard"), F.lit(0).alias("depth"), "n_bytes")
    sums = placed.groupBy("shard").agg(F.sum("n_bytes").alias("shard_bytes"), F.count("*").alias("shard_docs"))
    return (placed.join(sums, "shard")
            .select("doc_id", "shard", "depth", "n_bytes", "shard_bytes", "shard_docs", (F.col("shard_bytes") > limit).alias("oversized")))


def folder_column(docs: DataFrame) -> str:
    """``shard``, or the first of ``shard_1``, ``shard_2`` ... that ``docs`` has no column of (names compare without case)."""
    taken = {c.lower() for c in docs.columns}
    return next(c for c in ("shard", *(f"shard_{k}" for k in range(1, len(taken) + 2))) if c not in taken)


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT_BYTES, id_col: str = "doc_id", text_col: str = "text") -> None:
    """All columns of ``docs`` as Parquet with a folder per shard, named by :func:`folder_column`; shards are small by the
    limit, so one task writes one shard."""
    name = folder_column(docs)
    own = assign_shards(docs, limit, id_col, text_col).select(F.col("doc_id").alias("__id"), F.concat(F.lit("b"), "shard").alias(name)).distinct()
    named = docs.join(own, docs[id_col].eqNullSafe(own["__id"])).drop("__id")
    named.repartition(name).sortWithinPartitions(name).write.partitionBy(name).parquet(path)


def oracle(limit: int = LIMIT_BYTES) -> str:
    return f"""
WITH units AS (
  SELECT doc_id, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h,
         coalesce(strlen(text), 0)::BIGINT AS n_bytes FROM documents),
named AS (SELECT doc_id, n_bytes, lpad(bin(h), 60, '0') AS bits FROM units),
ways AS (SELECT doc_id, n_bytes, d AS depth, substr(bits, 1, d) AS shard FROM named, (SELECT unnest(range(0, 61))::INT AS d)),
sums AS (SELECT depth, shard, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_docs FROM ways GROUP BY ALL),
leaf AS (SELECT w.*, s.shard_bytes, s.shard_docs, row_number() OVER (PARTITION BY doc_id ORDER BY w.depth) AS k
         FROM ways w JOIN sums s USING (depth, shard) WHERE s.shard_bytes <= {limit} OR depth = 60)
SELECT doc_id, shard, depth, n_bytes, shard_bytes, shard_docs, shard_bytes > {limit} AS oversized FROM leaf WHERE k = 1"""
