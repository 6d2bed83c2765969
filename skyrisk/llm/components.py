"""Connected components of a link table by alternating large and small stars.

Only groupBy-min and equi-joins, so a hub costs one row per link and adaptive execution can split it;
rounds grow with the logarithm of the longest path.  Nothing is collected.  A table of at most
``common.BROADCAST_ROWS`` links (counted) is worked on in one task, without shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyrisk.llm.common import BROADCAST_ROWS, dropped, written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _edges(*pairs: tuple[str, str]) -> F.Column:
    return F.explode(F.array(*(F.struct(F.col(x).alias("u"), F.col(y).alias("v")) for x, y in pairs)))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links to the smallest neighbour; ``edges`` has u > v."""
    both = edges.select(_edges(("u", "v"), ("v", "u")).alias("e")).select("e.*") if large else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    held = both.join(least, "u")
    if large:
        out = held.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = held.select(_edges(("v", "m"), ("u", "m")).alias("e")).select("e.*")
    return out.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, comp``: each node of ``links`` (columns a, b) but the smallest of its component, with that one."""
    spark = links.sparkSession
    edges, path = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = _state(edges)
    while state[0]:
        few = state[0] <= BROADCAST_ROWS
        step, new = written(_star(_star(edges.coalesce(1) if few else edges, True), False), "edges")
        now = _state(step)
        dropped(spark, path)
        edges, path = step, new
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
