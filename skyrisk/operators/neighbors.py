"""Exact nearest neighbours by cells with bounding boxes.

1. A tree of median splits, from a bounded sample (it decides balance only, never results), deals the points into
   cells of up to about ``CELL_ROWS``; each cell's tight bounding box is measured over all its points.  The cell of a row is
   worked out anew in each pass, as that costs less than a stored copy of all rows, so the rows given must be the same
   each time they are read.
2. A task gets one cell, makes equal points one, cuts the cell further into leaves with boxes of their own, and answers
   the cell's points there.  Of a point with many copies only the ``k`` + 1 smallest keys go into a cell that would be large;
   the other copies have the first ``k`` of these as neighbours.
3. A point whose k-th distance so far reaches the box of another cell visits it; all others are done.  Cells with many
   visitors are dealt out over several tasks.
4. The answers of the visitors are merged.

Distances are added up in the order of the columns, as the distances to boxes are, so rounding never makes a box
look farther than a point in it.  Equal distances are ordered by key.  Points with a null or non-finite coordinate
have no neighbours and are nobody's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from skyrisk.session import cut_lineage, stored, working

CELL_ROWS = 50_000
LEAST_CELL_ROWS = 2_000
SAMPLE_ROWS = 40_000
VISIT_ROWS = 100_000
LEAF_ROWS = 96
QUERY_ROWS = 128
LARGE_CELL = 4  # times the rows meant for a cell; beyond, copies of a point are left out of it


# ---------------------------------------------------------------- the tree over cells
@dataclass
class CellTree:
    """Median splits; node i splits ``dim[i]`` at ``cut[i]`` (left takes equal values), negative children are cells."""
    dim: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    cells: int
    low: np.ndarray | None = None  # boxes of the cells
    high: np.ndarray | None = None

    def cell_of(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64) if len(self.dim) else np.full(len(x), -1)
        while (at >= 0).any():
            here = np.flatnonzero(at >= 0)
            node = at[here]
            goes_left = x[here, self.dim[node]] <= self.cut[node]
            at[here] = np.where(goes_left, self.left[node], self.right[node])
        return -1 - at

    def with_boxes(self, low: np.ndarray, high: np.ndarray) -> CellTree:
        """Boxes of all nodes, from those of the cells (an empty cell has an empty box)."""
        node_low, node_high = np.full((len(self.dim), low.shape[1]), np.inf), np.full((len(self.dim), low.shape[1]), -np.inf)
        for i in range(len(self.dim) - 1, -1, -1):
            for child in (self.left[i], self.right[i]):
                lo, hi = (node_low[child], node_high[child]) if child >= 0 else (low[-1 - child], high[-1 - child])
                node_low[i], node_high[i] = np.minimum(node_low[i], lo), np.maximum(node_high[i], hi)
        return CellTree(self.dim, self.cut, self.left, self.right, self.cells, np.vstack([node_low, low]), np.vstack([node_high, high]))

    def visits(self, x: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) for every cell whose box is not farther from the row than ``bound``."""
        rows, cells = [], []
        todo = [(0 if len(self.dim) else -1, np.arange(len(x)))]
        while todo:
            node, here = todo.pop()
            box = node if node >= 0 else len(self.dim) - 1 - node
            here = here[box_distance(x[here], self.low[box], self.high[box]) <= bound[here]]
            if not len(here):
                continue
            if node >= 0:
                todo += [(self.left[node], here), (self.right[node], here)]
            else:
                rows.append(here)
                cells.append(np.full(len(here), -1 - node))
        empty = np.zeros(0, np.int64)
        return np.concatenate([empty, *rows]), np.concatenate([empty, *cells])


def box_distance(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each row to a box (or, with boxes as rows and one more axis, to each of them)."""
    total = np.zeros(np.broadcast_shapes(x.shape[:-1], low.shape[:-1]))
    for j in range(x.shape[-1]):
        gap = np.maximum(np.maximum(low[..., j] - x[..., j], x[..., j] - high[..., j]), 0.0)
        total += gap * gap
    return total


def split_cells(sample: np.ndarray, cells: int) -> CellTree:
    """A tree of about ``cells`` cells with equal shares of the sample."""
    dim: list[int] = []
    cut: list[float] = []
    left: list[int] = []
    right: list[int] = []
    found = 0
    todo = [(np.arange(len(sample)), cells, -1, False)]
    while todo:
        here, want, parent, is_left = todo.pop()
        x = sample[here]
        spread = x.max(0) - x.min(0) if len(x) else np.zeros(sample.shape[1])
        split = None
        if want > 1 and len(x) > 1 and spread.max() > 0:
            j = int(spread.argmax())
            at = np.sort(x[:, j])[(len(x) - 1) // 2]
            if at == x[:, j].max():  # the upper half is one value
                at = x[x[:, j] < at, j].max()
            split = (j, at)
        if split is None:
            found, me = found + 1, -1 - found
        else:
            me = len(dim)
            dim.append(split[0])
            cut.append(split[1])
            left.append(0)
            right.append(0)
            goes_left = x[:, split[0]] <= split[1]
            todo += [(here[~goes_left], want - want // 2, me, False), (here[goes_left], want // 2, me, True)]
        if parent >= 0:
            (left if is_left else right)[parent] = me
    return CellTree(np.array(dim, np.int64), np.array(cut, np.float64), np.array(left, np.int64), np.array(right, np.int64), found)


# ---------------------------------------------------------------- the search in one cell
class Leaves:
    """Distinct points of a cell, in leaves of ``LEAF_ROWS`` with their boxes."""

    def __init__(self, x: np.ndarray):
        self.x, self.parts = x, []
        dim, cut, left, right = [], [], [], []
        todo = [(np.arange(len(x)), -1, False)]
        while todo:
            here, parent, is_left = todo.pop()
            p = x[here]
            if len(here) <= LEAF_ROWS:
                self.parts.append(np.sort(here))
                me = -len(self.parts)
            else:
                j, half, me = int((p.max(0) - p.min(0)).argmax()), len(here) // 2, len(dim)
                order = np.argpartition(p[:, j], half)
                dim.append(j)
                cut.append(p[order[half], j])
                left.append(0)
                right.append(0)
                todo += [(here[order[:half]], me, True), (here[order[half:]], me, False)]
            if parent >= 0:
                (left if is_left else right)[parent] = me
        self.tree = CellTree(np.array(dim, np.int64), np.array(cut, np.float64), np.array(left, np.int64), np.array(right, np.int64), len(self.parts))
        self.low, self.high = np.stack([x[p].min(0) for p in self.parts]), np.stack([x[p].max(0) for p in self.parts])

    def nearest(self, q: np.ndarray, k: int, bound: np.ndarray, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, point, squared distance) of the k nearest points of each query within ``bound``, by distance and
        point number; ``own`` are points to leave out."""
        out = []
        if own is not None:  # queries that lie together are searched together
            home = np.empty(len(self.x), np.int64)
            for leaf, part in enumerate(self.parts):
                home[part] = leaf
            home = home[own]
        else:
            home = self.tree.cell_of(q)
        order = np.argsort(home, kind="stable")
        for at in range(0, len(order), QUERY_ROWS):
            rows = order[at:at + QUERY_ROWS]
            found = self._search(q[rows], k, bound[rows], home[rows], None if own is None else own[rows])
            out.append((rows[found[0]], found[1], found[2]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def _search(self, q: np.ndarray, k: int, bound: np.ndarray, home: np.ndarray, own: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        worst = bound.astype(np.float64).copy()
        open_ones = np.isinf(worst)
        for leaf in np.unique(home[open_ones]).tolist():  # a first bound from the leaf they lie in
            on = np.flatnonzero((home == leaf) & open_ones)
            row, _, d = self._within(q[on], self.parts[leaf], np.full(len(on), np.inf), None if own is None else own[on])
            order = np.lexsort((d, row))
            row, d = row[order], d[order]
            kth = np.arange(len(row)) - np.searchsorted(row, row) == k - 1
            worst[on[row[kth]]] = np.minimum(worst[on[row[kth]]], d[kth])
        # leaves near the box of all these queries, then those near one of them
        gap = np.maximum(np.maximum(self.low - q.max(0), q.min(0) - self.high), 0.0)
        apart = np.zeros(len(self.low))
        for j in range(q.shape[1]):
            apart += gap[:, j] * gap[:, j]
        near = np.flatnonzero(apart <= worst.max())
        near = near[(box_distance(q[:, None], self.low[near], self.high[near]) <= worst[:, None]).any(0)]
        if not len(near):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        r, p, d = self._within(q, np.concatenate([self.parts[leaf] for leaf in near.tolist()]), worst, own)
        order = np.lexsort((p, d, r))
        r, p, d = r[order], p[order], d[order]
        first = np.arange(len(r)) - np.searchsorted(r, r) < k
        return r[first], p[first], d[first]

    def _within(self, q: np.ndarray, points: np.ndarray, worst: np.ndarray, own: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, point, squared distance) of all pairs within ``worst``: a matrix product finds what may be, with room
        for its rounding, and the distances of these are added up column by column."""
        y = self.x[points]
        x_norm, y_norm = (q * q).sum(1), (y * y).sum(1)
        about = q @ y.T
        about *= -2
        about += x_norm[:, None]
        about += y_norm
        room = 1e-12 * (x_norm + y_norm.max(initial=0.0)) + 1e-300
        row, col = np.nonzero(about <= (worst + room)[:, None])
        if own is not None:
            other = points[col] != own[row]
            row, col = row[other], col[other]
        d = np.zeros(len(row))
        for j in range(q.shape[1]):
            gap = q[row, j] - y[col, j]
            d += gap * gap
        fits = d <= worst[row]
        return row[fits], points[col[fits]], d[fits]


class Points:
    """The rows of a cell in the order of their keys, equal ones as one point, numbered by their smallest keys."""

    def __init__(self, rows: pa.Table, cols: Sequence[str]):
        self.rows = rows.take(pc.sort_indices(rows["vid"])).combine_chunks()
        self.x = x = coordinates(self.rows, cols)
        bits = x.view(np.uint64)
        mixed = np.zeros(len(x), np.uint64)
        for j in range(x.shape[1]):
            mixed = (mixed ^ bits[:, j]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        _, first, point = np.unique(mixed, return_index=True, return_inverse=True)
        if (x[first[point]] != x).any():  # two points of one hash
            _, first, point = np.unique(x, axis=0, return_index=True, return_inverse=True)
        by_key = np.argsort(first)
        place = np.empty(len(first), np.int64)
        place[by_key] = np.arange(len(first))
        self.first, self.point = first[by_key], place[point.ravel()]
        self.members = np.argsort(self.point, kind="stable")  # rows of each point, in the order of keys
        self.copies = np.bincount(self.point, minlength=len(first))
        self.start = np.cumsum(self.copies) - self.copies
        self.distinct = x[self.first]

    def spread(self, query: np.ndarray, point: np.ndarray, d2: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, squared distance), a point standing for its first ``k`` rows, by query, distance and key."""
        many = np.minimum(self.copies[point], k)
        at = np.repeat(np.arange(len(point)), many)
        row = self.members[self.start[point[at]] + np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)]
        query, d2 = query[at], d2[at]
        order = np.lexsort((row, d2, query))
        return query[order], row[order], d2[order]


def coordinates(rows: pa.Table, cols: Sequence[str]) -> np.ndarray:
    return np.stack([rows[c].to_numpy() for c in cols], 1).astype(np.float64) if rows.num_rows else np.zeros((0, len(cols)))


def _first(query: np.ndarray, k: int) -> np.ndarray:
    return np.arange(len(query)) - np.searchsorted(query, query) < k


def _lists(points: Points, query: np.ndarray, row: np.ndarray, d2: np.ndarray, n: int) -> dict[str, pa.Array]:
    """The neighbours of queries 0 to n - 1 as lists; ``query`` ascends."""
    ends = pa.array(np.searchsorted(query, np.arange(n + 1)), pa.int32())
    tag = points.rows["tag"].combine_chunks().take(pa.array(row))
    key = points.rows["vid"].combine_chunks().take(pa.array(row))
    return {name: pa.ListArray.from_arrays(ends, values) for name, values in (("d2", pa.array(d2)), ("c", key), ("ctag", tag))}


# ---------------------------------------------------------------- the jobs
def _cells(points: DataFrame, cols: list[str], tree: CellTree) -> DataFrame:
    held = points.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column("cell", pa.array(held.value.cell_of(coordinates(b, cols)), pa.int64()))

    return points.mapInArrow(run, T.StructType([*points.schema.fields, T.StructField("cell", T.LongType())]))


def _own_cell(cols: list[str], k: int, held) -> Callable:
    def run(rows: pa.Table) -> pa.Table:
        points, cell = Points(rows, cols), rows["cell"][0].as_py()
        asking = np.flatnonzero(points.rows["asks"].to_numpy(zero_copy_only=False).astype(bool))
        n = len(asking)
        own, mine = np.unique(points.point[asking], return_inverse=True)  # the points of rows that ask
        none = np.zeros(0, np.int64)
        query, point, d2 = Leaves(points.distinct).nearest(points.distinct[own], k, np.full(len(own), np.inf), own) if n else (none, none, np.zeros(0))
        # a point's own copies are its neighbours too; each row then leaves itself out
        each_own = np.arange(len(own))
        query, row, d2 = points.spread(np.concatenate([each_own, query]), np.concatenate([own, point]), np.concatenate([np.zeros(len(own)), d2]), k + 1)
        some = _first(query, k + 1)
        query, row, d2 = query[some], row[some], d2[some]
        begin = np.searchsorted(query, each_own)
        many = np.searchsorted(query, each_own, side="right") - begin
        each = many[mine]
        of = np.repeat(np.arange(n), each)
        at = begin[mine[of]] + np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each)
        other = row[at] != asking[of]
        of, at = of[other], at[other]
        fits = _first(of, k)
        of, at = of[fits], at[fits]
        found = np.bincount(of, minlength=n)
        bound = np.full(n, np.inf)
        if len(of):
            full = found == k
            bound[full] = d2[at[np.cumsum(found)[full] - 1]]
        x = points.x[asking]
        visitor, visited = held.value.visits(x, bound)
        away = visited != cell
        visitor, visited = visitor[away], visited[away]
        order = np.argsort(visitor, kind="stable")
        visitor, visited = visitor[order], visited[order]
        ends = np.searchsorted(visitor, np.arange(n + 1))
        stays = ends[1:] == ends[:-1]
        who = points.rows.take(pa.array(asking))
        columns = {"vid": who["vid"], "tag": who["tag"], **_lists(points, of, row[at], d2[at], n), "bound": pa.array(bound),
                   "cells": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(visited, pa.int64()))}
        return pa.table(columns | {c: pa.array(x[:, j], mask=stays) for j, c in enumerate(cols)})  # only visitors are seen again

    return run


def _other_cell(cols: list[str], k: int, kind: pa.DataType) -> Callable:
    def run(visits: pa.Table, rows: pa.Table) -> pa.Table:
        n = visits.num_rows
        if not n or not rows.num_rows:
            return pa.table({"vid": pa.array([], pa.string()), "d2": pa.array([], pa.list_(pa.float64())), "c": pa.array([], pa.list_(pa.string())), "ctag": pa.array([], pa.list_(kind))})
        points = Points(rows, cols)
        found = Leaves(points.distinct).nearest(coordinates(visits, cols), k, visits["bound"].to_numpy())
        query, row, d2 = points.spread(*found, k)
        fits = _first(query, k)
        out = pa.table({"vid": visits["vid"], **_lists(points, query[fits], row[fits], d2[fits], n)})
        return out.filter(pc.greater(pc.list_value_length(out["c"]), 0))

    return run


def cell_rows(n: int, spark) -> int:
    """Rows of a cell: some cells for each core, within the bounds of a task's memory."""
    return int(min(CELL_ROWS, max(LEAST_CELL_ROWS, n // (4 * spark.sparkContext.defaultParallelism))))


def _few_copies(placed: DataFrame, cols: list[str], k: int, large: list[int]) -> tuple[DataFrame, DataFrame | None]:
    """``placed`` with the ``k`` + 1 smallest keys of each point in the cells ``large``, and the keys of points that have more."""
    if not large:
        return placed, None
    inside = F.col("cell").isin(large)
    rank = F.row_number().over(Window.partitionBy(*cols).orderBy("vid"))  # each task keeps its first keys before the shuffle
    few = stored(placed.where(inside).withColumn("_rank", rank).where(F.col("_rank") <= k + 1).drop("_rank"))
    full = few.groupBy(*cols).agg(F.array_sort(F.collect_list(F.struct("vid", "tag"))).alias("_keys")).where(F.size("_keys") == k + 1)
    return placed.where(~inside).unionByName(few), full


def cell_visits(points: DataFrame, k: int, cols: list[str], wanted: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(points with their cell, their answers in it with the ``cells`` they still visit, these visits).  Answers that are
    not ``wanted`` may be left out if they are final."""
    placed, _, own, visits, _ = _answered(points, k, cols, wanted)
    return placed, own, visits


def _answered(points: DataFrame, k: int, cols: list[str], wanted: Column | None, asks: Column | None = None):
    """(points with their cell, the points that have more copies than a cell takes, answers, visits, tree over the cells)."""
    spark = points.sparkSession
    tag = "tag" if "tag" in points.columns else F.lit(None).cast("double").alias("tag")
    rows = points.select("vid", tag, *cols)
    n = rows.count()
    sample = rows.select(*cols).sample(min(1.0, SAMPLE_ROWS / 2 / max(1, n)), seed=7).toPandas().to_numpy(np.float64)  # about half of SAMPLE_ROWS at most
    tree = split_cells(np.unique(sample.reshape(-1, len(cols)), axis=0), max(1, -(-n // cell_rows(n, spark))))
    placed = _cells(rows, cols, tree)
    sides = [F.min(c).alias(f"lo{j}") for j, c in enumerate(cols)] + [F.max(c).alias(f"hi{j}") for j, c in enumerate(cols)]
    low, high = np.full((tree.cells, len(cols)), np.inf), np.full((tree.cells, len(cols)), -np.inf)
    large = []
    for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *sides).collect():  # a row for each cell
        low[r["cell"]] = [r[f"lo{j}"] for j in range(len(cols))]
        high[r["cell"]] = [r[f"hi{j}"] for j in range(len(cols))]
        large += [r["cell"]] if r["n"] > LARGE_CELL * CELL_ROWS else []
    held = spark.sparkContext.broadcast(tree.with_boxes(low, high))
    placed, full = _few_copies(placed, cols, k, large)
    kind = rows.schema["tag"].dataType.simpleString()
    kinds = ", ".join(f"`{c}` double" for c in cols)
    asked = placed.withColumn("asks", F.lit(True) if asks is None else F.coalesce(asks, F.lit(False)))
    own = asked.repartition(max(tree.cells, 1), "cell").groupBy("cell").applyInArrow(
        _own_cell(cols, k, held), f"vid string, tag {kind}, d2 array<double>, c array<string>, ctag array<{kind}>, bound double, cells array<bigint>, {kinds}")
    own = stored(own if wanted is None else own.where((F.size("cells") > 0) | wanted))
    return placed, full, own, own.select("vid", "bound", *cols, F.explode("cells").alias("cell")), held


def _visited(visits: DataFrame, placed: DataFrame, cols: list[str], k: int) -> DataFrame:
    """The answers of the cells that are visited."""
    # a cell with many visitors is answered by several tasks
    tasks = cut_lineage(visits.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / VISIT_ROWS).cast("long").alias("tasks")))  # a row for each cell
    some = visits.join(F.broadcast(tasks), "cell").select(visits["*"], F.pmod(F.xxhash64("vid"), F.col("tasks")).alias("task"))
    again = placed.join(F.broadcast(tasks), "cell").select(placed["*"], F.explode(F.sequence(F.lit(0).cast("long"), F.col("tasks") - 1)).alias("task"))
    kind = placed.schema["tag"].dataType
    return some.groupBy("cell", "task").cogroup(again.groupBy("cell", "task")).applyInArrow(
        _other_cell(cols, k, to_arrow_type(kind)), f"vid string, d2 array<double>, c array<string>, ctag array<{kind.simpleString()}>")


def _base(points: DataFrame, feature_cols: Sequence[str], id_col: str, tag_col: str | None) -> tuple[DataFrame, list[str]]:
    """``vid``, ``tag`` and the coordinates of the points that have neighbours, and the coordinates' names."""
    cols = [f"_x{j}" for j in range(len(feature_cols))]
    tag = F.col(tag_col) if tag_col else F.lit(None).cast("double")
    base = points.select(F.col(id_col).alias("vid"), tag.alias("tag"), *[(F.col(c).cast("double") + 0.0).alias(x) for c, x in zip(feature_cols, cols, strict=True)])
    for c in cols:
        base = base.where(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return base, cols


def neighbor_lists(points: DataFrame, k: int, feature_cols: Sequence[str], id_col: str = "row_key", tag_col: str | None = None,
                   wanted: Column | None = None) -> DataFrame:
    """``vid``, ``tag`` (the column ``tag_col``) and ``pairs`` of every point: its k nearest other points as structs of
    ``d2``, ``c`` and ``ctag``, by distance and key.  ``wanted`` (of ``tag``, ``c``, ``ctag``, ``d2``) says which answers
    have to be there.  Keys are unique; see ``ml.unique_rows``."""
    base, cols = _base(points, feature_cols, id_col, tag_col)
    return _merged(base, k, cols, *_answered(base, k, cols, wanted)[:4])


def _merged(base: DataFrame, k: int, cols: list[str], placed: DataFrame, full: DataFrame | None, own: DataFrame, visits: DataFrame, asks: Column | None = None) -> DataFrame:
    other, kind = _visited(visits, placed, cols, k), base.schema["tag"].dataType
    pairs = F.arrays_zip("d2", "c", "ctag").alias("pairs")
    visitors = own.where(F.size("cells") > 0).select("vid", "tag", pairs).unionByName(other.select("vid", F.lit(None).cast(kind).alias("tag"), pairs))
    merged = visitors.groupBy("vid").agg(F.max("tag").alias("tag"), F.slice(F.array_sort(F.flatten(F.collect_list("pairs"))), 1, k).alias("pairs"))
    out = own.where(F.size("cells") == 0).select("vid", "tag", pairs).unionByName(merged)
    if full is None:
        return out
    some = base if asks is None else base.where(asks)
    copies = some.join(full, cols).where(F.col("vid") > F.col("_keys")[k]["vid"]).select("vid", "tag", F.transform(
        F.slice("_keys", 1, k), lambda x: F.struct(F.lit(0.0).alias("d2"), x["vid"].alias("c"), x["tag"].alias("ctag"))).alias("pairs"))
    return out.unionByName(copies)


def knn(points: DataFrame, k: int, feature_cols: Sequence[str], id_col: str = "row_key") -> DataFrame:
    """The k nearest other points (squared Euclidean distance, ties by key) of every point: rows
    (``q``, ``c``, ``d2``, ``nn_rank`` from 1).  Keys are unique; see ``ml.unique_rows``."""
    return neighbor_lists(points, k, feature_cols, id_col).select(F.col("vid").alias("q"), F.posexplode("pairs").alias("at", "x")).select(
        "q", F.col("x.c").alias("c"), F.col("x.d2").alias("d2"), (F.col("at") + 1).alias("nn_rank"))


def tomek_links(df: DataFrame, feature_cols: Sequence[str], id_col: str = "row_key", label_col: str = "label") -> DataFrame:
    """Keys of both members of every Tomek link: mutual nearest neighbours with different labels.  A link has at least one
    member whose label is not the most frequent one, so only these rows ask for their nearest one.  Of the rows of the most
    frequent label only those that are such a nearest one are looked at: whether a point is nearer than the row that asked."""
    spark = df.sparkSession
    base, cols = _base(df, feature_cols, id_col, label_col)
    most = base.where(F.col("tag").isNotNull()).groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tag").first()
    if most is None:
        return df.select(id_col).limit(0)
    rare = F.col("tag") != F.lit(most["tag"])
    with working(spark):
        placed, full, own, visits, held = _answered(base, 1, cols, F.col("tag") != F.get("ctag", F.lit(0)), rare)
        lists = _merged(base, 1, cols, placed, full, own, visits, rare).select("vid", "tag", F.get("pairs", F.lit(0)).alias("x"))
        asked = stored(lists.where(F.col("tag") != F.col("x.ctag")).select(F.col("vid").alias("q"), F.col("x.c").alias("c"), F.col("x.d2").alias("d2"), F.col("x.ctag").alias("ctag")))
        # of the rows that ask for a row of the most frequent label, the nearest one
        first = asked.where(F.col("ctag") == F.lit(most["tag"])).groupBy("c").agg(F.min(F.struct("d2", "q")).alias("x")).select(F.col("c").alias("vid"), F.col("x.d2").alias("bound"), F.col("x.q").alias("q"))
        first = stored(base.where(~rare).join(first, "vid").select("vid", "bound", "q", *cols))
        there = _visited(stored(_within_bound(first.drop("q"), cols, held)), placed, cols, 2)  # a row finds itself or a copy, and its nearest one
        near = there.select("vid", F.explode(F.arrays_zip("d2", "c")).alias("x")).where(F.col("x.c") != F.col("vid")).groupBy("vid").agg(F.min("x").alias("x"))
        back = near.select(F.col("vid").alias("q"), F.col("x.c").alias("c")).unionByName(asked.where(F.col("ctag") != F.lit(most["tag"])).select("q", "c"))
        linked = asked.select("q", "c").join(back.select(F.col("c").alias("q"), F.col("q").alias("c")), ["q", "c"])
        return stored(linked.select(F.explode(F.array("q", "c")).alias(id_col)).distinct(), result=True)


def _within_bound(points: DataFrame, cols: list[str], held) -> DataFrame:
    """``points`` with each ``cell`` whose box is not farther than their ``bound``, their own one too."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, cell = held.value.visits(coordinates(b, cols), b["bound"].to_numpy())
            yield b.take(pa.array(row)).append_column("cell", pa.array(cell, pa.int64()))

    return points.mapInArrow(run, T.StructType([*points.schema.fields, T.StructField("cell", T.LongType())]))
