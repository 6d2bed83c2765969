"""Boosted trees by histograms, over all rows, as ``GBTClassifier`` defines them.

Log loss on labels -1 and 1: the first tree fits the labels and counts whole, each later one the loss's negative gradient
and counts by the step.  Leaves are means, a split is the one of most variance gain among up to ``BINS`` - 1 thresholds of each
feature, which are taken from a bounded sample as Spark takes them (here by the rows' keys, so they don't depend on
partitions).  A node without a gain that is enough sends all its rows to the left.

``GBTClassifier`` grows a level of one learner's tree with each job, over its rows as objects.  Here rows are bytes (the number
of each value's bin) in blocks of ``BLOCK_ROWS``, stored once for all fits:

* Of up to ``WHOLE_BYTES`` (a byte for each feature of a row) a fit is one task.
* Of more rows, the fits of all folds grow together: a job for each level, in which a task adds up the histograms of its blocks
  and a node's histograms meet to give its split.  Only splits come to the driver.  After a tree the blocks are written with
  the new margins, and those before are deleted.
"""

from __future__ import annotations

import base64
import io
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, keyword_only
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyrisk.session import stored, unstore

BINS = 32
SAMPLE_ROWS = 10_000
BLOCK_ROWS = 16_384
FILE_BLOCKS = 64  # a reader holds a file's blocks
WHOLE_BYTES = 12_000_000  # a million rows of training
CHUNK_ROWS = 65_536
EVERY = -1  # the fold of a fit on all rows
NO_CUT = BINS  # all bins are less
STATE = "bins binary, sign binary, fold binary, margin binary"


# ---------------------------------------------------------------- trees
@dataclass
class Trees:
    """Complete trees: feature and bin of each inner node, value of each leaf."""
    edges: list[np.ndarray]
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    step: float

    def margins(self, bins: np.ndarray) -> np.ndarray:
        out = np.zeros(bins.shape[1], np.float32)
        for at in range(0, bins.shape[1], CHUNK_ROWS):
            part = bins[:, at:at + CHUNK_ROWS]
            for t in range(len(self.leaf)):
                node = walk(part, self.feature[t], self.cut[t])
                out[at:at + CHUNK_ROWS] += weight(t, self.step) * self.leaf[t][node]
        return out

    def packed(self) -> str:
        """The trees as text, for a stage's parameter."""
        arrays = {"feature": self.feature, "cut": self.cut, "leaf": self.leaf, "step": np.array(self.step)}
        buffer = io.BytesIO()
        np.savez_compressed(buffer, **arrays, **{f"edges{j}": e for j, e in enumerate(self.edges)})
        return base64.b64encode(buffer.getvalue()).decode()


def unpacked(text: str) -> Trees:
    with np.load(io.BytesIO(base64.b64decode(text))) as z:
        edges = [z[f"edges{j}"] for j in range(sum(k.startswith("edges") for k in z.files))]
        return Trees(edges, z["feature"], z["cut"], z["leaf"], float(z["step"]))


def probability(margin: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(np.clip(-2.0 * margin.astype(np.float64), -500, 500)))


def weight(tree: int, step: float) -> float:
    return 1.0 if tree == 0 else step


def residuals(tree: int, sign: np.ndarray, margin: np.ndarray) -> np.ndarray:
    y = sign.astype(np.float32)
    if tree:
        y *= 4 / (1 + np.exp(np.minimum(2 * y * margin, np.float32(80))))
    return y.astype(np.float64)


def walk(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The node that each row reaches below the inner nodes given (whole levels), numbered from 0 within its level."""
    n = bins.shape[1]
    node, rows, first = np.zeros(n, np.int64), np.arange(n), 0
    while first < len(feature):
        node = 2 * node + (bins[feature[first + node], rows] > cut[first + node])
        first = 2 * first + 1
    return node


def thresholds(values: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Spark's candidates of a feature: all midpoints of few values, else about equal shares of the sample."""
    value, count = np.unique(values, return_counts=True)
    middle = (value[:-1] + value[1:]) / 2.0
    if len(middle) <= bins - 1:
        return np.unique(middle)
    stride = len(values) / bins
    until = np.cumsum(count)
    out, target = [], stride
    for i in range(1, len(value)):
        if abs(until[i - 1] - target) < abs(until[i] - target):
            out.append(middle[i - 1])
            target += stride
    return np.unique(np.array(out, np.float64))


def binned_values(columns: Sequence[np.ndarray], edges: Sequence[np.ndarray]) -> np.ndarray:
    """For each feature the number of thresholds below each value; a row goes left of those that are not."""
    for c in columns:
        if np.isnan(c).any():
            raise ValueError("a feature is null or no number")
    return np.stack([np.searchsorted(e, c, side="left").astype(np.uint8) for c, e in zip(columns, edges, strict=True)])


def add_histograms(sums: np.ndarray, counts: np.ndarray, bins: np.ndarray, node: np.ndarray, residual: np.ndarray) -> None:
    """Adds to ``sums`` and ``counts`` (feature, node and bin)."""
    size = sums[0].size
    base = node * BINS
    for at in range(0, len(node), CHUNK_ROWS):
        here = slice(at, at + CHUNK_ROWS)
        for j in range(len(bins)):
            cell = base[here] + bins[j, here]
            sums[j].reshape(-1)[:] += np.bincount(cell, residual[here], size)
            counts[j].reshape(-1)[:] += np.bincount(cell, minlength=size)


def best_splits(sums: np.ndarray, counts: np.ndarray, least: float) -> tuple[np.ndarray, ...]:
    """For each node: feature, bin, sum and rows to the left, sum and rows to the right."""
    left, n_left = np.cumsum(sums, 2), np.cumsum(counts, 2)
    total, n = left[:1, :, -1:], n_left[:1, :, -1:]
    right, n_right = total - left, n - n_left
    with np.errstate(divide="ignore", invalid="ignore"):
        whole = total * total / n
        gain = (left * left / n_left + right * right / n_right - whole) / n
        rounding = 1e-13 * whole / n
    gain[(n_left == 0) | (n_right == 0)] = -np.inf
    flat = gain.transpose(1, 0, 2).reshape(gain.shape[1], -1)
    top = flat.max(1)
    best = (flat >= np.where(np.isfinite(top), top * (1 - 1e-9), top)[:, None]).argmax(1)  # of equal gains the first, however sums were rounded
    node = np.arange(len(best))
    feature, cut = best // BINS, best % BINS
    none = ~((top > np.nan_to_num(rounding[0, :, 0])) & (top >= least))
    to_left = np.where(none, total[0, :, 0], left[feature, node, cut])
    n_to_left = np.where(none, n[0, :, 0], n_left[feature, node, cut])
    return (np.where(none, 0, feature), np.where(none, NO_CUT, cut), to_left, n_to_left, np.where(none, 0.0, right[feature, node, cut]), np.where(none, 0, n_right[feature, node, cut]))


def _means(total: np.ndarray, n: np.ndarray) -> np.ndarray:
    return total / np.maximum(n, 1)


def _leaves(splits: tuple[np.ndarray, ...]) -> np.ndarray:
    _, _, to_left, n_left, to_right, n_right = splits
    return np.stack([_means(to_left, n_left), _means(to_right, n_right)], 1).ravel()


def _as_trees(edges: list[np.ndarray], grown: list[tuple[np.ndarray, np.ndarray, np.ndarray]], step: float) -> Trees:
    feature, cut, leaf = (np.stack(x) for x in zip(*grown, strict=True))
    return Trees(edges, feature.astype(np.int16), cut.astype(np.uint8), leaf, step)


def fit_whole(bins: np.ndarray, sign: np.ndarray, edges: list[np.ndarray], p: dict) -> Trees:
    margin, grown = np.zeros(len(sign), np.float32), []
    for t in range(p["trees"]):
        residual, node = residuals(t, sign, margin), np.zeros(len(sign), np.int64)
        features, cuts = [], []
        for level in range(p["depth"]):
            sums, counts = np.zeros((len(bins), 2**level, BINS)), np.zeros((len(bins), 2**level, BINS), np.int64)
            add_histograms(sums, counts, bins, node, residual)
            splits = best_splits(sums, counts, p.get("gain", 0.0))
            features.append(splits[0])
            cuts.append(splits[1])
            node = 2 * node + (bins[splits[0][node], np.arange(len(node))] > splits[1][node])
        leaf = _leaves(splits)
        margin += weight(t, p["step"]) * leaf[node]
        grown.append((np.concatenate(features), np.concatenate(cuts), leaf))
    return _as_trees(edges, grown, p["step"])


# ---------------------------------------------------------------- the table of blocks
@dataclass
class Block:
    """Rows in the order of their folds."""
    bins: np.ndarray
    sign: np.ndarray
    fold: np.ndarray
    margin: np.ndarray

    @staticmethod
    def each(batches: Iterator[pa.RecordBatch], width: int, fits: int = 0) -> Iterator[Block]:
        for b in batches:
            for row in zip(*(b[c] for c in ("bins", "sign", "fold", "margin")), strict=True):
                bins, sign, fold, margin = (x.as_buffer() for x in row)
                sign = np.frombuffer(sign, np.int8)
                held = np.frombuffer(margin, np.float32).reshape(fits, -1) if margin.size else np.zeros((fits, len(sign)), np.float32)
                yield Block(np.frombuffer(bins, np.uint8).reshape(width, -1), sign, np.frombuffer(fold, np.int16), held)

    @staticmethod
    def of(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Block:
        bins, sign, fold = (np.concatenate(x, axis=-1) for x in zip(*parts, strict=True))
        order = np.argsort(fold, kind="stable")
        return Block(bins[:, order], sign[order], fold[order], np.zeros(0, np.float32))

    def of_fold(self, fold: int) -> slice:
        return slice(*np.searchsorted(self.fold, (fold, fold + 1)).tolist())

    def of_others(self, fold: int) -> list[slice]:
        here = self.of_fold(fold)
        return [x for x in (slice(0, here.start), slice(here.stop, len(self.fold))) if x.stop > x.start] if here.stop > here.start else [slice(0, len(self.fold))]

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({c: pa.array([np.ascontiguousarray(getattr(self, c)).tobytes()], pa.binary()) for c in ("bins", "sign", "fold", "margin")})


@dataclass
class Binned:
    """Rows as bytes, in blocks; of few rows also as arrays that all tasks hold."""
    blocks: DataFrame
    edges: list[np.ndarray]
    rows: int
    whole: Broadcast | None

    def drop(self) -> None:
        unstore(self.blocks)
        if self.whole is not None:
            self.whole.destroy()


def binned(df: DataFrame, feature_cols: Sequence[str], label: str, fold: str, key: str, seed: int) -> Binned:
    """``df`` (read twice) as blocks; ``key`` says which rows are in the sample that gives the thresholds."""
    spark, cols = df.sparkSession, list(feature_cols)
    n = df.count()
    if not n:
        raise ValueError("no rows to fit on")
    share = int(min(1.0, SAMPLE_ROWS / n) * (1 << 30))
    sample = df.where(F.pmod(F.xxhash64(F.col(key), F.lit(seed + 7)), F.lit(1 << 30)) < share).select(*cols).toPandas()  # about SAMPLE_ROWS
    sample = sample if len(sample) else df.select(*cols).limit(SAMPLE_ROWS).toPandas()
    edges = [thresholds(sample[c].to_numpy(np.float64)) for c in cols]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for b in batches:
            for at in range(0, b.num_rows, BLOCK_ROWS):
                part = b.slice(at, BLOCK_ROWS)
                y = part[label].to_numpy(zero_copy_only=False)
                if not np.isin(y, (0.0, 1.0)).all():
                    raise ValueError("a label is neither 0 nor 1")
                bins = binned_values([part[c].to_numpy(zero_copy_only=False).astype(np.float64) for c in cols], edges)
                parts.append((bins, np.where(y > 0, 1, -1).astype(np.int8), part[fold].to_numpy().astype(np.int16)))
                held += part.num_rows
                if held >= BLOCK_ROWS:
                    yield Block.of(parts).batch()
                    parts, held = [], 0
        if parts:
            yield Block.of(parts).batch()

    blocks = stored(df.select(*cols, label, fold, key).mapInArrow(run, STATE), file_rows=FILE_BLOCKS)
    whole = None
    if n * len(cols) <= WHOLE_BYTES:
        table = blocks.toArrow()
        every = [*Block.each(iter(table.to_batches()), len(cols))]
        whole = spark.sparkContext.broadcast(tuple(np.concatenate([getattr(b, c) for b in every], axis=-1) for c in ("bins", "sign", "fold")))
    return Binned(blocks, edges, n, whole)


# ---------------------------------------------------------------- fits
def fit(rows: Binned, p: dict, folds: Sequence[int]) -> list[Trees]:
    """For each of ``folds`` the trees fitted on the rows of all others (``EVERY``: on all rows)."""
    return [t for t, _, _ in _in_tasks(rows, p, folds, False)] if rows.whole is not None else _together(rows, p, list(folds))


def accuracies(rows: Binned, p: dict, folds: Sequence[int]) -> list[float | None]:
    """For each of ``folds`` how many of its rows the trees fitted on the others are right on (None: it has no rows)."""
    if rows.whole is not None:
        return [hit / n if n else None for _, hit, n in _in_tasks(rows, p, folds, True)]
    models, width = _together(rows, p, list(folds)), len(rows.edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hit, n = [0] * len(models), [0] * len(models)
        for block in Block.each(batches, width):
            for i, fold in enumerate(folds):
                on = block.of_fold(fold)
                hit[i] += int(((models[i].margins(block.bins[:, on]) > 0) == (block.sign[on] > 0)).sum())
                n[i] += on.stop - on.start
        yield pa.RecordBatch.from_pydict({"fit": list(range(len(models))), "hit": hit, "n": n})

    got = {r["fit"]: r for r in rows.blocks.mapInArrow(run, "fit long, hit long, n long").groupBy("fit").agg(F.sum("hit").alias("hit"), F.sum("n").alias("n")).collect()}
    return [got[i]["hit"] / got[i]["n"] if got[i]["n"] else None for i in range(len(models))]


def _in_tasks(rows: Binned, p: dict, folds: Sequence[int], count_hits: bool) -> list[tuple[Trees | None, int, int]]:
    """A task for each fold; trees, or hits on the held-out rows and their number."""
    whole, edges = rows.whole, rows.edges
    spark = rows.blocks.sparkSession

    def one(at: int) -> tuple[Trees | None, int, int]:
        bins, sign, fold = whole.value
        learns = fold != folds[at]
        trees = fit_whole(np.ascontiguousarray(bins[:, learns]), sign[learns], edges, p)
        if not count_hits:
            return trees, 0, 0
        out = ~learns
        return None, int(((trees.margins(bins[:, out]) > 0) == (sign[out] > 0)).sum()), int(out.sum())

    return spark.sparkContext.parallelize(range(len(folds)), len(folds)).map(one).collect()


def _together(rows: Binned, p: dict, folds: list[int]) -> list[Trees]:
    state, width, fits = rows.blocks, len(rows.edges), len(folds)
    grown: list[list] = [[] for _ in folds]
    for t in range(p["trees"]):
        inner = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in folds]
        for level in range(p["depth"]):
            splits = _level(state, width, folds, t, inner, level, p.get("gain", 0.0))
            inner = [(np.append(f, s[0]), np.append(c, s[1])) for (f, c), s in zip(inner, splits, strict=True)]
        for i in range(fits):
            grown[i].append((*inner[i], _leaves(splits[i])))
        if t + 1 < p["trees"]:
            after = _grown(state, width, [g[-1] for g in grown], weight(t, p["step"]))
            if t:
                unstore(state)
            state = after
    if state is not rows.blocks:
        unstore(state)
    return [_as_trees(rows.edges, g, p["step"]) for g in grown]


def _level(state: DataFrame, width: int, folds: list[int], t: int, inner: list, level: int, least: float) -> list[tuple[np.ndarray, ...]]:
    """The splits of a level's nodes, for each fit."""
    fits, nodes = len(folds), 2**level

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((fits, width, nodes, BINS)), np.zeros((fits, width, nodes, BINS), np.int64)
        for block in Block.each(batches, width, fits):
            for i, fold in enumerate(folds):
                for on in block.of_others(fold):
                    bins = block.bins[:, on]
                    add_histograms(sums[i], counts[i], bins, walk(bins, *inner[i]), residuals(t, block.sign[on], block.margin[i, on]))
        for i in range(fits):
            some = np.flatnonzero(counts[i, 0].sum(1))
            yield pa.RecordBatch.from_pydict({"fit": pa.array(np.full(len(some), i)), "node": pa.array(some),
                                              "sums": pa.array([sums[i, :, k].tobytes() for k in some.tolist()], pa.binary()),
                                              "counts": pa.array([counts[i, :, k].tobytes() for k in some.tolist()], pa.binary())})

    def split(table: pa.Table) -> pa.Table:
        sums, counts = np.zeros((width, 1, BINS)), np.zeros((width, 1, BINS), np.int64)
        for s, c in zip(table["sums"], table["counts"], strict=True):
            sums[:, 0] += np.frombuffer(s.as_buffer(), np.float64).reshape(width, BINS)
            counts[:, 0] += np.frombuffer(c.as_buffer(), np.int64).reshape(width, BINS)
        found = best_splits(sums, counts, least)
        return pa.table({"fit": table["fit"][:1], "node": table["node"][:1], **{c: pa.array(x) for c, x in zip(_SPLIT, found, strict=True)}})

    kinds = "fit long, node long, " + ", ".join(f"{c} {'double' if c.startswith('to') else 'long'}" for c in _SPLIT)
    tasks = min(fits * nodes, state.sparkSession.sparkContext.defaultParallelism)
    parts = state.mapInArrow(run, "fit long, node long, sums binary, counts binary").repartition(tasks, "fit", "node")
    out = [tuple(np.zeros(nodes, np.float64 if c.startswith("to") else np.int64) for c in _SPLIT) for _ in folds]
    for i in range(fits):
        out[i][1][:] = NO_CUT
    for r in parts.groupBy("fit", "node").applyInArrow(split, kinds).collect():  # a row for each node of the level
        for c, x in zip(_SPLIT, out[r["fit"]], strict=True):
            x[r["node"]] = r[c]
    return out


_SPLIT = ("feature", "cut", "to_left", "n_left", "to_right", "n_right")


def _grown(state: DataFrame, width: int, trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]], counts: float) -> DataFrame:
    """The blocks with the margins of one tree more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in Block.each(batches, width, len(trees)):
            margin = block.margin.copy()
            for i, (feature, cut, leaf) in enumerate(trees):
                margin[i] += counts * leaf[walk(block.bins, feature, cut)]
            yield Block(block.bins, block.sign, block.fold, margin).batch()

    return stored(state.mapInArrow(run, STATE), file_rows=FILE_BLOCKS)


def held_out(rows: Binned, models: Sequence[dict[int, Trees]], cols: Sequence[str], label: str) -> DataFrame:
    """Each row's label and, for each learner (its trees by fold), the probability by the trees that have not seen the row."""
    width = len(rows.edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in Block.each(batches, width):
            out = {label: (block.sign > 0).astype(np.float64)}
            for c, by_fold in zip(cols, models, strict=True):
                margin = np.zeros(len(block.sign), np.float32)
                for fold, trees in by_fold.items():
                    on = block.of_fold(fold)
                    margin[on] = trees.margins(block.bins[:, on])
                out[c] = probability(margin)
            yield pa.RecordBatch.from_pydict(out)

    return rows.blocks.mapInArrow(run, ", ".join(f"{c} double" for c in (label, *cols)))


class BoostedTrees(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Feature columns -> both classes' probabilities, as a vector."""

    trees = Param(Params._dummy(), "trees", "the trees as text", TypeConverters.toString)
    inputCols = Param(Params._dummy(), "inputCols", "the feature columns", TypeConverters.toListString)
    outputCol = Param(Params._dummy(), "outputCol", "the column of probabilities", TypeConverters.toString)

    @keyword_only
    def __init__(self, trees: str = "", inputCols: list[str] | None = None, outputCol: str = "p"):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        trees = unpacked(self.getOrDefault("trees"))

        @F.pandas_udf("double")
        def of_one(*columns: pd.Series) -> pd.Series:
            return pd.Series(probability(trees.margins(binned_values([c.to_numpy(np.float64) for c in columns], trees.edges))))

        p = of_one(*[F.col(c).cast("double") for c in self.getOrDefault("inputCols")])
        return dataset.withColumn(self.getOrDefault("outputCol"), array_to_vector(F.array(F.lit(1.0) - p, p)))
