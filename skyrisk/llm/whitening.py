"""Whitening of embeddings by their leading principal components.

1. Sums of the scaled integer vectors, then the products of the centred ones, are added up by tasks; a task gives
   one row for each dimension, and rows of a dimension are added in two steps, so that neither a task nor the
   driver gets more than the covariance itself.
2. The covariance is made tridiagonal by Householder reflections.
3. The leading eigenvalues are bracketed by Sturm counts and found by bisection, all at once.
4. Inverse iteration on the tridiagonal matrix gives their vectors; those of close eigenvalues are made orthogonal
   to each other after each step; the reflections carry them back.
5. The components are broadcast (``components`` vectors), and every row is projected in its task.

Steps 2 to 4 are on one matrix of dimension x dimension.

Defined cases: a vector that is null or holds a null or non-finite entry gets no rows and takes no part; of vectors of
several lengths only those of the most frequent length (the longest of equally frequent ones) take part; entries
beyond 2**51 / ``scale`` are held at that bound; a component without variance (copies of one vector, fewer vectors than
dimensions) has no rows, so an empty table gives none; ``deviation`` is null where the exact sum passes 64 bits; rows
with a null or repeated id get rows like any other; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMPONENTS = 8
SCALE = 1024
OFFSET = 100_000
BOUND = 2.0**51
CLUSTER = 1e-3
ADDED = 256
_SEED = 11


def finite_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``id, v`` of the vectors that take part, but for their length."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("v").isNotNull() & ~bad & (F.size("v") > 0))


def scaled(column: pa.Array, scale: int = SCALE, offset: int = OFFSET) -> np.ndarray:
    """Integer vectors of a batch, floor(scale * entry) + offset."""
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return np.clip(np.floor(flat * float(scale)), -BOUND, BOUND).astype(np.int64) + offset


def _added(parts: DataFrame) -> dict[int, np.ndarray]:
    """``part, i, x`` summed over parts, entry by entry, ``ADDED`` parts at a time."""
    def add(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [int(frame["part"].iloc[0]) // ADDED], "i": [int(frame["i"].iloc[0])], "x": [np.sum(np.stack(frame["x"].to_list()), 0)]})

    by = (F.col("part") / ADDED).cast("long").alias("p")
    once = parts.groupBy(by, "i").applyInPandas(add, parts.schema)
    twice = once.groupBy((F.col("part") / ADDED).cast("long").alias("p"), "i").applyInPandas(add, parts.schema)
    out: dict[int, np.ndarray] = {}
    for r in twice.collect():  # a row of the matrix for each ADDED ** 2 tasks
        out[r.i] = out[r.i] + np.array(r.x) if r.i in out else np.array(r.x)
    return out


def _per_task(rows: DataFrame, of_batch: Callable[[np.ndarray], np.ndarray], kind: str, scale: int, offset: int) -> DataFrame:
    """Sums over a task's batches of ``of_batch`` (a matrix), a row for each row of the matrix."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = None, 0
        for batch in batches:
            if batch.num_rows:
                part = batch["part"][0].as_py()
                now = of_batch(scaled(batch["v"], scale, offset))
                total = now if total is None else total + now
        for i, row in enumerate(() if total is None else total):
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([i], pa.int32()), pa.array([row])], ["part", "i", "x"])

    return rows.select("v", F.spark_partition_id().cast("long").alias("part")).mapInArrow(run, f"part long, i int, x array<{kind}>")


# ---------------------------------------------------------------- one symmetric matrix
def householder(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and the unit reflection vectors of a tridiagonal form of symmetric ``a``."""
    a, n, mirrors = a.astype(np.float64).copy(), len(a), []
    for k in range(n - 2):
        x = a[k + 1:, k].copy()
        x[0] += np.copysign(np.linalg.norm(x), x[0])
        size = np.linalg.norm(x)
        u = x / size if size > 0 else x
        mirrors.append(u)
        if size > 0:
            block = a[k + 1:, k + 1:]
            p = 2 * (block @ u)
            p -= (u @ p) * u
            block -= np.outer(u, p) + np.outer(p, u)
            a[k + 1:, k] -= 2 * u * (u @ a[k + 1:, k])
            a[k, k + 1:] = a[k + 1:, k]
    return np.diag(a).copy(), np.diag(a, -1).copy(), mirrors


def carried_back(z: np.ndarray, mirrors: list[np.ndarray]) -> np.ndarray:
    for k in range(len(mirrors) - 1, -1, -1):
        z[k + 1:] -= 2 * np.outer(mirrors[k], mirrors[k] @ z[k + 1:])
    return z


def sturm_counts(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each of ``at``: negative terms of the Sturm sequence."""
    tiny = np.finfo(np.float64).tiny / np.finfo(np.float64).eps
    q = diagonal[0] - at
    below = (q < 0).astype(np.int64)
    for d, e in zip(diagonal[1:], off, strict=True):
        q = np.where(np.abs(q) < tiny, -tiny, q)
        with np.errstate(over="ignore"):  # an infinite term has its sign
            q = d - at - e * e / q
        below += q < 0
    return below


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, by bisection to the last bit that counts."""
    n = len(diagonal)
    reach = np.concatenate([[0.0], np.abs(off)]) + np.concatenate([np.abs(off), [0.0]])
    span = max(np.abs(diagonal).max() + reach.max(), np.finfo(np.float64).tiny)
    low, high = np.full(k, -1.001 * span), np.full(k, 1.001 * span)
    want = n - np.arange(k)  # this many lie below anything above the eigenvalue
    for _ in range(80):
        middle = (low + high) / 2
        above = sturm_counts(diagonal, off, middle) >= want
        high, low = np.where(above, middle, high), np.where(above, low, middle)
    return (low + high) / 2


def _solved(diagonal: np.ndarray, off: np.ndarray, shift: float, b: np.ndarray, tiny: float) -> np.ndarray:
    """x with (T - shift) x = b up to a factor, by elimination with row exchanges."""
    n = len(diagonal)
    d, up, up2, x = (diagonal - shift).tolist(), [*off.tolist(), 0.0], [0.0] * n, b.tolist()
    low = off.tolist()
    for i in range(n - 1):
        if abs(low[i]) > abs(d[i]):
            m = d[i] / low[i]
            d[i], up[i], d[i + 1] = low[i], d[i + 1], up[i] - m * d[i + 1]
            up2[i], up[i + 1] = up[i + 1], -m * up[i + 1]
            x[i], x[i + 1] = x[i + 1], x[i] - m * x[i + 1]
        else:
            d[i] = d[i] if abs(d[i]) > tiny else tiny
            m = low[i] / d[i]
            d[i + 1] -= m * up[i]
            x[i + 1] -= m * x[i]
    for i in range(n - 1, -1, -1):
        d[i] = d[i] if abs(d[i]) > tiny else tiny
        x[i] = (x[i] - (up[i] * x[i + 1] if i + 1 < n else 0.0) - (up2[i] * x[i + 2] if i + 2 < n else 0.0)) / d[i]
        if abs(x[i]) > 1e200:
            x = [v * 1e-200 for v in x]
    return np.array(x)


def inverse_iteration(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray, steps: int = 5) -> np.ndarray:
    """Unit eigenvectors (columns) of falling eigenvalues; within a cluster each is kept orthogonal to those before."""
    n, rng = len(diagonal), np.random.default_rng(_SEED)
    size = float(np.abs(diagonal).max() + (np.abs(off).max() if n > 1 else 0.0))
    eps = np.finfo(np.float64).eps
    out, begin, shift = np.zeros((n, len(values))), 0, np.inf
    for k, value in enumerate(values):
        if k and values[k - 1] - value > CLUSTER * size:
            begin = k
        shift = min(float(value), shift - 10 * eps * size) if k > begin else float(value)
        z = rng.standard_normal(n)
        for _ in range(steps):
            z = _solved(diagonal, off, shift, z / np.linalg.norm(z), eps * size)
            z /= np.abs(z).max()
            for j in range(begin, k):
                z -= (out[:, j] @ z) * out[:, j]
            for j in range(begin, k):  # again, for what rounding left
                z -= (out[:, j] @ z) * out[:, j]
        out[:, k] = z / np.linalg.norm(z)
    return out


def leading_components(v: np.ndarray, k: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues and unit eigenvectors (columns, largest entry positive) of symmetric ``v``; those of no
    variance are left out."""
    k, trace = min(k, len(v)), float(np.trace(v))
    if not len(v) or trace <= 0:
        return np.zeros(0), np.zeros((len(v), 0))
    diagonal, off, mirrors = householder(v)
    values = leading_eigenvalues(diagonal, off, k)
    values = values[values > 8 * len(v) * np.finfo(np.float64).eps * trace]
    vectors = carried_back(inverse_iteration(diagonal, off, values), mirrors)
    vectors /= np.linalg.norm(vectors, axis=0)
    vectors *= np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    return np.einsum("ik,ij,jk->k", vectors, v, vectors), vectors


# ---------------------------------------------------------------- fit and projection
@dataclass
class Whitening:
    n: int
    sums: list[int]  # exact
    values: np.ndarray  # falling eigenvalues
    vectors: np.ndarray  # a column for each component
    trace: float
    scale: int
    offset: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n x - S)^2, exact; None past 64 bits."""
        far = np.abs(x - self.mean).max(initial=0.0) * self.n + 1
        if far * far * x.shape[1] < 2.0**62 and np.abs(x).max(initial=0) * float(self.n) < 2.0**62:
            gap = x * self.n - np.array(self.sums, np.int64)
            return (gap * gap).sum(1).tolist()
        exact = [sum((self.n * a - s) ** 2 for a, s in zip(row, self.sums, strict=True)) for row in x.tolist()]
        return [e if e < 1 << 63 else None for e in exact]


def fit(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET, id_col: str = "vec_id",
        vec_col: str = "embedding") -> tuple[Whitening | None, DataFrame]:
    """The fitted numbers (None without vectors) and the rows ``id, v`` that take part."""
    rows = finite_vectors(vectors, id_col, vec_col)
    size = rows.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    if size is None:
        return None, rows
    rows = rows.where(F.size("v") == size["size"])
    halves = lambda x: np.stack([(x >> 26).sum(0), (x & ((1 << 26) - 1)).sum(0)])  # noqa: E731  exact for 2**36 rows
    high, low = (y for _, y in sorted(_added(_per_task(rows, halves, "long", scale, offset)).items()))
    n, sums = int(size["n"]), [(int(a) << 26) + int(b) for a, b in zip(high, low, strict=True)]
    mean = np.array([s / n for s in sums])
    products = _added(_per_task(rows, lambda x: (x - mean).T @ (x - mean), "double", scale, offset))
    v = np.stack([products[i] for i in range(len(sums))]) / n
    v = (v + v.T) / 2
    values, directions = leading_components(v, components)
    return Whitening(n, sums, values, directions, float(np.trace(v)), scale, offset), rows


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest entry of the whitened rows' covariance minus the identity, measured over all rows."""
    held = rows.sparkSession.sparkContext.broadcast(model)

    def products(x: np.ndarray) -> np.ndarray:
        y = held.value.project(x)
        return y.T @ y  # y is centred, as x is before the projection

    got = _added(_per_task(rows, products, "double", model.scale, model.offset))
    return float(max(np.abs(got[i] / model.n - np.eye(len(got))[i]).max() for i in got))


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET, id_col: str = "vec_id",
           vec_col: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``, a row for each vector and component."""
    model, rows = fit(vectors, components, scale, offset, id_col, vec_col)
    kind = rows.schema["id"].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()),
                           T.StructField("deviation", T.LongType()), T.StructField("whitened", T.DoubleType()),
                           T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType())])
    if model is None or not len(model.values):
        return vectors.sparkSession.createDataFrame([], schema)
    error = identity_error(rows, model)
    held = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        k = len(m.values)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x, rows_in = scaled(part["v"], m.scale, m.offset), part.num_rows
                again = pa.array(np.repeat(np.arange(rows_in), k))
                yield pa.RecordBatch.from_arrays(
                    [part["id"].take(again), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows_in)), pa.array(np.full(rows_in * k, m.n)),
                     pa.array(m.deviations(x), pa.int64()).take(again), pa.array(m.project(x).ravel()),
                     pa.array(np.tile(m.values / m.trace, rows_in)), pa.array(np.full(rows_in * k, error))], schema.names)

    return rows.mapInArrow(run, schema)
