"""Substring dedup with sparse suffix arrays.

Only the suffixes that start at minimiser positions are retained, one for each segment.  A shard sorts
them by the words that follow the anchor and compares neighbours, which gives the length each pair of
neighbours has in common to the right; the same for the words before the anchors, read backwards, to the
left.  A window with ``l`` words before its anchor is repeated where the left runs agree in ``l`` words and
the right ones in the rest: matches are extended to both sides from the anchor, for every ``l`` that a
window can have.  See :mod:`skyrisk.llm.repeats` for the job around it and the defined cases.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from skyrisk.llm.repeats import WINDOW, without_repeats


def _sorted(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order of the parts, and what each one has in common with the one before (its length at most)."""
    width = max(1, max(len(p) for p in parts))
    table = np.zeros((len(parts), width), np.int64)  # 0 is no word: a shorter part sorts first
    for row, p in zip(table, parts, strict=True):
        row[:len(p)] = p
    order = np.lexsort(table.T[::-1])
    own = table[order]
    same = (own[1:] == own[:-1]) & (own[1:] > 0)
    return order, np.concatenate(([0], np.logical_and.accumulate(same, axis=1).sum(1)))


def _classes(order: np.ndarray, common: np.ndarray, n: int) -> np.ndarray:
    """A number for each part, equal where the first ``n`` words are."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < n) if n else 0
    return out


def smallest_ids(texts: list[np.ndarray], anchors: np.ndarray, ids: np.ndarray) -> list[np.ndarray]:
    """For each text the smallest of ``ids`` that has each of its windows."""
    right, left = _sorted([t[a:] for t, a in zip(texts, anchors, strict=True)]), _sorted([t[:a][::-1] for t, a in zip(texts, anchors, strict=True)])
    out = [np.empty(len(t) - WINDOW + 1, np.int64) for t in texts]
    windows = np.array([len(x) for x in out])
    for before in range(int(anchors.max()) + 1):
        # the window that starts `before` words ahead of the anchor
        on = np.flatnonzero((anchors >= before) & (anchors - before < windows))
        if not len(on):
            continue
        pair = _classes(*right, WINDOW - before)[on] * np.int64(len(texts) + 1) + _classes(*left, before)[on]
        _, name = np.unique(pair, return_inverse=True)
        least = np.full(int(name.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, name, ids[on])
        for i, x in zip(on.tolist(), least[name].tolist(), strict=True):
            out[i][anchors[i] - before] = x
    return out


def suffix_array_dedup(docs: DataFrame, **cols) -> DataFrame:
    return without_repeats(docs, smallest_ids, **cols)
