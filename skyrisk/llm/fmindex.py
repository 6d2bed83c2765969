"""Substring dedup with a compressed FM-index per shard.

The words of a shard's segments form one text, each segment ended by a separator.  Suffixes are sorted by
their first 54 words (ranks of 3, 9, 27 and 54 words, each from the one before), which is all that
backward steps over patterns of up to 51 words need.  The words before them, in that order, are kept in a wavelet matrix: one bit vector for each
bit of a word's number, packed, with counts per 64 bits.

Every segment is streamed from its last word to its first, all segments of a shard side by side.  A step
extends the match by one word to the left (two ranks in the wavelet matrix); a match that has reached
``WINDOW`` words is held at that length by widening its interval to all suffixes that share ``WINDOW``
words.  As all streamed segments are themselves in the index, a step never fails, and the matching
statistics are the window length wherever a window starts; the interval's smallest document id is the
answer.  See :mod:`skyrisk.llm.repeats` for the job around it and the defined cases.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from skyrisk.llm.repeats import WINDOW, without_repeats


class WaveletMatrix:
    """``rank(symbol, i)``: how often each symbol occurs before position i; bits are packed."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits = bits
        self.words, self.counts, self.zeros = [], [], []
        for b in range(bits - 1, -1, -1):
            bit = (values >> b & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            packed = np.concatenate((packed, np.zeros(-len(packed) % 8 + 8, np.uint8))).view("<u8")
            self.words.append(packed)
            self.counts.append(np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)[:-1])))
            self.zeros.append(len(values) - int(bit.sum()))
            values = np.concatenate((values[~bit], values[bit]))
        symbols = np.arange(1 << bits)
        self.start = self._down(symbols, np.zeros(1 << bits, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where positions lead to, level by level, along the bits of a symbol."""
        for level, b in enumerate(range(self.bits - 1, -1, -1)):
            block = at >> 6
            below = self.words[level][block] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
            ones = self.counts[level][block] + np.bitwise_count(below)
            at = np.where(symbol >> b & 1, self.zeros[level] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self._down(symbol, at) - self.start[symbol]


RUN = 27


def _shifted(rank: np.ndarray, k: int) -> np.ndarray:
    return np.concatenate((rank[k:], np.full(min(k, len(rank)), -1)))


def _ranks(rank: np.ndarray, k: int, times: int) -> np.ndarray:
    """Ranks of ``times * k`` words from those of k words."""
    size = np.int64(rank.max(initial=0) + 2)
    key = rank.astype(np.int64)
    for i in range(1, times):
        if float(key.max(initial=0) + 1) * float(size) >= 2**63:
            key = np.unique(key, return_inverse=True)[1]
        key = key * size + _shifted(rank, k * i) + 1
    return np.unique(key, return_inverse=True)[1]


class FMIndex:
    """Of a text of word numbers from 1 on; 0 ends a segment."""

    def __init__(self, text: np.ndarray, owner: np.ndarray):
        n = len(text)
        rank = text  # of the first word; then of 3, 9, 27 and 54 words
        for k in (1, 3, 9):
            rank = _ranks(rank, k, 3)
        run = rank
        rank = _ranks(run, RUN, 2)
        order = np.argsort(rank, kind="stable")
        symbols = int(text.max()) + 1
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols))))
        self.before = WaveletMatrix(text[order - 1], max(1, symbols.bit_length()))
        # rows that share their first WINDOW words: two overlapping runs
        far = _shifted(run, WINDOW - RUN)
        new = np.ones(n, bool)
        new[1:] = (run[order[1:]] != run[order[:-1]]) | (far[order[1:]] != far[order[:-1]])
        self.begin = np.flatnonzero(new)
        self.end = np.append(self.begin[1:], n)
        self.group = np.cumsum(new) - 1
        self.least = np.minimum.reduceat(owner[order], self.begin)

    def step(self, word: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        both = self.before.rank(np.concatenate((word, word)), np.concatenate((low, high)))
        return self.first[word] + both[:len(word)], self.first[word] + both[len(word):]


def smallest_ids(texts: list[np.ndarray], anchors: np.ndarray, ids: np.ndarray) -> list[np.ndarray]:
    """For each text the smallest of ``ids`` that has each of its windows."""
    size = np.array([len(t) for t in texts])
    ends = np.cumsum(size + 1)
    text = np.zeros(int(ends[-1]), np.int64)
    within = np.arange(int(size.sum())) + np.repeat(np.arange(len(texts)), size)
    text[within] = np.concatenate(texts)
    index = FMIndex(text, np.repeat(ids, size + 1))
    longest = int(size.max())
    found = np.full((len(texts), longest), -1, np.int64)
    low, high = np.zeros(len(texts), np.int64), np.full(len(texts), len(text), np.int64)
    for done in range(longest):  # words matched so far, from the end of each segment
        on = np.flatnonzero(size > done)
        at = size[on] - 1 - done
        low[on], high[on] = index.step(text[ends[on] - 1 - size[on] + at], low[on], high[on])
        if done + 1 >= WINDOW:
            group = index.group[low[on]]
            found[on, at] = index.least[group]
            low[on], high[on] = index.begin[group], index.end[group]
    return [f[:n - WINDOW + 1] for f, n in zip(found, size, strict=True)]


def substring_dedup(docs: DataFrame, **cols) -> DataFrame:
    return without_repeats(docs, smallest_ids, **cols)
