"""Benchmark decontamination with a generalised suffix automaton of the test items.

Text is normalised by lower-casing A-Z and taking runs of ``[0-9a-z]`` and non-ASCII characters as
words.  All items go into one automaton (states carry link and length); a document's words are
streamed through it, which keeps the longest suffix that is a substring of any item.  A window is
``window`` consecutive words of an item (a shorter item is one window); a document word inside any
occurrence of a window is hit.

The items are the stated query set.  Their size is checked on the driver: at most
``BLOCK_WORDS`` words go into one automaton, and a larger benchmark is streamed against in blocks,
each pass carrying the spans found so far, so that memory stays bounded.  Documents are never
shuffled.

Defined cases: null or empty text has no words (no hit, not contaminated); null or empty items have
no windows; an item with a null id marks words but is listed nowhere; repeated items with one id count
once; repeated documents each give a row; empty tables give empty results or clean documents.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyrisk.llm.common import held_in_worker, written

WINDOW = 10
BLOCK_WORDS = 500_000

# ASCII letters A-Z lower-cased, ASCII characters that are no word characters to blanks
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_NORMAL).split() if text else []


class ItemAutomaton:
    """Generalised suffix automaton over word ids; ``window_items[s]`` and ``short[s]`` say which
    items have a window that ends in state ``s``."""

    def __init__(self, items: list[list[bytes]], window: int):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [[self.vocab.setdefault(w, len(self.vocab)) for w in words] for words in items]
        for ids in coded:
            state = 0
            for c in ids:
                state = self._extend(state, c)
        self._mark(coded)
        self.shortest = min([window, *(len(ids) for ids in coded if ids)])

    def _state(self, nexts: dict[int, int], link: int, length: int) -> int:
        self.next.append(nexts)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """The state for the longest string of ``p`` followed by ``c``, cut off ``q`` if ``q`` is longer."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, self.next[last][c], c)
        new, p = self._state({}, 0, self.length[last] + 1), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, self.next[p][c], c)
        return new

    def _holding(self, state: int, n: int) -> int:
        """The state on the link path that holds the suffix of ``n`` words."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def _mark(self, coded: list[list[int]]) -> None:
        self.window_items: dict[int, set[int]] = {}
        whole: dict[int, list[tuple[int, int]]] = {}
        for k, ids in enumerate(coded):
            state = 0
            for i, c in enumerate(ids):
                state = self.next[state][c]
                if i + 1 >= self.window:
                    self.window_items.setdefault(self._holding(state, self.window), set()).add(k)
            if 0 < len(ids) < self.window:
                whole.setdefault(self._holding(state, len(ids)), []).append((len(ids), k))
        order = np.argsort(self.length, kind="stable").tolist()
        self.full = [-1] * len(order)
        self.short: list[tuple] = [()] * len(order)
        for s in order[1:]:
            up = self.link[s]
            if self.length[s] >= self.window:
                self.full[s] = s if self.length[up] < self.window else self.full[up]
            self.short[s] = (*self.short[up], *whole.get(s, ()))

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int], int]:
        """Hit spans [from, to) in words (merged), items that have an occurring window, and the longest match."""
        ids = np.fromiter(map(self.vocab.get, words, repeat(-1)), np.int64, len(words))
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        longest = 0
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).view(np.int8), [0]))))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a < self.shortest:  # a shorter run of known words holds no window
                continue
            state = run = 0
            for i, c in enumerate(ids[a:b].tolist(), a):
                while state and c not in self.next[state]:
                    state = self.link[state]
                    run = self.length[state]
                if c in self.next[state]:
                    state, run = self.next[state][c], run + 1
                longest = max(longest, run)
                n = 0
                if run >= self.window:
                    n = self.window
                    items |= self.window_items[self.full[state]]
                for size, k in self.short[state]:
                    if size <= run:
                        n = max(n, size)
                        items.add(k)
                if n:
                    start = i + 1 - n
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append((start, i + 1))
        return spans, items, longest


def _automaton(key: tuple, items: list[tuple[str | None, bytes]], window: int) -> ItemAutomaton:
    return held_in_worker("items", key, lambda: ItemAutomaton([words_of(text) for _, text in items], window))  # one block at a time


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> list[list[tuple[str | None, bytes]]]:
    blocks: list[list] = [[]]
    n = 0
    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t")).distinct()
    for row in rows.toLocalIterator():
        data = (row.t or "").encode()
        size = len(words_of(data))
        if n and n + size > BLOCK_WORDS:
            blocks.append([])
            n = 0
        blocks[-1].append((row.i, data))
        n += size
    return blocks


def find_overlap(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
                 item_id_col: str = "item_id", item_text_col: str = "text", keep: list[str] | None = None, cut: bool = False) -> DataFrame:
    """``doc_id, text, spans array<struct<from,to>>`` (hit words, by position), ``items array<string>``
    (sorted), ``longest`` (longest match in words that any run long enough for a window has), ``n_words``,
    and ``kept``: a struct of further columns of ``docs``, if asked for.  With ``cut`` the text comes without
    its hit spans."""
    spark = docs.sparkSession
    own = [F.struct(*keep).alias("kept")] if keep else []
    frame = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *own).withColumns({
        "spans": F.array().cast("array<struct<`from`:int,`to`:int>>"), "items": F.array().cast("array<string>"),
        "longest": F.lit(0), "n_words": F.lit(0)})
    blocks = _blocks(benchmark, item_id_col, item_text_col)
    for at, block in enumerate(blocks):
        if at:  # more than one pass: cut here, so that one block's automaton is in memory at a time
            frame, _ = written(frame, "overlap")
        held = spark.sparkContext.broadcast(block)  # at most BLOCK_WORDS words, or one item
        last = at == len(blocks) - 1
        frame = frame.mapInArrow(_scanner(held, window, cut and last), T.StructType(frame.schema.fields))
    return frame


def _scanner(held, window: int, cut: bool):
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = held.value
        auto = _automaton((name, window), block, window)
        for batch in batches:
            spans, items, longest, n_words = [], [], [], []
            before = batch.column("spans").to_pylist(), batch.column("items").to_pylist(), batch.column("longest").to_pylist()
            for data, old, had, most in zip(batch.column("text").cast(pa.binary()).to_pylist(), *before, strict=True):
                words = words_of(data)
                found, ks, best = auto.scan(words)
                if old:
                    found = _merged([(s["from"], s["to"]) for s in old] + found)
                spans.append([{"from": a, "to": b} for a, b in found])
                items.append(sorted({block[k][0] for k in ks if block[k][0] is not None} | set(had)))
                longest.append(max(best, most))
                n_words.append(len(words))
            new = {"spans": spans, "items": items, "longest": longest, "n_words": n_words}
            if cut:
                new["text"] = [_cut(x, s) for x, s in zip(batch.column("text").to_pylist(), spans, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(new[f.name], f.type) if f.name in new else batch.column(f.name) for f in batch.schema], schema=batch.schema)
    return run


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def digest(found: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"])
    return found.select("doc_id", F.col("n_words").cast("long").alias("n_words"), hit.alias("n_hit"),
                        F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (hit > 0).alias("contaminated"))


def _cut(text: str | None, spans: list[dict]) -> str | None:
    """The text without its hit words and what stands between them."""
    if not spans:
        return text
    data = text.encode()
    at = [(m.start(), m.end()) for m in _WORD.finditer(data.translate(_NORMAL))]
    kept, done = [], 0
    for s in spans:
        kept.append(data[done:at[s["from"]][0]])
        done = at[s["to"] - 1][1]
    return b"".join([*kept, data[done:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = 0.5, **cols) -> DataFrame:
    """``doc_id, text, n_hit`` (and ``kept``) of the documents that stay: hit spans (matches of ``window``
    words or more, or whole short items) are cut out of the text; a document whose hit words are more than
    ``max_coverage`` of its words goes.  A text without hits is returned unchanged."""
    found = find_overlap(docs, benchmark, window, cut=True, **cols)
    hit = F.aggregate("spans", F.lit(0), lambda n, s: n + s["to"] - s["from"])
    return (found.withColumn("n_hit", hit).where(F.col("n_hit") <= F.col("n_words") * max_coverage)
            .select("doc_id", "text", "n_hit",
                    *(["kept"] if "kept" in found.columns else [])))
