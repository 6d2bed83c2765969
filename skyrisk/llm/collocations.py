"""Phrases whose words come together more often than apart, counted by vertically partitioned suffix trees.

1. Words are counted for each language.  A word is a prefix; one that occurs in more than an eighth of a
   group's ``budget`` is extended by the next word, and such a pair by the word after that.
2. The prefixes are dealt into so many groups that a group holds half a budget of suffixes on average, none of
   them more than an eighth by one prefix, however frequent a word is.
3. Every word starts a suffix, truncated at ``max_words`` words or at the end of its piece.  A task counts
   equal suffixes before it sends them, as blocks of word numbers with their own small word list.
4. A group is one task's work, independent of all others: its suffixes are sorted, which lays out the
   truncated subtrees of its prefixes, and a node's count is the sum of its leaves.
5. Cuts, scores and the test for longer phrases are joins of the frequent phrases, in exact decimals.

Nothing but the prefixes above an eighth of a budget comes to the driver; they are at most 8 / ``budget`` of the
words in the table, for each depth.  All words and all suffixes are counted.

Defined cases: a null or empty text has no words, a null language is ``und``; repeated rows count again; a piece
of fewer words than a phrase has none; equal scores are ordered by count, then by the phrase's UTF-8 bytes; an
empty table gives no rows; further columns are ignored.  ``n`` counts the words of texts without candidates too.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyrisk.llm.common import working, written

MAX_WORDS = 3
MIN_COUNT = 10
COVER_PERCENT = 50
TOP = 2000
BUDGET = 2_000_000
TASK_TOKENS = 2_000_000
TASK_WORDS = 600_000
RANK_PARTS = 16
UNKNOWN = "und"

# The contract's characters: letters that are lowered, ends of pieces, spaces within a piece.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_END = b"."
_BYTES = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + _ENDS + b"\t", b"abcdefghijklmnopqrstuvwxyz" + _END * len(_ENDS) + b" ")


def tokens_of(text: str) -> list[bytes]:
    """Words, with ``.`` for each end of a piece."""
    return text.encode().translate(_BYTES).replace(_END, b" . ").split()


class Buffer:
    """Word numbers of many texts, by language; 0 stands between pieces."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.numbers[_END]
        self.texts: dict[str, list[np.ndarray]] = {}
        self.size = 0

    def add(self, lang: str, tokens: list[bytes]) -> None:
        self.texts.setdefault(lang, []).append(np.fromiter(map(self.numbers.__getitem__, tokens), np.int64, len(tokens)))
        self.texts[lang].append(np.zeros(1, np.int64))
        self.size += len(tokens)

    def full(self) -> bool:
        return self.size >= TASK_TOKENS or len(self.numbers) >= TASK_WORDS

    def drained(self) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
        names = list(self.numbers)
        for lang, parts in self.texts.items():
            yield lang, names, np.concatenate(parts)
        self.clear()


def _buffered(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[tuple[str, list[bytes], np.ndarray, int]]:
    """(language, words, numbers, starts): suffixes start at the first ``starts`` places.  A text that overfills the
    buffer goes on in the next with the ``depth`` - 1 words after its last start."""
    buffer = Buffer()
    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"], strict=True):
            tokens = tokens_of(text.as_py())
            for at in range(0, len(tokens), TASK_TOKENS):
                part = tokens[at:at + TASK_TOKENS + depth - 1] if depth > 1 else tokens[at:at + TASK_TOKENS]
                if len(part) > TASK_TOKENS:  # the words after the last start belong to the next part
                    alone = Buffer()
                    alone.add(lang, part)
                    yield from ((*x, TASK_TOKENS) for x in alone.drained())
                else:
                    buffer.add(lang, part)
                if buffer.full():
                    yield from ((*x, len(x[2])) for x in buffer.drained())
    yield from ((*x, len(x[2])) for x in buffer.drained())


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for lang, names, numbers, _ in _buffered(batches, 1):
        n = np.bincount(numbers, minlength=len(names))
        n[0] = 0
        at = np.flatnonzero(n)
        for part in (at[i:i + 50_000] for i in range(0, len(at), 50_000)):
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array([names[i] for i in part], pa.binary()).cast(pa.string()),
                                              pa.array(n[part], pa.int64())], ["lang", "phrase", "n"])


def _suffixes(numbers: np.ndarray, starts: int, n_words: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct suffixes as columns (0 past the end), sorted, and their counts."""
    padded = np.concatenate([numbers, np.zeros(depth, np.int64)])
    at = np.flatnonzero(numbers[:starts])
    cols = [padded[at]]
    for d in range(1, depth):
        cols.append(np.where(cols[-1] == 0, 0, padded[at + d]))
    return _distinct(np.stack(cols), np.ones(len(at), np.int64), n_words)


def _runs(cols: np.ndarray) -> np.ndarray:
    """Where a run of equal columns begins."""
    return np.flatnonzero(np.concatenate([np.ones(min(1, cols.shape[1]), bool), (cols[:, 1:] != cols[:, :-1]).any(0)]))


def _distinct(cols: np.ndarray, weights: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    if not cols.shape[1]:
        return cols, weights
    if n_words ** len(cols) < 1 << 62:
        key = cols[0].copy()
        for c in cols[1:]:
            key = key * n_words + c
        order = np.argsort(key, kind="stable")
    else:
        order = np.lexsort(cols[::-1])
    cols = cols[:, order]
    first = _runs(cols)
    return cols[:, first], np.add.reduceat(weights[order], first)


@dataclass
class Plan:
    """The vertical partitioning: prefixes that are extended, and the number of groups."""
    hot: list[set[tuple]]  # by depth - 1: (lang, word, ...) of too many suffixes
    groups: int

    def group(self, lang: str, words: tuple[bytes, ...]) -> int:
        return xxhash.xxh3_64_intdigest(lang.encode() + b"\n" + b" ".join(words)) % self.groups


def _groups(plan: Plan, lang: str, names: list[bytes], cols: np.ndarray) -> np.ndarray:
    """Group of each suffix by its prefix; -1 for one that ends with an extended prefix, whose count is known."""
    out = np.full(cols.shape[1], -1, np.int64)
    left = np.arange(cols.shape[1])
    for d in range(1, len(cols) + 1):
        if not len(left):
            break
        part = cols[:d, left]
        first = _runs(part)
        hot, group = np.zeros(len(first), bool), np.full(len(first), -1, np.int64)
        known = plan.hot[d - 1] if d - 1 < len(plan.hot) else ()
        for i, at in enumerate(first):
            if part[d - 1, at]:
                words = tuple(names[x] for x in part[:, at])
                hot[i] = (lang, *words) in known
                group[i] = plan.group(lang, words)
        run = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(left))))
        out[left] = np.where(hot[run], -1, group[run])
        left = left[hot[run]]
    return out


def _blocks(depth: int, plan) -> Callable:
    """Suffixes of a task's texts, a block for each group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for lang, names, numbers, starts in _buffered(batches, depth):
            cols, n = _suffixes(numbers, starts, len(names), depth)
            group = _groups(plan.value, lang, names, cols)
            order = np.argsort(group, kind="stable")
            order = order[np.searchsorted(group[order], 0):]
            cols, n, group = cols[:, order].astype(np.uint32), n[order].astype(np.uint32), group[order]
            ends = np.flatnonzero(np.diff(group, append=-1)) + 1
            start, held, size = 0, [], 0
            for end in ends.tolist():
                own, local = np.unique(cols[:, start:end], return_inverse=True)
                words = b"\n".join(names[i] if i else b"" for i in own.tolist())
                kind = "<u2" if len(own) < 1 << 16 else "<u4"
                body = pack.compress(local.reshape(depth, -1).astype(kind).tobytes() + n[start:end].tobytes() + words)
                held.append((int(group[start]), lang, end - start, len(own), body))
                start, size = end, size + len(body)
                if size > 1 << 23:
                    yield _block_batch(held)
                    held, size = [], 0
            if held:
                yield _block_batch(held)

    return run


def _block_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["grp", "lang", "n", "n_words", "body"])


def _subtrees(depth: int, min_count: int, plan) -> Callable:
    """The counts of the nodes of a group's subtrees, of two words or more and ``min_count``; a prefix that was
    extended has its leaves in many groups and its count from :func:`_prefix_counts`."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"lang": [], "words": [], "phrase": [], "n": []}
        unpack = zstandard.ZstdDecompressor()
        for lang, blocks in frame.groupby("lang", sort=False):
            numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
            numbers[b""]
            cols, weights = [], []
            for n, n_words, body in zip(blocks["n"], blocks["n_words"], blocks["body"], strict=True):
                raw = unpack.decompress(body)
                wide = 2 if n_words < 1 << 16 else 4
                local = np.frombuffer(raw, f"<u{wide}", depth * n).reshape(depth, n)
                weights.append(np.frombuffer(raw, "<u4", n, depth * n * wide))
                names = raw[(depth * wide + 4) * n:].split(b"\n")
                cols.append(np.fromiter(map(numbers.__getitem__, names), np.int64, len(names))[local])
            leaves, n = _distinct(np.concatenate(cols, 1), np.concatenate(weights).astype(np.int64), len(numbers))
            names = list(numbers)
            for d in range(2, depth + 1):
                extended = plan.value.hot[d - 1] if d <= len(plan.value.hot) else ()
                first = _runs(leaves[:d])
                total = np.add.reduceat(n, first)
                good = (total >= min_count) & (leaves[d - 1, first] > 0)
                for at, k in zip(first[good].tolist(), total[good].tolist(), strict=True):
                    words = [names[i] for i in leaves[:d, at]]
                    if not extended or (lang, *words) not in extended:
                        out["lang"].append(lang)
                        out["words"].append(d)
                        out["phrase"].append(b" ".join(words).decode())
                        out["n"].append(k)
        if not out["n"]:
            return pd.DataFrame({"lang": [""], "words": [0], "phrase": [""], "n": [0]}).iloc[:0]
        return pd.DataFrame(out)

    return run


def _prefix_counts(depth: int, hot) -> Callable:
    """Counts of the prefixes of ``depth`` words that may have to be extended: a phrase is no more frequent than its
    parts, so without the last word and without the first they are in ``hot``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = hot.value
        for lang, names, numbers, starts in _buffered(batches, depth):
            seen = {w for x in known if x[0] == lang for w in x[1:]}
            often = np.array([x in seen for x in names])[np.concatenate([numbers, np.zeros(depth, np.int64)])]
            at = np.flatnonzero(np.logical_and.reduce([often[d:d + starts] for d in range(depth)]))
            cols, n = _distinct(np.stack([numbers[at + d] for d in range(depth)]), np.ones(len(at), np.int64), len(names))
            found = [(tuple(names[i] for i in c), k) for c, k in zip(cols.T.tolist(), n.tolist(), strict=True)]
            rows = [(b" ".join(words).decode(), k) for words, k in found if (lang, *words[:-1]) in known and (lang, *words[1:]) in known]
            for part in (rows[i:i + 50_000] for i in range(0, len(rows), 50_000)):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array([r[0] for r in part]), pa.array([r[1] for r in part], pa.int64())],
                                                 ["lang", "phrase", "n"])

    return run


def _keys(counts: DataFrame) -> set[tuple]:
    return {(r.lang, *(w.encode() for w in r.phrase.split(" "))) for r in counts.select("lang", "phrase").collect()}


def frequent_phrases(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, budget: int = BUDGET, text_col: str = "text",
                     lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(``lang, words, phrase, n`` of every phrase of up to ``max_words`` words with ``min_count`` occurrences;
    ``lang, n`` with all words of each language).  Both read working tables."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where(F.col("text").isNotNull())
    summed = lambda df: df.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    words, _ = written(summed(rows.mapInArrow(_word_counts, "lang string, phrase string, n long")), "words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    parts = [words.select("lang", F.lit(1).alias("words"), "phrase", "n")]
    over = F.col("n") > max(1, budget // 8)
    hot = [_keys(words.where(over))]  # at most eight for each budget of words in the table
    while hot[-1] and len(hot) < max_words - 1:
        held = spark.sparkContext.broadcast(hot[-1])
        longer, _ = written(summed(rows.mapInArrow(_prefix_counts(len(hot) + 1, held), "lang string, phrase string, n long")).where(over), "prefixes")
        parts.append(longer.select("lang", F.lit(len(hot) + 1).alias("words"), "phrase", "n"))
        hot.append(_keys(longer))
    n = words.agg(F.sum("n")).first()[0] or 0
    plan = spark.sparkContext.broadcast(Plan(hot, max(1, -(-2 * n // budget))))
    blocks = rows.mapInArrow(_blocks(max_words, plan), "grp long, lang string, n long, n_words long, body binary")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-plan.value.groups // 4))
    nodes = blocks.repartition(tasks, "grp").groupBy("grp").applyInPandas(_subtrees(max_words, min_count, plan), "lang string, words int, phrase string, n long")
    nodes, _ = written(nodes, "nodes")
    return reduce(DataFrame.unionByName, parts).where(F.col("n") >= min_count).unionByName(nodes), totals


def _part(phrase: str, first, length) -> F.Column:
    """Words ``first`` ... of a space-joined phrase."""
    return F.array_join(F.slice(F.split(phrase, " "), first, length), " ")


def collocations(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, cover_percent: int = COVER_PERCENT, top: int = TOP,
                 budget: int = BUDGET, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's first ``top`` phrases of two to ``max_words``
    words: ``a`` occurrences, ``l`` and ``r`` those of the two parts at the cut of least score
    floor(1000000 a a / (l r)), ``n`` the language's words.  A phrase inside a longer frequent one with
    ``cover_percent`` of its occurrences is left out."""
    with working(docs.sparkSession):
        found, totals = frequent_phrases(docs, max_words, min_count, budget, text_col, lang_col)
        found, _ = written(found, "frequent")
        longer = found.where(F.col("words") >= 2)
        places = F.explode(F.expr("flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), i -> named_struct('i', i, 'm', m))))"))
        inside = longer.where(F.col("words") >= 3).select("lang", "phrase", "n", places.alias("x"))
        inside = inside.select("lang", _part("phrase", F.col("x.i"), F.col("x.m")).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("most"))
        kept = longer.join(inside, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most") < cover_percent * F.col("n")))
        cuts = kept.select("lang", "phrase", F.col("n").alias("a"), "words", F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
        cuts = cuts.select("lang", "phrase", "a", "k", _part("phrase", F.lit(1), F.col("k")).alias("first"),
                           _part("phrase", F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
        known = found.select("lang", F.col("phrase").alias("part"), "n")
        cuts = cuts.join(known.select("lang", F.col("part").alias("first"), F.col("n").alias("l")), ["lang", "first"])
        cuts = cuts.join(known.select("lang", F.col("part").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
        wide = lambda c: f"cast({c} as decimal(15, 0))"  # noqa: E731  a count of words; the products need 38 digits
        score = F.expr(f"(cast(1000000 as decimal(7, 0)) * {wide('a')} * {wide('a')}) div ({wide('l')} * {wide('r')})")
        best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
        best = best.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
        order = [F.desc("score"), F.desc("a"), "phrase"]
        part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))  # a frequent language is ranked in parts first
        first = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("rank") <= top)
        first = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
        out = first.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
        return written(out, "collocations", result=True)[0]
