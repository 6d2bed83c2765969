"""Toxicity of whole texts: a support vector machine on sentences with a subsequence string kernel.

The kernel compares two words, with their ends marked, by their common subsequences of three characters; each
character of a gap costs a factor ``DECAY``, so an insult with inserted characters, or with dots or blanks between its
letters, stays close to its plain form, and an unseen ending close to its stem.  It is normalised.

1. ``fit_rows``: of each label the ``FIT_DOCS`` documents of least hashed id (a documented bound for the fit only).
2. First witnesses: the letter groups that toxic texts of the sample have more often than others, counted by
   Spark, point at the words for which a toxic text was labelled.
3. Landmarks are witnesses and clean words that differ from each other.  The Nystroem map of the kernel on them gives
   vectors, and a linear machine with squared hinge loss is fitted to them by Newton steps.
4. ``ROUNDS`` times every sentence of the sample is scored: a toxic document's best sentences become its witnesses
   (the label is the document's, and most of its sentences are harmless), and the highest clean ones are added.
5. The machine is linear in the kernel's features, so it folds into one weight for each subsequence; a sentence's
   margin is that of its strongest word, exactly as the kernel expansion gives it, and a text's that of its
   strongest sentence.  A logistic curve, fitted to the sample's texts, makes it a probability.

Words are cut at white space after lower-casing; characters that hide a word (dots, dashes, stars, quotes ...) are
dropped from it, and three or more single letters in a row count as one word too.  A word beyond ``LONG`` characters
is scored by overlapping windows, so every character of every text counts.

Defined cases: a null text or one without words scores 0 (its margin is that of no evidence); without labelled rows
of both kinds every score is 0; several labels of an id count as the largest; null labels and ids are not learned
from, and null ids are not held out; ties are broken by the word; repeated rows give a row each; further columns are
ignored.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyrisk.llm.common import held_in_worker, id_text

FIT_DOCS = 3000
DECAY = 0.5
LONG = 16
LANDMARKS = 240
ROUNDS = 2
WITNESSES = 3
FIRST_GRAMS = 20_000
SURE = 2.0
COMMON = 1.5
PENALTY = 0.002
CACHE_WORDS = 400_000
CHUNK = 2048

CLASSES = 96  # character classes: ends, digits and basic letters each its own, others by code point
_HIDING = b".-_*'`~^|+=#@&%$"
_SPACES = bytes.maketrans(b',;:!?()[]{}<>"/\\', b" " * 16)
_SENTENCES = re.compile(r"[^.!?\n]*[.!?\n]?")
_START, _STOP = "\x02", "\x03"


# ---------------------------------------------------------------- words and kernel
def words_of(text: str | None) -> list[str]:
    """The words of a text, and the words that runs of three or more single letters spell."""
    if not text:
        return []
    words = text.lower().encode("utf-8", "replace").translate(_SPACES, _HIDING).decode().split()
    single = np.fromiter(map(len, words), np.int64, len(words)) == 1
    if single.sum() >= 3:
        edge = np.diff(np.concatenate([[0], single.view(np.int8), [0]]))
        for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
            if b - a >= 3:
                words.append("".join(words[a:b]))
    return words


def windows_of(word: str) -> list[str]:
    """The strings the kernel sees: the marked word, or overlapping windows of a long one."""
    marked = f"{_START}{word}{_STOP}"
    if len(marked) <= LONG + 2:
        return [marked]
    return [marked[i:i + LONG + 2] for i in range(0, len(marked) - LONG // 2, LONG // 2 + 1)]


def _class_table() -> np.ndarray:
    table = 39 + np.arange(1 << 16) % (CLASSES - 39)
    for k, c in enumerate(_START + _STOP + "0123456789abcdefghijklmnopqrstuvwxyz"):
        table[ord(c)] = k + 1
    return table.astype(np.int64)


_CLASS = _class_table()


@lru_cache(maxsize=64)
def _triples(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    at = np.array([(i, j, k) for i in range(n) for j in range(i + 1, n) for k in range(j + 1, n)], np.int64).reshape(-1, 3)
    return at[:, 0], at[:, 1], at[:, 2], DECAY ** (at[:, 2] - at[:, 0] - 2.0)


def _by_length(strings: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, subsequence codes, weights) of strings of one length, a chunk at a time."""
    size = np.fromiter(map(len, strings), np.int64, len(strings))
    for n in np.unique(size).tolist():
        i, j, k, w = _triples(n)
        here = np.flatnonzero(size == n)
        for at in (here[s:s + CHUNK] for s in range(0, len(here), CHUNK)):
            points = np.frombuffer("".join(strings[x] for x in at.tolist()).encode("utf-32-le"), "<u4").reshape(len(at), n)
            c = _CLASS[points & 0xFFFF]
            yield at, (c[:, i] * CLASSES + c[:, j]) * CLASSES + c[:, k], w


def _lengths(codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Norm of each row's features: weights of equal subsequences add up before they are squared."""
    if not codes.size:
        return np.ones(len(codes))
    order = np.argsort(codes, axis=1, kind="stable")
    codes, w = np.take_along_axis(codes, order, 1), weights[order]
    new = np.ones(codes.shape, bool)
    new[:, 1:] = codes[:, 1:] != codes[:, :-1]
    total = np.add.reduceat(w.ravel(), np.flatnonzero(new.ravel()))
    rows = np.nonzero(new)[0]
    return np.sqrt(np.bincount(rows, total * total, len(codes)))


class Landmarks:
    """Kernel values between strings and a fixed list of strings."""

    def __init__(self, strings: list[str]):
        self.strings = strings
        entries: dict[int, dict[int, float]] = defaultdict(dict)
        for at, codes, w in _by_length(strings):
            norm = _lengths(codes, w)
            for row, s in enumerate(at.tolist()):
                for code, x in zip(codes[row].tolist(), (w / norm[row]).tolist(), strict=True):
                    entries[code][s] = entries[code].get(s, 0.0) + x
        self.codes = np.array(sorted(entries), np.int64)
        self.place = np.full(CLASSES**3, len(self.codes), np.int32)
        self.place[self.codes] = np.arange(len(self.codes))
        self.matrix = np.zeros((len(self.codes) + 1, len(strings)))
        for row, code in enumerate(self.codes.tolist()):
            for s, x in entries[code].items():
                self.matrix[row, s] = x

    def kernel(self, strings: list[str]) -> np.ndarray:
        out = np.zeros((len(strings), len(self.strings)))
        for at, codes, w in _by_length(strings):
            norm = _lengths(codes, w)
            for s in range(0, len(at), 64):
                found = self.matrix[self.place[codes[s:s + 64]]]
                out[at[s:s + 64]] = np.einsum("t,rtl->rl", w, found) / norm[s:s + 64, None]
        return out


# ---------------------------------------------------------------- the machine
@dataclass
class Model:
    weights: np.ndarray  # for each subsequence code
    bias: float
    slope: float = 1.0  # of the logistic curve
    shift: float = 0.0
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def margins(self, strings: list[str]) -> np.ndarray:
        """Margin of each string over the bias; of one without a subsequence 0."""
        out = np.zeros(len(strings))
        for at, codes, w in _by_length(strings):
            if codes.size:
                total = self.weights[codes] @ w
                for_it = np.flatnonzero(total > 0)  # the rest only needs to stay below these
                value = total / np.sqrt(w @ w)
                value[for_it] = total[for_it] / _lengths(codes[for_it], w)
                out[at] = value
        return out

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * (margin + self.bias) + self.shift, -30, 30)))


class Scorer:
    """Margins of words, with a bounded cache."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def of(self, lists: list[list[str]]) -> list[list[float]]:
        new = list(set().union(*lists).difference(self.known)) if lists else []
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known = {}
            new = list(set().union(*lists))
        windows = [windows_of(w) for w in new]
        ends = np.cumsum([len(x) for x in windows])
        margins = self.model.margins([s for x in windows for s in x])
        best = np.maximum.reduceat(margins, np.concatenate([[0], ends[:-1]])) if new else margins
        self.known.update(zip(new, best.tolist(), strict=True))
        return [list(map(self.known.__getitem__, x)) for x in lists]


def squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = PENALTY, steps: int = 30) -> np.ndarray:
    """Weights and, last, the bias of a linear machine: Newton steps on penalty |w|^2 / 2 + mean weighted max(0, 1 - y f)^2."""
    x = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    weight = weight / weight.sum()
    w = np.zeros(x.shape[1])
    loss = lambda w: 0.5 * (ridge * w) @ w + weight @ np.maximum(0.0, 1 - y * (x @ w)) ** 2
    for _ in range(steps):
        gap = 1 - y * (x @ w)
        on = gap > 0
        gradient = ridge * w - 2 * x[on].T @ (weight[on] * y[on] * gap[on])
        step = np.linalg.solve(np.diag(ridge) + 2 * (x[on].T * weight[on]) @ x[on], gradient)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > loss(w) - 1e-4 * size * (gradient @ step):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return w


def _spread(strings: list[str], n: int) -> list[str]:
    """Up to ``n`` strings in the given order, leaving out those alike to one that is in (kernel 0.9)."""
    kept: list[str] = []
    for at in range(0, len(strings), 64):
        part = strings[at:at + 64]
        far = Landmarks(kept).kernel(part).max(1) < 0.9 if kept else np.ones(len(part), bool)
        for s, ok in zip(part, far, strict=True):
            if ok and len(kept) < n:
                kept.append(s)
    return kept


def machine(positive: list[str], negative: list[str]) -> Model:
    """A machine for witnesses (most frequent first) against clean words (hardest first)."""
    marks = _spread(positive, LANDMARKS // 2)
    marks += _spread([s for s in negative if s not in set(marks)], LANDMARKS - len(marks))
    kernel = Landmarks(marks)
    value, vector = np.linalg.eigh(kernel.kernel(marks))
    good = value > 1e-6
    root = vector[:, good] / np.sqrt(value[good])
    x = kernel.kernel(positive + negative) @ root
    y = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
    weight = np.where(y > 0, 1 / max(1, len(positive)), 1 / max(1, len(negative)))
    w = squared_hinge(x, y, weight)
    weights = np.zeros(CLASSES**3, np.float64)
    weights[kernel.codes] = kernel.matrix[:-1] @ (root @ w[:-1])
    return Model(weights, float(w[-1]))


def logistic(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and shift of P(label = 1), with Platt's targets."""
    n1, n0 = label.sum(), (1 - label).sum()
    target = np.where(label > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(label > 0, 0.5 / max(n1, 1), 0.5 / max(n0, 1))
    x, w = np.stack([margin, np.ones(len(margin))], 1), np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - target)) + 1e-6 * w
        step = np.linalg.solve((x.T * (weight * p * (1 - p) + 1e-9)) @ x + 1e-6 * np.eye(2), gradient)
        w = w - step * min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
    return max(0.0, float(w[0])), float(w[1])


# ---------------------------------------------------------------- fit
def held_out(id_col: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def fit_rows(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
             fit_docs: int = FIT_DOCS) -> DataFrame:
    """``i, text, label`` of the bounded sample."""
    known = labels.select(F.col(id_col).alias("i"), (F.col(label_col) > 0).cast("int").alias("label"))
    known = known.where(F.col("i").isNotNull() & F.col("label").isNotNull() & ~held_out("i")).groupBy("i").agg(F.max("label").alias("label"))
    known = known.withColumn("h", F.xxhash64(F.col("i").cast("string")))
    share = known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).select("label", F.least(F.lit(1.0), 4.0 * fit_docs / F.col("n")).alias("share"))
    few = known.join(F.broadcast(share), "label").where(F.col("h") <= F.lit(-2.0**63) + F.col("share") * 2.0**64)  # two rows; a range that holds about four samples
    first = few.withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy("h", "i"))).where(F.col("k") <= fit_docs)
    text = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull())
    return text.join(F.broadcast(first.select("i", "label")), "i")  # at most 2 * fit_docs ids


def grams_of(word: str) -> set[str]:
    return {s[i:i + 4] for s in windows_of(word) for i in range(len(s) - 3)}


def _counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents with each group of four letters and with each word, by label."""
    count: defaultdict[tuple, int] = defaultdict(int)
    for f in frames:
        for text, label in zip(f["text"], f["label"], strict=True):
            words = set(words_of(text))
            for w in words:
                count["w", w, label] += 1
            for g in set().union(*map(grams_of, words)):
                count["g", g, label] += 1
    yield pd.DataFrame([(*k, n) for k, n in count.items()], columns=["kind", "key", "label", "n"])


def _first_points(points: dict[str, float]) -> Callable:
    """A word's score before there is a machine: that of its most telling group of letters."""
    def score(lists: list[list[str]]) -> list[list[float]]:
        known = {w: max((points.get(g, 0.0) for g in grams_of(w)), default=0.0) for w in set().union(*lists)}
        return [[known[w] for w in x] for x in lists]

    return score


def _chosen(make: Callable[[], Callable], common, least: float) -> Callable:
    """``label, word, margin, top``: of a toxic sample text the highest words that clean ones hardly have, above
    ``least`` and half the text's best; of a clean one the highest of all and as many by hash.  ``top`` marks the
    highest of all in a text."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = make()
        for f in frames:
            lists = [sorted(set(words_of(t))) for t in f["text"]]
            out = []
            for words, margins, label in zip(lists, score(lists) if lists else [], f["label"], strict=True):
                best = sorted(zip(margins, words, strict=True), key=lambda x: (-x[0], x[1]))
                out.append((label, None, best[0][0] if best else 0.0, True))
                if label == 1:
                    best = [x for x in best if x[1] not in common.value and x[0] > least]
                    best = [x for x in best if x[0] >= best[0][0] / 2]
                out += [(label, w, m, False) for m, w in best[:WITNESSES]]
                if label == 0:
                    picked = sorted(zip(words, margins, strict=True), key=lambda x: xxhash.xxh3_64_intdigest(x[0]))[:WITNESSES]
                    out += [(label, w, m, False) for w, m in picked]
            yield pd.DataFrame(out, columns=["label", "word", "margin", "top"])

    return run


def _instances(chosen: pd.DataFrame) -> tuple[list[str], list[str]]:
    """Witness strings, most frequent first, and clean strings, hardest first."""
    named = chosen[~chosen["top"]]
    toxic, clean = named[named["label"] == 1], named[named["label"] == 0]
    often = toxic.groupby("word").agg(n=("margin", "size")).reset_index().sort_values(["n", "word"], ascending=[False, True])
    hard = clean.groupby("word").agg(m=("margin", "max")).reset_index().sort_values(["m", "word"], ascending=[False, True])
    known = set(often["word"])
    strings = lambda words: list(dict.fromkeys(s for w in words for s in windows_of(w)))
    return strings(often["word"]), strings(w for w in hard["word"] if w not in known)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", fit_docs: int = FIT_DOCS, **cols: str) -> Model | None:
    """The fitted machine, or None if the sample has not both labels.  The driver gets words of the bounded sample."""
    rows = fit_rows(docs, labels, label_col, fit_docs=fit_docs, **cols).select("text", "label").persist()
    send = rows.sparkSession.sparkContext.broadcast
    try:
        size = {r.label: r.n for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
        if len(size) < 2:
            return None
        counts = rows.mapInPandas(_counts, "kind string, key string, label int, n long").groupBy("kind", "key").pivot("label", [0, 1]).agg(F.sum("n")).na.fill(0)
        odds = F.log((F.col("1") + 0.5) / (size[1] + 1)) - F.log((F.col("0") + 0.5) / (size[0] + 1))
        sure = odds - SURE * F.sqrt(1 / (F.col("1") + 0.5) + 1 / (F.col("0") + 0.5))
        counts = counts.where(F.col("1") > 0).select("kind", "key", F.col("0").alias("clean"), odds.alias("odds"), sure.alias("sure")).persist()
        grams = counts.where("kind = 'g' and sure > 0").orderBy(F.desc("sure"), "key").limit(FIRST_GRAMS).collect()
        common = send({r.key for r in counts.where((F.col("kind") == "w") & (F.col("clean") > 0) & (F.col("odds") < COMMON)).select("key").collect()})
        counts.unpersist()
        points = send({r.key: r.sure for r in grams})
        schema = "label int, word string, margin double, top boolean"
        chosen = rows.mapInPandas(_chosen(lambda: _first_points(points.value), common, 0.0), schema).toPandas()
        clean: list[str] = []
        for _ in range(ROUNDS):
            positive, negative = _instances(chosen)
            clean = list(dict.fromkeys(negative + clean))
            if not positive:
                return None
            model = machine(positive, [s for s in clean if s not in set(positive)])
            shipped = send(model)
            chosen = rows.mapInPandas(_chosen(lambda: Scorer(shipped.value).of, common, -shipped.value.bias), schema).toPandas()
        best = chosen[chosen["top"]]
        model.slope, model.shift = logistic(np.maximum(best["margin"].to_numpy(), 0.0) + model.bias, best["label"].to_numpy(np.float64))
        return model
    finally:
        rows.unpersist()


# ---------------------------------------------------------------- scores
def sentences_of(text: str | None) -> list[str]:
    return [s for s in _SENTENCES.findall(text or "") if s.strip()]


def score_texts(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, margin, score, word``: a text's largest margin, its probability, and the word that has it."""
    rows = id_text(docs, id_col, text_col)
    if model is None:
        return rows.select("doc_id", F.lit(0.0).alias("margin"), F.lit(0.0).alias("score"), F.lit(None).cast("string").alias("word"))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        scorer = held_in_worker("toxicity", m.name, lambda: Scorer(m))
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                lists = [words_of(t.as_py()) for t in part["text"]]
                best, names = [], []
                for words, margins in zip(lists, scorer.of(lists), strict=True):
                    top = max(margins, default=0.0)
                    best.append(max(top, 0.0))
                    names.append(words[margins.index(top)] if top > 0 else None)
                margin = np.array(best)
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(margin + m.bias), pa.array(np.where([bool(x) for x in lists], m.probability(margin), 0.0)),
                                                  pa.array(names, pa.string())], ["doc_id", "margin", "score", "word"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, margin double, score double, word string")


def score_sentences(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, at, sentence, score`` of each sentence of each text."""
    rows = id_text(docs, id_col, text_col)
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(held.value)
        for f in frames:
            for doc, text in zip(f["doc_id"], f["text"], strict=True):
                parts = sentences_of(text)
                margins = np.array([max(x, default=0.0) for x in scorer.of([words_of(s) for s in parts])])
                yield pd.DataFrame({"doc_id": [doc] * len(parts), "at": np.arange(len(parts), dtype=np.int32), "sentence": parts,
                                    "score": held.value.probability(np.maximum(margins, 0.0))})

    return rows.mapInPandas(run, f"doc_id {kind}, at int, sentence string, score double")


def predict(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", **cols: str) -> DataFrame:
    """``doc_id, held_out, score, predicted``, fitted on the labelled documents that are not held out."""
    scored = score_texts(docs, fit(docs, labels, label_col, **cols), **cols)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
