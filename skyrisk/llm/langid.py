"""Language of whole texts: script ranges, per-word scores, Viterbi spans.

Words are runs of letters, lower-cased.  A word's script (by Unicode ranges) narrows the candidates to
the languages that use it; each candidate is scored by the letter trigrams of the word with its ends
marked, and the scores become log posteriors with a floor.  Viterbi over the words of the whole text,
with a constant penalty for each switch, labels spans; the language that most words are labelled with is
the document's, and its share of the words is the score.

A path without a switch is the best one if no interval of words gains more than half a penalty in another
language (k other spans gain at most k halves and cost k - 1 switches), which running sums show for a whole
document at once; only other documents take the step by step form.

The model is fitted on a bounded sample: of each language the ``FIT_ROWS`` labelled documents of at most
``FIT_CHARS`` characters whose hashed id is smallest.  Trigram counts are made by Spark; the model keeps
the ``MAX_GRAMS`` most frequent trigrams and so has a bound for the broadcast.

Defined cases: null texts and texts without a letter are ``und`` with score 0; without any labelled row
every text is ``und``; a word of a script that no language uses counts for all alike; ties go to the
language that sorts first; rows with a null id are never learned from and not held out; repeated rows
give a row each; further columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyrisk.llm.common import held_in_worker, id_text

FIT_ROWS = 1500
FIT_CHARS = 20_000
MAX_GRAMS = 200_000
LEAST_GRAMS = 1000
TOGETHER = 6
SIDE_BY_SIDE = 256
PENALTY = 9.0
FLOOR = -5.0
SCRIPT_SHARE = 0.001
CACHE_WORDS = 300_000
UNKNOWN = "und"

_LETTERS = re.compile(r"[^\W\d_]+")

# First and last code point of the letters of each script (fixed values of the Unicode standard).
SCRIPTS = [
    ("latin", 0x0041, 0x024F), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x077F), ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF),
    ("gurmukhi", 0x0A00, 0x0A7F), ("gujarati", 0x0A80, 0x0AFF), ("tamil", 0x0B80, 0x0BFF), ("telugu", 0x0C00, 0x0C7F),
    ("kannada", 0x0C80, 0x0CFF), ("malayalam", 0x0D00, 0x0D7F), ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF),
    ("hangul", 0x1100, 0x11FF), ("ethiopic", 0x1200, 0x137F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF),
    ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
]
_STARTS = [s[1] for s in SCRIPTS]


def script_of(char: str) -> str:
    at = bisect_right(_STARTS, ord(char)) - 1
    return SCRIPTS[at][0] if at >= 0 and ord(char) <= SCRIPTS[at][2] else "other"


def words_of(text: str | None) -> list[str]:
    return _LETTERS.findall(text.lower()) if text else []


def _scored_words(text: str | None) -> list[str]:
    words = words_of(text)
    return words if all(map(str.isalpha, words)) else [w for w in words if any(map(str.isalpha, w))]


def grams_of(word: str) -> list[str]:
    marked = f"^{word}$"
    return [marked[i:i + 3] for i in range(len(word))]


@dataclass
class Model:
    langs: list[str]
    grams: dict[str, int]  # trigram -> row of logs; the last row is for any other
    logs: np.ndarray
    scripts: dict[str, list[bool]]  # script -> the languages that use it
    name: str = field(default_factory=lambda: uuid.uuid4().hex)


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def fit_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang, text`` of the bounded sample."""
    own = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    own = own.where(F.col("lang").isNotNull() & F.col("i").isNotNull() & F.col("text").isNotNull() & ~held_out("i"))
    own = own.withColumn("h", F.xxhash64(F.col("i").cast("string"))).withColumn("at", F.struct(F.length("text") > FIT_CHARS, "h"))
    # of a frequent language only a hash range that holds about four times the sample is ranked
    share = own.groupBy("lang").agg(F.count("*").alias("n")).select("lang", F.least(F.lit(1.0), 4.0 * FIT_ROWS / F.col("n")).alias("share"))
    few = own.select("lang", "h", "at").join(F.broadcast(share), "lang").where(F.col("h") <= F.lit(-2.0**63) + F.col("share") * 2.0**64)
    first = few.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("at"))).where(F.col("k") <= FIT_ROWS)
    upto = first.groupBy("lang").agg(F.max("at").alias("upto"), F.max("h").alias("range"))  # a row for each language
    return own.join(F.broadcast(upto), "lang").where((F.col("at") <= F.col("upto")) & (F.col("h") <= F.col("range"))).select("lang", "text")


def _counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    count: dict[tuple, int] = {}
    for f in frames:
        for lang, text in zip(f["lang"], f["text"], strict=True):
            for word in words_of(text):
                if word[0].isalpha():
                    for key in [(lang, "s", script_of(word[0])), *((lang, "g", g) for g in grams_of(word))]:
                        count[key] = count.get(key, 0) + 1
    yield pd.DataFrame([(*k, n) for k, n in count.items()], columns=["lang", "kind", "key", "n"])


def fit(docs: DataFrame, **cols) -> Model:
    counts = fit_rows(docs, **cols).mapInPandas(_counts, "lang string, kind string, key string, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    counts = counts.withColumn("k", F.row_number().over(Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "key")))
    names = F.broadcast(counts.agg(F.greatest(F.lit(LEAST_GRAMS), F.floor(MAX_GRAMS / F.greatest(F.lit(1), F.countDistinct("lang")))).alias("most")))
    rows = counts.join(names, (F.col("kind") == "s") | (F.col("k") <= F.col("most"))).orderBy("lang", "kind", "key").collect()
    langs = sorted({r.lang for r in rows})
    at = {x: i for i, x in enumerate(langs)}
    grams: dict[str, int] = {}
    for r in rows:
        if r.kind == "g":
            grams.setdefault(r.key, len(grams))
    n = np.zeros((len(grams) + 1, len(langs)))
    scripts: dict[str, np.ndarray] = {}
    for r in rows:
        if r.kind == "g":
            n[grams[r.key], at[r.lang]] += r.n
        else:
            scripts.setdefault(r.key, np.zeros(len(langs)))[at[r.lang]] += r.n
    logs = np.log((n + 0.5) / (n.sum(0) + 0.5 * (len(n) + 1))) if len(n) else n
    total = sum(scripts.values(), np.zeros(len(langs)))
    return Model(langs, grams, logs.astype(np.float32), {s: (x >= SCRIPT_SHARE * np.maximum(total, 1)).tolist() for s, x in scripts.items()})


def _constant(scores: np.ndarray, penalty: float) -> int | None:
    """The language of the whole text, if no path with a switch can be better."""
    best = int(scores.sum(0).argmax())
    gain = np.cumsum(scores - scores[:, best:best + 1], axis=0, dtype=np.float64)
    low = np.minimum(np.minimum.accumulate(gain, axis=0), 0)
    return best if float((gain - low).max()) <= penalty / 2 else None


def viterbi(scores: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The best language of each word (row of log posteriors); one constant path where that is best."""
    if not len(scores):
        return np.zeros(0, np.int16)
    best = _constant(scores, penalty)
    if best is not None:
        return np.full(len(scores), best, np.int16)
    n = scores.shape[1]
    back = np.empty(scores.shape, np.int16)
    now = scores[0].tolist()
    for i, row in enumerate(scores.tolist()):
        if i:
            top = max(range(n), key=now.__getitem__)
            other = now[top] - penalty
            back[i] = [l if now[l] >= other else top for l in range(n)]
            now = [max(now[l], other) + row[l] for l in range(n)]
    path = np.empty(len(scores), np.int16)
    path[-1] = max(range(n), key=now.__getitem__)
    for i in range(len(scores) - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def viterbi_of_all(lists: list[np.ndarray], penalty: float = PENALTY) -> list[np.ndarray]:
    """:func:`viterbi` of several texts: those that need steps make each step together, longest first; of the
    longest, which have nobody to step with, each goes alone."""
    out: list[np.ndarray | None] = [None] * len(lists)
    slow = []
    for i, scores in enumerate(lists):
        best = _constant(scores, penalty) if len(scores) else 0
        if best is None:
            slow.append(i)
        else:
            out[i] = np.full(len(scores), best, np.int16)
    slow.sort(key=lambda i: -len(lists[i]))
    alone = slow[:TOGETHER] if len(slow) > TOGETHER else slow
    for i in alone:
        out[i] = viterbi(lists[i], penalty)
    slow = slow[len(alone):]
    if not slow:
        return out
    size = np.array([len(lists[i]) for i in slow])
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    flat = np.concatenate([lists[i] for i in slow]).astype(np.float64)
    n = flat.shape[1]
    back, own = np.empty(flat.shape, np.int16), np.arange(n, dtype=np.int16)
    now = flat[begin]
    active = np.searchsorted(-size, -np.arange(size[0]), side="left")  # how many texts are longer than each place
    for t in range(1, size[0]):
        a = active[t]
        top = now[:a].argmax(1)
        other = (now[np.arange(a), top] - penalty)[:, None]
        stays = now[:a] >= other
        at = begin[:a] + t
        back[at] = np.where(stays, own, top[:, None])
        now[:a] = np.where(stays, now[:a], other) + flat[at]
    path = np.empty(len(flat), np.int16)
    last = now.argmax(1)
    path[begin + size - 1] = last
    for t in range(size[0] - 1, 0, -1):
        a = active[t]
        at = begin[:a] + t
        last[:a] = back[at, last[:a]]
        path[at - 1] = last[:a]
    for i, a, k in zip(slow, begin.tolist(), size.tolist(), strict=True):
        out[i] = path[a:a + k]
    return out


class Scorer:
    """Log posteriors of words, cached in each worker up to ``CACHE_WORDS``."""

    def __init__(self, model: Model):
        self.model = model
        self.row: dict[str, int] = {}
        self.table = np.zeros((CACHE_WORDS, len(model.langs)), np.float32)

    def add(self, words: list[str]) -> None:
        m = self.model
        if len(self.row) + len(words) > len(self.table):
            self.row = {}
            if len(words) > len(self.table):
                self.table = np.zeros((len(words), len(m.langs)), np.float32)
        other, codes, begins = len(m.grams), [], []
        get = m.grams.get
        for w in words:
            begins.append(len(codes))
            codes += [get(g, other) for g in grams_of(w)]
        score = np.add.reduceat(m.logs[codes], begins, axis=0)
        used = np.array([m.scripts.get(script_of(w[0]), [False] * len(m.langs)) for w in words])
        score[used.any(1)[:, None] & ~used] = -1e9
        score[~used.any(1)] = 0.0
        score -= score.max(1, keepdims=True)
        score = np.maximum(score - np.log(np.exp(score).sum(1, keepdims=True)), FLOOR)
        at = len(self.row)
        self.table[at:at + len(words)] = score
        self.row.update(zip(words, range(at, at + len(words)), strict=True))

    def scores(self, words: list[str]) -> np.ndarray:
        rows = list(map(self.row.get, words))
        if None in rows:
            new = list({w for w, r in zip(words, rows, strict=True) if r is None})
            kept = len(self.row)
            self.add(new)
            if len(self.row) < kept + len(new):  # the cache began anew
                self.add(list({w for w in words if w not in self.row}))
            rows = list(map(self.row.get, words))
        return self.table[rows]


def label(docs: DataFrame, model: Model, penalty: float = PENALTY, spans: bool = False, id_col: str = "doc_id", text_col: str = "text",
          keep: list[str] | None = None) -> DataFrame:
    """``doc_id, lang_pred, score`` and, if asked for, ``spans array<struct<from,to,lang>>`` (in words).
    ``keep``: further columns of ``docs`` to pass on, as ``kept`` (a struct), and the text with them."""
    frame = id_text(docs, id_col, text_col)
    if keep:
        frame = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.struct(*keep).alias("kept"))
    held = docs.sparkSession.sparkContext.broadcast(model)
    extra = [f for f in frame.schema.fields if keep and f.name in ("text", "kept")]
    span = T.ArrayType(T.StructType([T.StructField("from", T.IntegerType()), T.StructField("to", T.IntegerType()), T.StructField("lang", T.StringType())]))
    schema = T.StructType([frame.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                           *([T.StructField("spans", span)] if spans else []), *extra])
    arrow_span = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        scorer, none = held_in_worker("langid", m.name, lambda: Scorer(m)), np.zeros((0, max(1, len(m.langs))), np.float32)
        for batch in batches:
            lang, score, found = [], [], []
            texts = batch.column("text")
            for at in range(0, len(texts), SIDE_BY_SIDE):
                lists = [_scored_words(t) for t in texts[at:at + SIDE_BY_SIDE].to_pylist()] if m.langs else [[]] * len(texts[at:at + SIDE_BY_SIDE])
                for words, path in zip(lists, viterbi_of_all([scorer.scores(w) if w else none for w in lists], penalty), strict=True):
                    if not words:
                        lang.append(UNKNOWN)
                        score.append(0.0)
                        found.append([])
                        continue
                    n = np.bincount(path, minlength=len(m.langs))
                    lang.append(m.langs[int(n.argmax())])
                    score.append(float(n.max() / len(words)))
                    if spans:
                        cut = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
                        found.append([{"from": a, "to": b, "lang": m.langs[path[a]]} for a, b in zip(cut, cut[1:])])
            columns = [batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())]
            columns += [pa.array(found, arrow_span)] if spans else []
            columns += [batch.column(f.name) for f in extra]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return frame.mapInArrow(run, schema)


def predict(docs: DataFrame, **cols) -> DataFrame:
    """Fit on the labelled rows that are not held out, predict every row: ``doc_id, held_out, lang_pred, score``."""
    out = label(docs, fit(docs, **cols), id_col=cols.get("id_col", "doc_id"), text_col=cols.get("text_col", "text"))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def known_language(docs: DataFrame, min_score: float = 0.5, **cols) -> DataFrame:
    """The documents, with all their columns, whose text has a language for at least ``min_score`` of its words."""
    id_col, text_col = cols.get("id_col", "doc_id"), cols.get("text_col", "text")
    out = label(docs, fit(docs, **cols), id_col=id_col, text_col=text_col, keep=[c for c in docs.columns if c != text_col])
    known = out.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score))
    return known.select(*(F.col("text").cast(docs.schema[c].dataType).alias(c) if c == text_col else F.col("kept")[c].alias(c) for c in docs.columns))
