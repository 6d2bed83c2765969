"""Collocations against counting every phrase in a dictionary, with prefixes extended at every depth."""

import random
from collections import Counter

import pytest
from llm_fixtures import corpus, frame

from skyrisk.llm import collocations as C

SCHEMA = "doc_id long, text string, lang string"


def brute(rows, max_words=3, least=10, percent=50, top=2000):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        for c in ".,;:!?\n\x0b\x0c\r":
            low = low.replace(c, "\n")
        for piece in low.split("\n"):
            words = tuple(w for w in piece.replace("\t", " ").split(" ") if w)
            n[lang] += len(words)
            for m in range(1, max_words + 1):
                for i in range(len(words) - m + 1):
                    f[lang, words[i:i + m]] += 1
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    gone = {(lang, w[i:i + m]) for (lang, w), a in cand.items() for m in range(2, len(w)) for i in range(len(w) - m + 1)
            if 100 * a >= percent * f[lang, w[i:i + m]]}
    out = []
    for lang in sorted(n):
        best = []
        for (x, w), a in cand.items():
            if x == lang and (x, w) not in gone:
                score, _, left, right = min((1_000_000 * a * a // (f[x, w[:k]] * f[x, w[k:]]), k, f[x, w[:k]], f[x, w[k:]]) for k in range(1, len(w)))
                best.append((-score, -a, " ".join(w).encode(), left, right))
        out += [(lang, r, p.decode(), -a, left, right, n[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(best)[:top], 1)]
    return out


def rows(seed=2):
    rng = random.Random(seed)
    out = [(d, t, rng.choice(["aa", "bb", None])) for d, t in corpus()]
    vocab = ["the", "of", "and", "New", "york", "São", "paulo", "x", " y", "z "]
    for d in range(60):
        text = "".join(rng.choices(vocab, [9, 7, 5, 3, 3, 2, 2, 1, 1, 1])[0] + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r", "\x0b", ";", " : "]) for _ in range(200))
        out.append((5000 + d, text, rng.choice(["aa", "cc", "und", None])))
    out.append((9000, "of the " * 9000 + "the the " * 3000, "aa"))  # very long, and most of all words
    return out


COLS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def got(df):
    return sorted(tuple(r[c] for c in COLS) for r in df.collect())


@pytest.mark.parametrize(("budget", "tokens"), [(2_000_000, 2_000_000), (400, 700), (64, 50)])
def test_equals_brute_force(spark, monkeypatch, budget, tokens):
    monkeypatch.setattr(C, "TASK_TOKENS", tokens)  # the driver's value; tasks fork from it or keep their own
    data = rows()
    want = brute(data)
    assert len(want) > 50
    assert got(C.collocations(frame(spark, data, SCHEMA), budget=budget)) == sorted(want)


def test_other_parameters(spark):
    data = rows(3)
    table = frame(spark, data, SCHEMA)
    assert got(C.collocations(table, max_words=4, min_count=3, cover_percent=80, top=7, budget=500)) == sorted(brute(data, 4, 3, 80, 7))
    assert got(C.collocations(table, max_words=2, min_count=20, budget=500)) == sorted(brute(data, 2, 20))


def test_texts_longer_than_a_buffer_are_cut_without_loss(monkeypatch):
    monkeypatch.setattr(C, "TASK_TOKENS", 10)
    import pyarrow as pa

    rng = random.Random(1)
    texts = [" ".join(rng.choices(["a", "b", "c", "."], k=n)) for n in (0, 1, 9, 10, 11, 12, 13, 20, 21, 57)]
    batch = pa.RecordBatch.from_pydict({"lang": ["x"] * len(texts), "text": texts})
    for depth in (1, 2, 3):
        n = Counter()
        for _, names, numbers, starts in C._buffered(iter([batch]), depth):
            cols, weights = C._suffixes(numbers, starts, len(names), depth)
            for c, w in zip(cols.T.tolist(), weights.tolist(), strict=True):
                n[tuple(names[i] for i in c if i)] += w
        want = Counter()
        for t in texts:
            for piece in t.split("."):
                w = piece.encode().split()
                want.update(tuple(w[i:i + depth]) for i in range(len(w)))
        assert n == want


def test_products_pass_64_bits(spark):
    cut = spark.sql("SELECT 4000000000000 AS a, 4000000000000 AS l, 8000000000000 AS r")
    wide = "cast(1000000 as decimal(7, 0)) * cast(a as decimal(15, 0)) * cast(a as decimal(15, 0))"
    assert cut.selectExpr(f"({wide}) div (cast(l as decimal(15, 0)) * cast(r as decimal(15, 0))) AS s").first().s == 500_000


def test_empty_tables_and_texts(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert C.collocations(empty).collect() == []
    assert C.collocations(frame(spark, [(1, None, "aa"), (2, "", None), (3, " .,; ", "bb"), (4, "one two", "bb")], SCHEMA)).collect() == []


def test_extended_prefixes_are_dealt_over_groups():
    plan = C.Plan([{("aa", b"of")}, {("aa", b"of", b"the")}], 50)
    names = [b".", b"of", b"the", b"cat", b"dog"]
    import numpy as np

    cols = np.array([[1, 1, 1, 1, 2, 2], [0, 2, 2, 2, 3, 3], [0, 0, 3, 4, 0, 4]])
    group = C._groups(plan, "aa", names, cols)
    assert group[0] == group[1] == -1  # these end with an extended prefix, which is counted apart
    assert group[2] != group[3] and group[4] == group[5] == plan.group("aa", (b"the",))
