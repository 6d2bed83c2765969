"""Toxicity: the kernel against plain enumeration, held-out accuracy, hidden insults, and the defined cases."""

import random
import zlib
from itertools import combinations

import numpy as np
import pytest
from llm_fixtures import frame, rows_of

from skyrisk.llm import toxicity as X

SYLLABLES = ["ka", "lo", "mi", "tu", "pe", "ran", "sel", "vo", "din", "gar", "the", "is"]
STEMS = ["grobbut", "snivler", "wretzch", "foulox"]


def word(rng):
    return "".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 5)))


def clean(rng, n):
    return " ".join(word(rng) + rng.choice(["", "", "", ".", ",", "!\n"]) for _ in range(n))


def toxic(rng, n):
    words = clean(rng, n).split(" ")
    for _ in range(rng.randrange(2, 5)):
        words.insert(rng.randrange(len(words)), rng.choice(STEMS) + rng.choice(["", "", "s", "ka", "lo"]))
    return " ".join(words)


def data(seed=1, n=400):
    rng = random.Random(seed)
    rows, labels = [], []
    for d in range(n):
        bad = d % 4 == 0
        rows.append((d, toxic(rng, rng.randrange(10, 60)) if bad else clean(rng, rng.randrange(10, 60))))
        if d % 7:
            labels.append((d, int(bad)))
    return rows, labels


def tables(spark, rows, labels):
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int").selectExpr("*", "'x' AS text", "1 AS label", "2 AS h").repartition(3)


@pytest.fixture(scope="module")
def fitted(spark):
    rows, labels = data()
    docs, known = tables(spark, rows, labels)
    return X.fit(docs, known)


def test_kernel_equals_enumeration():
    rng = random.Random(4)
    strings = ["\x02" + "".join(rng.choices("abcé", k=rng.randrange(0, 9))) + "\x03" for _ in range(40)]

    def features(s):
        out = {}
        for i, j, k in combinations(range(len(s)), 3):
            out[s[i] + s[j] + s[k]] = out.get(s[i] + s[j] + s[k], 0.0) + X.DECAY ** (k - i - 2)
        return out

    def kernel(a, b):
        x, y = features(a), features(b)
        dot = lambda p, q: sum(v * q.get(u, 0.0) for u, v in p.items())
        return dot(x, y) / (dot(x, x) * dot(y, y)) ** 0.5 if x and y else 0.0

    got = X.Landmarks(strings[:15]).kernel(strings)
    assert np.allclose(got, [[kernel(a, b) for b in strings[:15]] for a in strings], atol=1e-12)


def test_folded_weights_give_the_expansion():
    rng = random.Random(5)
    positive = [f"\x02{s}{e}\x03" for s in STEMS for e in ("", "s", "ka")]
    negative = ["\x02" + word(rng) + "\x03" for _ in range(60)]
    model = X.machine(positive, negative)
    marks = X.Landmarks(positive + negative)
    margin = model.margins(positive + negative) + model.bias
    assert (margin[:len(positive)] > 0).all() and (margin[len(positive):] < 0).mean() > 0.95
    assert np.allclose(np.diag(marks.kernel(positive + negative)), 1)


def test_held_out_accuracy(spark):
    rows, labels = data()
    docs, known = tables(spark, rows, labels)
    got = {r.doc_id: r for r in X.predict(docs, known).collect()}
    assert len(got) == len(rows)
    for d, r in got.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [(got[d].predicted, y) for d, y in labels if got[d].held_out]
    assert len(held) > 40 and np.mean([p == y for p, y in held]) > 0.95
    assert np.mean([got[d].predicted == (d % 4 == 0) for d in got if d % 7 == 0]) > 0.95  # never labelled


def test_held_out_labels_are_not_learned(spark):
    rows, labels = data()
    wrong = [(d, 1 - y if zlib.crc32(str(d).encode()) % 5 == 0 else y) for d, y in labels]
    docs, _ = tables(spark, rows, labels)
    a, b = (rows_of(X.predict(docs, tables(spark, rows[:1], x)[1]), "doc_id", "score") for x in (labels, wrong))
    assert [x[0] for x in a] == [x[0] for x in b] and np.allclose([x[1] for x in a], [x[1] for x in b], atol=1e-9)


HIDDEN = ["grobbut", "GROBBUT!!", "g.r.o.b.b.u.t", "grob-but", "g r o b b u t", "grobxbut", "gr*obbut", "snivvler", "wretzchvo", "(foulox)", "foul.ox, mi"]


def test_hidden_insults_are_caught_and_clean_words_are_not(spark, fitted):
    rng = random.Random(9)
    rows = [(i, f"{clean(rng, 30)} {w} {clean(rng, 30)}") for i, w in enumerate(HIDDEN)] + [(100 + i, clean(rng, 200)) for i in range(60)]
    got = {r.doc_id: r.score for r in X.score_texts(frame(spark, rows), fitted).collect()}
    assert [HIDDEN[i] for i in range(len(HIDDEN)) if got[i] < 0.5] == []
    assert np.mean([got[100 + i] < 0.5 for i in range(60)]) > 0.95


def test_whole_texts_count_and_sentences_are_named(spark, fitted):
    rng = random.Random(10)
    long = clean(rng, 20_000)
    rows = [(1, long), (2, long + " grobbut"), (3, "x" * 5000 + "grobbut" + "x" * 5000), (4, "lo mi. tu grobbut pe! ka ran\nsel")]
    got = {r.doc_id: (r.score, r.word) for r in X.score_texts(frame(spark, rows), fitted).collect()}
    assert got[2][0] >= 0.5 and got[2][1] == "grobbut" and got[2][0] > got[1][0]
    assert got[3][0] > got[1][0] or got[3][0] >= 0.3
    parts = sorted((r.at, r.sentence, r.score >= 0.5) for r in X.score_sentences(frame(spark, rows[3:]), fitted).collect())
    assert parts == [(0, "lo mi.", False), (1, " tu grobbut pe!", True), (2, " ka ran\n", False), (3, "sel", False)]


def test_defined_cases(spark):
    rows, labels = data(2, 200)
    extra = [(1000, None), (1001, ""), (1002, " .,! "), (None, "grobbut"), rows[8], rows[8], (1003, "a"), (1004, "İ\u0000 ß")]
    docs, known = tables(spark, rows + extra, [*labels, (None, 1), (1001, 1), (1000, 1), (labels[0][0], 0), (5, None)])
    got = X.predict(docs, known).collect()
    assert len(got) == len(rows) + len(extra)
    by = {r.doc_id: r for r in got}
    assert all(by[d].score == 0 and by[d].predicted == 0 for d in (1000, 1001, 1002))
    assert by[None].held_out is False and by[None].predicted == 1
    assert len({r.score for r in got if r.doc_id == rows[8][0]}) == 1


def test_without_both_labels_every_score_is_zero(spark):
    rows, _ = data(3, 30)
    for labels in ([], [(d, 0) for d, _ in rows], [(d, 1) for d, _ in rows], [(d, None) for d, _ in rows]):
        assert {(r.score, r.predicted) for r in X.predict(*tables(spark, rows, labels)).collect()} == {(0.0, 0)}
    assert X.predict(*tables(spark, [], [(1, 1), (2, 0)])).collect() == []
