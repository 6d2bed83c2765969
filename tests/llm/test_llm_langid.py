"""Language ID: held-out accuracy, spans, and Viterbi against the plain recurrence."""

import random
import zlib

import numpy as np
from llm_fixtures import frame, rows_of

from skyrisk.llm import langid as L

SYLLABLES = {"aa": ["ka", "lo", "mi", "tu", "pe"], "bb": ["sch", "ung", "eit", "ver", "zu"], "cc": ["при", "ве", "то", "ка", "ни"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def rows(seed=1, n=240):
    rng = random.Random(seed)
    out = []
    for d in range(n):
        lang = rng.choice(list(SYLLABLES))
        out.append((d, text(rng, lang, rng.randrange(5, 60)), lang))
    out += [(1000, None, "aa"), (1001, "", "bb"), (1002, "123 !!! 45", "cc"), (1003, text(rng, "bb", 30), None), (None, text(rng, "aa", 30), "aa"),
            (1004, text(rng, "cc", 8000), "cc"), (5, out[5][1], out[5][2]), (1005, "中文字", None), (1006, text(rng, "aa", 40) + ". " + text(rng, "cc", 25), None)]
    return out


def table(spark, data):
    return frame(spark, data, "doc_id long, text string, lang string")


def test_held_out_accuracy_and_defined_cases(spark):
    data = rows()
    got = L.predict(table(spark, data)).collect()
    assert len(got) == len(data)
    by_id = {r.doc_id: r for r in got}
    for d, _, _ in data:
        assert by_id[d].held_out == (d is not None and zlib.crc32(str(d).encode()) % 4 == 2)
    truth = {d: lang for d, t, lang in data if lang and t and any(map(str.isalpha, t))}
    right = [by_id[d].lang_pred == lang for d, lang in truth.items() if by_id[d].held_out]
    assert len(right) > 30 and sum(right) / len(right) > 0.95
    for d in (1000, 1001, 1002):
        assert (by_id[d].lang_pred, by_id[d].score) == ("und", 0.0)
    assert by_id[1003].lang_pred == "bb" and by_id[None].lang_pred == "aa" and by_id[1005].lang_pred in SYLLABLES
    assert all(0 <= r.score <= 1 for r in got)


def test_held_out_labels_are_not_learned(spark):
    data = rows()
    wrong = [(d, t, "zz" if d is not None and zlib.crc32(str(d).encode()) % 4 == 2 else lang) for d, t, lang in data]
    assert rows_of(L.predict(table(spark, wrong)), "doc_id", "lang_pred", "score") == rows_of(L.predict(table(spark, data)), "doc_id", "lang_pred", "score")


def test_mixed_text_has_spans_and_scripts_narrow(spark):
    docs = table(spark, rows())
    model = L.fit(docs)
    assert model.scripts["cyrillic"] == [lang == "cc" for lang in model.langs]
    row = L.label(docs.where("doc_id = 1006"), model, spans=True).first()
    assert [(s["from"], s["to"], s["lang"]) for s in row.spans] == [(0, 40, "aa"), (40, 65, "cc")]
    assert row.lang_pred == "aa" and abs(row.score - 40 / 65) < 1e-9


def test_filter_keeps_columns_and_clean_documents(spark):
    docs = table(spark, rows())
    kept = L.known_language(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept.collect()} == {1000, 1001, 1002}


def test_nothing_to_learn_from(spark):
    assert L.predict(table(spark, [])).count() == 0
    assert rows_of(L.predict(table(spark, [(1, "some text", None)])), "lang_pred", "score") == [("und", 0.0)]


def test_viterbi_is_optimal():
    rng = np.random.default_rng(1)

    def value(scores, path, penalty):
        return scores[np.arange(len(path)), path].sum() - penalty * (np.diff(path) != 0).sum()

    for _ in range(300):
        n, k = int(rng.integers(1, 8)), int(rng.integers(1, 4))
        scores, penalty = rng.normal(size=(n, k)) * 3, float(rng.random() * 6)
        best = max(value(scores, np.array(p), penalty) for p in np.ndindex(*(k,) * n))
        assert abs(value(scores, L.viterbi(scores, penalty).astype(int), penalty) - best) < 1e-9


def test_texts_side_by_side_give_the_same_paths():
    rng = np.random.default_rng(2)
    for n in (1, 2, 5, 200):
        lists = [np.maximum(rng.normal(size=(int(k), n)).astype(np.float32) * 3, -5) for k in rng.integers(0, 60, size=40)] + [np.zeros((300, n), np.float32)]
        for penalty in (0.5, 3.0, 9.0):
            for a, b in zip(L.viterbi_of_all(lists, penalty), (L.viterbi(x, penalty) for x in lists), strict=True):
                assert a.dtype == b.dtype and (a == b).all()


def test_many_languages_and_long_texts_only(spark, monkeypatch):
    """150 languages with words of their own, one of them with long texts only, one far more frequent than all others."""
    monkeypatch.setattr(L, "FIT_CHARS", 400)
    monkeypatch.setattr(L, "MAX_GRAMS", 3000)
    monkeypatch.setattr(L, "LEAST_GRAMS", 20)
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = {f"l{k:03d}": ["".join(rng.choices(letters, k=6)) for _ in range(4)] for k in range(150)}
    data = []
    for k, lang in enumerate(words):
        for _ in range(60 if k == 0 else 8):
            n = 200 if k == 149 else rng.randrange(8, 20)
            data.append((len(data), " ".join(rng.choices(words[lang], k=n)), lang))
    held = [(d, lang) for d, _, lang in data if zlib.crc32(str(d).encode()) % 4 == 2]
    got = {r.doc_id: r.lang_pred for r in L.predict(table(spark, data)).collect()}
    assert np.mean([got[d] == lang for d, lang in held]) > 0.95
    assert all(got[d] == "l149" for d, lang in held if lang == "l149")


def test_share_of_words_decides_what_the_pipeline_keeps(spark):
    """Against counting by hand: the label of most words and its share, from each word's own path."""
    data = rows()
    docs = table(spark, data)
    model = L.fit(docs)
    scorer = L.Scorer(model)
    want = set()
    for d, text, _ in data:
        words = L.words_of(text)
        if words:
            path = L.viterbi(scorer.scores(words)).tolist()
            if max(path.count(k) for k in set(path)) >= 0.5 * len(path):
                want.add(d)
    assert {r.doc_id for r in L.known_language(docs).collect()} == want
