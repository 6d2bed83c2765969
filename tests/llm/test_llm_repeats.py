"""Both substring operators against a brute-force version."""

import hashlib

import numpy as np
import pytest
from llm_fixtures import corpus, frame, ordered, rows_of

from skyrisk.llm import fmindex, repeats, sparse_suffix

OPERATORS = [fmindex.substring_dedup, sparse_suffix.suffix_array_dedup]


def brute(rows, n=50):
    split = [(d, t.encode().split() if t else []) for d, t in rows]
    least = {}
    for d, ws in split:
        if d is not None:
            for i in range(len(ws) - n + 1):
                w = tuple(ws[i:i + n])
                least[w] = min(d, least.get(w, d))
    out = []
    for d, ws in split:
        gone = set()
        if d is not None:
            for i in range(len(ws) - n + 1):
                if least[tuple(ws[i:i + n])] < d:
                    gone.update(range(i, i + n))
        kept = b" ".join(w for i, w in enumerate(ws) if i not in gone)
        out.append((d, len(ws), len(gone), hashlib.sha256(kept).hexdigest()))
    return ordered(out)


@pytest.mark.parametrize("operator", OPERATORS)
@pytest.mark.parametrize("hot", [2_000, 2])
def test_matches_brute_force(spark, operator, hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", hot)  # 2: nearly every shared passage takes the way of the hot ones
    rows = corpus()
    got = rows_of(repeats.digest(operator(frame(spark, rows))), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == brute(rows)
    assert sum(r[2] for r in got) > 1000


@pytest.mark.parametrize("operator", OPERATORS)
def test_empty_table(spark, operator):
    assert operator(frame(spark, [])).count() == 0
    assert operator(frame(spark, [(1, None), (None, "a")])).count() == 2


def test_one_hot_passage_in_many_surroundings(spark):
    """A third of all documents share a passage; the hot anchor is split and nothing is lost."""
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(d, f"a{d} b{d} {passage} c{d} d{d}" if d % 3 == 0 else " ".join(f"u{d}x{i}" for i in range(60))) for d in range(300)]
    repeats_hot, repeats.HOT = repeats.HOT, 50
    try:
        got = rows_of(fmindex.substring_dedup(frame(spark, rows)), "doc_id", "n_removed")
    finally:
        repeats.HOT = repeats_hot
    assert got == ordered([(d, 60 if d % 3 == 0 and d else 0) for d in range(300)])


def test_kernels_agree_on_random_segments():
    rng = np.random.default_rng(3)
    base = rng.integers(1, 4, 400)
    # all segments hold word 100 of the base, their anchor
    texts = [base[max(0, 100 - int(x)):100 - int(x) + 49 + int(x) + 1].copy() for x in rng.integers(0, 25, 60)]
    anchors = np.array([100 - max(0, 100 - (len(t) - 50)) for t in texts])
    ids = rng.integers(0, 30, len(texts))
    one, two = fmindex.smallest_ids(texts, anchors, ids), sparse_suffix.smallest_ids(texts, anchors, ids)
    least = {}
    for t, d in zip(texts, ids):
        for i in range(len(t) - 49):
            w = tuple(t[i:i + 50])
            least[w] = min(least.get(w, 99), d)
    for t, x, y in zip(texts, one, two):
        want = [least[tuple(t[i:i + 50])] for i in range(len(t) - 49)]
        assert x.tolist() == want and y.tolist() == want


def test_wavelet_matrix_rank():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 37, 1000)
    wm = fmindex.WaveletMatrix(values, 6)
    symbol, at = rng.integers(0, 37, 500), rng.integers(0, 1001, 500)
    assert wm.rank(symbol, at).tolist() == [int((values[:i] == s).sum()) for s, i in zip(symbol, at)]
