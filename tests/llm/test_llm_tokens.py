"""Token ids, the grammar-compressed files and the packing, held against the tokenizer library."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_fixtures import corpus, frame, ordered, rows_of

from skyrisk.llm import packing, repair
from skyrisk.llm.common import scratch
from skyrisk.llm.tokens import TextEncoder, tokenizer_file


@pytest.fixture(scope="module")
def enc():
    with open(tokenizer_file(), encoding="utf-8") as f:
        return TextEncoder(f.read())


def library(enc, text):
    return list(enc.whole.encode(text, add_special_tokens=False).ids) if text else []


def test_cached_words_give_the_library_ids(enc):
    rng = random.Random(1)
    parts = ["a", "word", "Über", "né", " ", "  ", "\n", "\n\n", "\t", ".", ",", "'s", "don't", "x1", "42", "!!", "日本", " ", "\x1c", "<|endoftext|>", "ª", "²",
             " \n", "\r\n", "end.", "—", "café,", "The", "the", "A", "b.c", " ", "é"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(12)))
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == library(enc, text), repr(text)


def test_words_before_marks_are_cut_off(monkeypatch):
    """A word and the marks after it are encoded by parts; the marks once."""
    with open(tokenizer_file(), encoding="utf-8") as f:
        enc = TextEncoder(f.read())
    whole, plain = [], enc.plain
    monkeypatch.setattr(enc, "plain", lambda text: whole.append(text) or plain(text))
    text = "start " + " ".join(f"{w}{m}" for m in ("%%%", "###", ",$$$", ".") for w in ("one", "réé", "Über", "oui"))
    assert np.frombuffer(enc.encode(text), "<u4").tolist() == library(enc, text)
    assert whole == ["%%%", "###", ",$$$", "."]  # sixteen words with their marks before


def test_generations_of_the_cache(enc, monkeypatch):
    from skyrisk.llm import tokens

    monkeypatch.setattr(tokens, "CACHE_WORDS", 3)
    for _ in range(3):
        for text in ("one two three, four five", "six seven\neight one two", "Nine ten, one"):
            assert np.frombuffer(enc.encode(text), "<u4").tolist() == library(enc, text)


def test_grammar_round_trip():
    rng = np.random.default_rng(1)
    for n, top in ((1, 1), (5, 3), (3000, 2), (20_000, 7), (20_000, 60_000), (5000, 1)):
        ids = rng.integers(0, top, n).astype(np.uint32)
        cut = np.unique(np.append(rng.integers(1, n + 1, 9), n))
        lengths = np.diff(cut, prepend=0)
        shard = repair.Shard(repair.compress(ids, lengths))
        assert (shard.expand(shard.symbols) == ids).all() and shard.doc_ids.tolist() == lengths.tolist()
        for k in range(len(lengths)):  # random access to one document
            assert (shard.document(k) == ids[cut[k] - lengths[k]:cut[k]]).all()
    same = np.full(50_000, 70_000, np.uint32)
    assert len(repair.compress(same, np.array([50_000]))) < 10_000
    with pytest.raises(ValueError):
        repair.Shard(b"something else....................")


def test_files_hold_every_document(spark, enc, monkeypatch):
    monkeypatch.setattr(repair, "SHARD_IDS", 4000)
    rows = corpus(n=15)
    path = scratch(spark, "tokens-test")
    repair.write_tokens(frame(spark, rows), path)
    got = [tuple(r) for r in repair.read_tokens(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("start").collect()]
    at, want = 0, []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array([*library(enc, t), 0], "<u4")
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want


def test_packing_places_every_id_once(spark, enc):
    rows = corpus(n=60)
    got = [r.asDict() for r in packing.pack(frame(spark, rows)).collect()]
    want = []
    for d, t in rows:
        ids = np.array([*library(enc, t), 0], "<u4")
        first = len(ids) % 2048 or 2048
        for k, a in enumerate([0, *range(first, len(ids), 2048)]):
            part = ids[a:first if a == 0 else a + 2048]
            want.append((d, k, a, len(part), zlib.crc32(part.tobytes())))
    assert ordered([tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in got]) == ordered(want)
    held = {}
    for r in got:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in held.values():  # gapless from 0
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(held) <= -(-sum(r["length"] for r in got) // 2048) + 1


def test_rounds_end_where_nothing_fits(spark, monkeypatch):
    """Only pieces of over half a sequence: bins can't merge, and the rounds stop."""
    monkeypatch.setattr(packing, "TASK_ITEMS", 50)
    items = spark.range(400).selectExpr("id AS item", "1100L + id % 500 AS length").repartition(16)
    done, _ = packing.pack_bins(items)
    assert sum(d.count() for d in done) == 400


def test_best_fit_takes_the_fullest_bin():
    assert sorted(map(sorted, packing.best_fit([5, 6, 4, 3, 2], 10))) == [[0, 3, 4], [1, 2]]
    rng = random.Random(3)
    sizes = [rng.randrange(1, 100) for _ in range(500)]
    bins = packing.best_fit(sizes, 100)
    assert sorted(i for b in bins for i in b) == list(range(500)) and max(sum(sizes[i] for i in b) for b in bins) <= 100


@pytest.mark.parametrize("operator", [packing.pack, repair.encoded])
def test_empty_table(spark, operator):
    assert operator(frame(spark, [])).count() == 0
    assert rows_of(operator(frame(spark, [(1, None)])), "doc_id", "start") == [(1, 0)]


def test_no_frequent_pair_is_left():
    n = 12_000  # more pairs than five rounds take, and enough that two share a hashed cell
    first = np.tile(np.arange(1, n + 1, dtype=np.uint32), repair.MIN_COUNT)
    ids = np.stack([first, first + n], 1).ravel()
    shard = repair.Shard(repair.compress(ids, np.full(len(first), 2)))
    assert len(shard.size) == n and len(shard.symbols) == len(first)
    assert (shard.expand(shard.symbols) == ids).all()
    runs = np.random.default_rng(2).integers(0, 3, 5000).astype(np.uint32)
    shard = repair.Shard(repair.compress(runs, np.array([1, 1999, 3000])))
    assert (shard.expand(shard.symbols) == runs).all()
    within = np.ones(len(shard.symbols), bool)
    within[shard.ends - 1] = False
    left = np.flatnonzero(within)
    assert np.unique(shard.symbols[left].astype(np.int64) << 32 | shard.symbols[left + 1], return_counts=True)[1].max(initial=0) < repair.MIN_COUNT


def _grammar_by_full_counts(ids, doc_lengths):
    """Rules and symbols by a full count of all pairs in each round, in plain Python."""
    docs, at, rules = [], 0, []
    for n in doc_lengths:
        docs.append(ids[at:at + n].tolist())
        at += n
    base = int(ids.max()) + 1
    while True:
        count = Counter(p for d in docs for p in zip(d, d[1:]))
        top = sorted((p for p in count if count[p] >= repair.MIN_COUNT), key=lambda p: (-count[p], p))[:repair.ROUND_RULES]
        if not top:
            return rules, [s for d in docs for s in d]
        name = {p: base + len(rules) + k for k, p in enumerate(sorted(top))}
        rules += sorted(top)
        for k, d in enumerate(docs):
            hit = [p in name for p in zip(d, d[1:])]
            i, out = 0, []
            while i < len(d):
                if i < len(hit) and hit[i]:
                    out.append(name[d[i], d[i + 1]])
                    i += 2
                else:
                    out.append(d[i])
                    i += 1
            docs[k] = out


@pytest.mark.parametrize("rules", [3, 2048])
def test_rounds_count_only_what_changed(monkeypatch, rules):
    """The grammar of full counts, but after the first round only replaced places and their neighbours are looked at."""
    monkeypatch.setattr(repair, "ROUND_RULES", rules)
    looked = []
    whole = repair._occurrences
    monkeypatch.setattr(repair, "_occurrences", lambda sym, nxt, at: looked.append(len(at)) or whole(sym, nxt, at))
    rng = np.random.default_rng(4)
    for top, scale in ((2, 1), (9, 1), (60, 1), (5, 1 << 29)):
        ids = (rng.zipf(1.4, 6000) % top * scale).astype(np.uint32)
        cut = np.unique(np.append(rng.integers(1, 6001, 20), 6000))
        lengths = np.diff(cut, prepend=0)
        looked.clear()
        shard = repair.Shard(repair.compress(ids, lengths))
        want = _grammar_by_full_counts(ids, lengths)
        assert len(shard.size) == len(want[0]) and shard.symbols.tolist() == want[1]
        assert (shard.expand(shard.symbols) == ids).all()
        assert looked[0] == 6000 - len(lengths) and sum(looked[1:]) < 3 * 6000
