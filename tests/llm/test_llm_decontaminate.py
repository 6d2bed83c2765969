"""The item automaton against a brute-force window search."""

import hashlib
import random
import re

from llm_fixtures import corpus, frame, ordered, rows_of

from skyrisk.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items, n=10):
    windows = []
    for k, t in set(items):
        ws = split(t)
        size = min(n, len(ws))
        windows += [(k, ws[i:i + size]) for i in range(len(ws) - size + 1)] if ws else []
    out = []
    for d, t in rows:
        ws = split(t)
        hit, found = set(), set()
        for k, w in windows:
            for i in range(len(ws) - len(w) + 1):
                if ws[i:i + len(w)] == w:
                    hit.update(range(i, i + len(w)))
                    found.add(k)
        names = sorted(str(k) for k in found if k is not None)
        out.append((d, len(ws), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return ordered(out)


def items_for(rows):
    rng = random.Random(5)
    texts = [t for _, t in rows if t and len(t.split()) > 40]
    cut = lambda t, n: " ".join(t.split()[(a := rng.randrange(len(t.split()) - n)):a + n])
    items = [(k, cut(rng.choice(texts), n)) for k, n in enumerate([30, 12, 10, 9, 3, 2, 1, 40, 25, 25])]
    items += [(20, None), (21, ""), (22, "!!"), (None, cut(texts[0], 15)), items[0], (23, items[0][1]), (24, items[0][1].upper()), (25, items[3][1] + " zz " + items[4][1])]
    return items


def test_matches_brute_force(spark):
    rows = [r for r in corpus() if r[1] is None or len(r[1]) < 20_000]
    items = items_for(rows)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = rows_of(D.digest(D.find_overlap(frame(spark, rows), bench)), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == brute(rows, items)
    assert sum(r[2] for r in got) > 100


def test_blocks_give_the_same(spark, monkeypatch):
    rows = [r for r in corpus() if r[1] is None or len(r[1]) < 3_000]
    items = items_for(rows)
    monkeypatch.setattr(D, "BLOCK_WORDS", 60)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = rows_of(D.digest(D.find_overlap(frame(spark, rows), bench)), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == brute(rows, items)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert rows_of(D.digest(D.find_overlap(frame(spark, [(1, "a b"), (2, None)]), none)), "doc_id", "n_hit", "contaminated") == [(1, 0, False), (2, 0, False)]
    assert D.decontaminate(frame(spark, []), none).count() == 0


def test_cut_text_and_coverage(spark):
    item = " ".join(f"q{i}" for i in range(12))
    docs = [(1, f"Before, it: {item.upper()}! After."), (2, "clean  text\nstays"), (3, None), (4, "x " + " ".join(f"y{i}" for i in range(30)) + " " + item + "; end")]
    out = D.decontaminate(frame(spark, docs), spark.createDataFrame([(1, item)], "item_id long, text string"))
    want = [(2, "clean  text\nstays"), (3, None), (4, "x " + " ".join(f"y{i}" for i in range(30)) + " ; end")]
    assert rows_of(out, "doc_id", "text") == ordered(want)  # 1 is the item for more than half


def test_longest_match():
    auto = D.ItemAutomaton([b"a b c d e f".split(), b"c d x".split(), b"d e f g h i j k l m".split()], 5)
    spans, items, longest = auto.scan(b"z a b c d e q c d x d e f g h i z".split())
    assert spans == [(1, 6), (7, 10), (10, 16)] or spans == [(1, 6), (7, 16)]
    assert items == {0, 1, 2} and longest == 6
