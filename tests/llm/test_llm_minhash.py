"""DartMinHash and the near-duplicate classes against brute force."""

from collections import Counter

import numpy as np
from llm_fixtures import corpus, frame, ordered, rows_of

from skyrisk.llm import minhash as M


def brute(rows):
    def bag(t):
        ws = t.encode().lower().split() if t else []
        n = min(5, len(ws))
        return Counter(tuple(ws[i:i + n]) for i in range(len(ws) - n + 1)) if ws else None

    bags = [bag(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(bags):
        for j in range(i):
            b = bags[j]
            if a and b and sum((a & b).values()) * 5 >= sum((a | b).values()) * 4:
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    out = []
    for own in groups.values():
        ids = [rows[i][0] for i in own if rows[i][0] is not None]
        out += [(rows[i][0], min(ids) if ids else None, len(own)) for i in own]
    return ordered(out)


def test_classes_match_brute_force(spark):
    rows = corpus()
    got = rows_of(M.near_duplicates(frame(spark, rows)), "doc_id", "class_id", "class_docs")
    assert got == brute(rows)


def test_chain_of_near_copies_is_one_class(spark):
    """Each is like the next one only: links between different texts make one class."""
    base = [f"w{i}" for i in range(300)]
    rows = []
    for d in range(30):
        for k in range(4):
            base[(d * 17 + k * 5) % 300] = f"x{d}y{k}"
        rows.append((d, " ".join(base)))
    rows += [(100 + d, " ".join(f"u{d}z{i}" for i in range(100))) for d in range(20)]
    got = rows_of(M.near_duplicates(frame(spark, rows)), "doc_id", "class_id", "class_docs")
    assert got == brute(rows)


def test_links_in_a_large_bucket_of_texts_below_the_bound(spark):
    """1,200 form letters alike at 83/105 = 0.79 fill the buckets; 25 pairs share one word more, 84/104 = 0.81."""
    form = " ".join(f"t{i}" for i in range(87))
    rows = [(d, f"{form} " + " ".join(f"o{d}x{i}" for i in range(11))) for d in range(1200)]
    rows += [(5000 + d, f"{form} o{d}x0 " + " ".join(f"p{d}x{i}" for i in range(10))) for d in range(25)]
    got = rows_of(M.near_duplicates(frame(spark, rows)), "doc_id", "class_id", "class_docs")
    assert got == ordered([(d, d % 5000, 2 if d % 5000 < 25 else 1) for d, _ in rows])


def test_prefixes_leave_out_no_pair(spark):
    """Texts that share only a part of a form, with repeated words: brute force against the join alone."""
    rng = np.random.default_rng(3)
    form = [f"t{i % 70}" for i in range(90)]
    rows = [(d, " ".join(w for w in form if rng.random() > 0.01 * (d % 9)) + " " + " ".join(f"o{d}x{i}" for i in range(rng.integers(0, 14)))) for d in range(60)]
    texts = spark.createDataFrame([(str(d).encode(), t.encode(), str(d).encode()) for d, t in rows], "node binary, words binary, comp binary")
    found = {frozenset((int(r.a), int(r.b))) for r in M._alike(texts).collect()}
    bags = {d: M.Shingler().shingles(t.encode().split()) for d, t in rows}
    want = {frozenset((a, b)) for a in bags for b in range(a) if M.similar(bags[a], bags[b])}
    assert want and want <= found and len(found) < 60 * 59 / 2


def test_first_of_class_keeps_columns_and_clean_rows(spark):
    rows = corpus(n=12)
    docs = frame(spark, rows)
    out = M.first_of_class(docs)
    assert out.columns == docs.columns
    worded = [r for r in rows if (r[1] or "").split()]
    classes = brute(worded)
    want = {(d, t) for d, t in rows if not (t or "").split()}  # linked to nothing
    want |= {(d, t) for d, t in worded if d is not None and (d, d) in {(x, c) for x, c, _ in classes}}
    got = rows_of(out, "doc_id", "text")
    assert len(set(got)) == len([r for r in got if (r[1] or "").split()]) + len({r for r in got if not (r[1] or "").split()})
    assert set(got) == want


def test_empty_table(spark):
    assert M.near_duplicates(frame(spark, [])).count() == 0
    assert M.first_of_class(frame(spark, [])).count() == 0


def test_weighted_estimate():
    rng = np.random.default_rng(1)
    e = rng.integers(0, 2**63, 60).astype(np.uint64)
    a, b = rng.random(60) * 4, rng.random(60) * 4
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    seen = (M.dart_minhash(e, a, 4096) == M.dart_minhash(e, b, 4096)).mean()
    assert abs(true - seen) < 0.04


def test_estimate_for_short_and_long_sets():
    rng = np.random.default_rng(2)
    for n in (4, 60, 5000):
        e = rng.integers(0, 2**63, 2 * n).astype(np.uint64)
        k = int(1.5 * n)
        a, b = e[:k], e[n // 2:]
        true = (k - n // 2) / (2 * n)
        seen = (M.dart_minhash(a, np.ones(len(a)), 2048) == M.dart_minhash(b, np.ones(len(b)), 2048)).mean()
        assert abs(true - seen) < 0.05
