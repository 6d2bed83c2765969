"""Line dedup against a brute-force version."""

import hashlib
import random

from llm_fixtures import corpus, frame, ordered, rows_of

from skyrisk.llm import linededup as L


def near(a, b):
    """Word edit distance of at most one, by the table."""
    if abs(len(a) - len(b)) > 1:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1] <= 1


def brute(rows):
    first = {}
    key = lambda d, k: (d is not None, d or 0, k)
    for d, t in rows:
        for k, line in enumerate(t.encode().split(b"\n") if t is not None else ()):
            ws = tuple(line.lower().split())
            if ws:
                first[ws] = min(first.get(ws, key(d, k)), key(d, k))
    long = [ws for ws in first if len(ws) >= L.MIN_WORDS]
    start = dict(first)
    by_size = {}
    for ws in long:
        by_size.setdefault(len(ws), []).append(ws)
    for a in long:
        for n in (len(a) - 1, len(a), len(a) + 1):
            for b in by_size.get(n, ()):
                if first[b] < start[a] and len(set(a) ^ set(b)) <= 4 and near(a, b):
                    start[a] = first[b]
    out = []
    for d, t in rows:
        lines = t.split("\n") if t is not None else []
        kept = [x for k, x in enumerate(lines) if not (ws := tuple(x.encode().lower().split())) or start[ws] >= key(d, k)]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return ordered(out)


def with_near_lines():
    rng = random.Random(2)
    rows = corpus()
    base = [f"w{rng.randrange(400)}" for _ in range(14)]
    one = lambda f: (ws := list(base), f(ws), " ".join(ws))[2]
    lines = [" ".join(base), one(lambda w: w.__setitem__(3, "other")), one(lambda w: w.__setitem__(3, "third")), one(lambda w: w.insert(0, "new")),
             one(lambda w: w.append("new")), one(lambda w: w.pop(7)), one(lambda w: (w.pop(7), w.pop(1))), one(lambda w: (w.insert(2, "p"), w.insert(9, "q"))),
             " ".join(base).upper(), " ".join(base[:9]), " ".join(base[:9]) + " x", " ".join(["same"] * 12), " ".join(["same"] * 13), " ".join(["same"] * 11)]
    rng.shuffle(lines)
    return rows + [(7000 + i // 3, "\n".join([x, "", f"filler line {i}"])) for i, x in enumerate(lines)]


def test_matches_brute_force(spark):
    rows = with_near_lines()
    got = rows_of(L.digest(L.dedup_lines(frame(spark, rows))), "doc_id", "n_lines", "n_removed", "kept_sha256")
    assert got == brute(rows)
    assert sum(r[2] for r in got) > 50


def test_hot_template_line(spark):
    """Every document has the same line but for one word: one stays, without pairs."""
    rows = [(d, "this is a line of ten words and number {} ends it\nown line {}".format(d, d)) for d in range(400)]
    got = rows_of(L.dedup_lines(frame(spark, rows)), "doc_id", "n_removed")
    assert got == ordered([(d, 0 if d == 0 else 1) for d in range(400)])


def test_empty_table(spark):
    assert L.dedup_lines(frame(spark, [])).count() == 0


def test_one_edit():
    rng = random.Random(4)
    for _ in range(2000):
        a = [rng.choice("ab") for _ in range(rng.randrange(7))]
        b = [rng.choice("ab") for _ in range(rng.randrange(7))]
        assert L.one_edit(a, b) == near(a, b)


def test_a_task_lets_go_of_the_operator_before_and_takes_few_rows_at_a_time():
    import pyarrow as pa

    from skyrisk.llm import common, linededup

    common.held_in_worker("before", 0, lambda: [0])
    n = 2 * common.SLICE_ROWS + 5
    batch = pa.record_batch({"doc_id": list(range(n)), "text": ["a b\nc"] * (n - 1) + [None]})
    got = list(linededup._lines(iter([batch])))
    assert not common._HELD
    assert [b.num_rows for b in got] == [2 * common.SLICE_ROWS, 2 * common.SLICE_ROWS, 8]
    assert [x for b in got for x in b.column("doc_id").to_pylist()] == [i for i in range(n - 1) for _ in range(2)]
