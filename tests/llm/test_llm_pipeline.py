"""The pipeline's stages on a small table, and its rows against a brute-force version."""

import random

import corpus_pipeline as P
import numpy as np
import test_llm_decontaminate as bd
import test_llm_linededup as bl
import test_llm_minhash as bm
from llm_fixtures import frame, lined, rows_of, words

from skyrisk.llm import linededup
from skyrisk.llm.common import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ITEM = " ".join(f"answer{i}" for i in range(14))


def table():
    rng = random.Random(11)
    texts = [lined(rng, words(rng, rng.randrange(60, 200))) for _ in range(25)]
    texts += [texts[2], texts[3] + "\n" + " ".join(words(rng, 30)), "12345 ... !!!", None, "", texts[5].replace("\n", " "), f"{texts[7]} {ITEM.upper()}, and more", ITEM]
    return [(d, t, "en" if d % 3 else "de", "src0", len(t) if t is not None else 0) for d, t in enumerate(texts)]


def stages(spark, tmp):
    rows = table()
    frame(spark, rows, "doc_id long, text string, lang string, source string, n_chars long", clash=False).write.parquet(f"{tmp}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp}/benchmark.parquet")
    docs, out = spark.read.parquet(f"{tmp}/documents.parquet"), []
    for name, stage in P.STAGES:
        docs, _ = written(stage(spark, docs, tmp), f"test-{name}")
        out.append(docs)
    return rows, out


def test_each_stage_on_its_input(spark, tmp_dir):
    tmp = f"{tmp_dir}/in"
    rows, (known, lines, near, clean, packed) = stages(spark, tmp)
    assert all(x.columns == COLUMNS for x in (known, lines, near, clean))
    texts = {d: t for d, t, *_ in rows}
    assert {r.doc_id for r in known.collect()} == {d for d, t in texts.items() if t and any(map(str.isalpha, t))}

    held = [(r.doc_id, r.text) for r in known.collect()]
    gone = {d: n for d, _, n, _ in bl.brute(held)}
    kept = {r.doc_id: r for r in lines.collect()}
    assert 25 not in kept and set(kept) == {d for d, t in held if gone[d] < len(t.split("\n"))}  # 25 is a copy
    assert all(r.n_chars == len(r.text) for r in kept.values()) and linededup.MIN_WORDS == 10

    held = [(r.doc_id, r.text) for r in lines.collect()]
    assert {r.doc_id for r in near.collect()} == {c for _, c, _ in bm.brute(held)}

    held = [(r.doc_id, r.text) for r in near.collect()]
    hit = {d: (n, h) for d, n, h, *_ in bd.brute(held, [(1, ITEM)])}
    left = {r.doc_id: r.text for r in clean.collect()}
    assert set(left) == {d for d, (n, h) in hit.items() if h * 2 <= n}
    assert all(left[d] == t for d, t in held if d in left and not hit[d][1])
    assert not any(r[2] for r in bd.brute(list(left.items()), [(1, ITEM)]))

    assert {r.doc_id for r in packed.collect()} == set(left)
    run = P.run(spark, tmp)
    assert rows_of(run, "doc_id", "piece", "length", "ids_crc32") == rows_of(packed, "doc_id", "piece", "length", "ids_crc32")
    fill = np.array([r.s for r in run.groupBy("sequence_id").sum("length").toDF("q", "s").collect()])
    assert fill.max() <= 2048 and len(fill) <= -(-fill.sum() // 2048) + 1


def test_white_space_that_is_left_goes(spark):
    """Documents whose lines all repeat, but for empty ones and white space; a document of white space as it came stays."""
    line = " ".join(f"w{i}" for i in range(20))
    rows = [(1, line), (2, line + "\n"), (3, "\n" + line + "\n \t\r\n"), (4, line + "\nsome words of its own"), (5, " \n")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], COLUMNS)
    got = {r.doc_id: (r.text, r.n_chars) for r in P.line_dedup(spark, docs, "").collect()}
    assert got == {1: (line, len(line)), 4: ("some words of its own", 21), 5: (" \n", 2)}
