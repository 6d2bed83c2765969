"""Small tables with the hard cases: nulls, empty and long texts, copies, repeated rows, ties, columns
whose names are the operators' own working names."""

import random

CLASH = ["node", "comp", "key", "line", "spans", "words", "shard", "tkey", "kept", "at_id", "at", "row", "piece", "start", "item", "items", "n_words",
         "length", "size", "bits", "cell", "depth", "mini", "h1", "first", "near", "gone", "places", "part", "seq", "score", "class_id", "i", "k"]


def words(rng, n, vocab=400):
    return [f"w{rng.randrange(vocab)}{rng.choice(['', '', '', '.', ','])}" for _ in range(n)]


def lined(rng, ws):
    out = []
    while ws:
        n = rng.randrange(4, 25)
        out.append(" ".join(ws[:n]))
        ws = ws[n:]
    return "\n".join(out)


def corpus(seed=7, n=40):
    """(doc_id, text) rows."""
    rng = random.Random(seed)
    rows = [(i * 3, lined(rng, words(rng, rng.randrange(5, 400)))) for i in range(n)]
    texts = [t for _, t in rows]
    passage = " ".join(words(rng, 70))
    nid = iter(range(1000, 5000))
    rows += [(next(nid), texts[k]) for k in (3, 3, 3, 5, 8)]  # copies
    for k in (2, 6, 9):  # near copies: some words replaced
        ws = texts[k].split(" ")
        for _ in range(max(1, len(ws) // 60)):
            ws[rng.randrange(len(ws))] = "changed"
        rows.append((next(nid), " ".join(ws)))
    rows += [(next(nid), lined(rng, words(rng, 30)) + " " + passage + " " + lined(rng, words(rng, 30))) for _ in range(4)]
    rows += [(next(nid), passage + "\n" + passage)]
    rows += [(next(nid), "w1 w2 " * 400), (next(nid), "same " * 300), (next(nid), "same " * 200)]
    rows += [(next(nid), None), (next(nid), None), (next(nid), ""), (next(nid), "   \n\n "), (next(nid), "one two"), (next(nid), "One  two"), (next(nid), "!!! ...")]
    rows += [(None, texts[4]), (None, None), (1, "Überall große Wörter, é à ñ. " * 20)]
    rows += [rows[0], rows[0], (rows[1][0], texts[2])]  # repeated rows, a repeated id with another text
    rows += [(next(nid), lined(rng, words(rng, 20_000, 5_000)))]  # very long
    return rows


def frame(spark, rows, schema="doc_id long, text string", clash=True):
    df = spark.createDataFrame(rows, schema)
    if clash:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit(f"x-{c}") for c in CLASH if c not in df.columns})
    return df.repartition(4)


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.select(*cols).collect()), key=lambda t: tuple((x is not None, str(x)) for x in t))


def ordered(rows):
    return sorted(rows, key=lambda t: tuple((x is not None, str(x)) for x in t))
