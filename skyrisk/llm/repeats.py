"""Passages that repeat across documents: what the two substring operators share.

A window is ``WINDOW`` consecutive words (runs without ASCII white space, unchanged).  A word goes if a
window that covers it also starts in a document with a smaller id; windows are judged on the input.

1. Each window is anchored at its minimiser, the run of ``GRAM`` words with the least hash in it (the
   leftmost of equal ones).  Neighbouring windows with one anchor form a segment of at most
   ``WINDOW - GRAM + 1`` windows, so equal windows always meet under their anchor's hash.  Emitted per
   segment: hashes and its place, no text.
2. Anchors in one document only go no further.  Equal segments (128-bit hash) become one, with the
   smallest id; so a passage of a third of all documents costs one segment.
3. An anchor with over ``HOT`` distinct segments (a passage in many different surroundings) is split: its
   windows go on one by one, anchored at their own hash.
4. The words of the distinct segments are read once and dealt by anchor to shards of about
   ``SHARD_SEGMENTS``; a shard's ``kernel`` (an index) gives for each window the smallest id it starts in.
5. The answers go back to all places of a segment, and the covered words are taken out.

Defined cases: null texts have no words; documents of fewer words than a window lose nothing; rows with a
null id take no part (nothing goes from them and they are no source); rows that repeat an id don't count
as smaller; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyrisk.llm.common import WordHashes, dropped, held_in_worker, id_text, mix, small, working, written

WINDOW = 50
GRAM = 25
HOT = 2_000
SHARD_SEGMENTS = 16_000

_BASES = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], np.uint64)  # odd, so they have inverses modulo 2**64
_INVERSES = np.array([pow(int(b), -1, 1 << 64) for b in _BASES], np.uint64)

#: sorted words ids of segments, their anchors and ids -> for each segment the smallest id (as a rank) of each window
Kernel = Callable[[list[np.ndarray], np.ndarray, np.ndarray], list[np.ndarray]]


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.concatenate((np.ones(1, np.uint64), np.full(n, base, np.uint64))).cumprod(dtype=np.uint64)


class Rolling:
    """Hashes of any run of words of one text, from prefix sums of polynomials modulo 2**64."""

    def __init__(self, words: np.ndarray, which: int):
        n = len(words)
        self.back = _powers(_INVERSES[which], n)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * _powers(_BASES[which], n)[:n], dtype=np.uint64)))

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.back[start] + (stop - start).astype(np.uint64))


def segments(hashes: np.ndarray) -> tuple[np.ndarray, ...]:
    """``anchor hash, hash 1, hash 2, start, windows, anchor offset`` of each segment of a text."""
    n = len(hashes)
    one, two = Rolling(hashes, 0), Rolling(hashes, 1)
    at = np.arange(n - GRAM + 1)
    grams = one.of(at, at + GRAM)
    least = np.lib.stride_tricks.sliding_window_view(grams, WINDOW - GRAM + 1).argmin(1) + np.arange(n - WINDOW + 1)
    start = np.flatnonzero(np.diff(least, prepend=-1))
    windows = np.diff(start, append=len(least))
    stop = start + windows + WINDOW - 1
    return grams[least[start]], one.of(start, stop), two.of(start, stop), start, windows, least[start] - start


def _segment_rows(batch: pa.RecordBatch, row: list[int], found: list[tuple]) -> pa.RecordBatch:
    mini, h1, h2, start, windows, anchor = (np.concatenate(x) if x else np.zeros(0) for x in (zip(*found, strict=True) if found else [[]] * 6))
    at = pa.array(np.repeat(np.array(row, np.int64), [len(f[0]) for f in found]))
    return pa.RecordBatch.from_arrays(
        [pa.array(mini.astype(np.uint64).view(np.int64)), pa.array(h1.astype(np.uint64).view(np.int64)), pa.array(h2.astype(np.uint64).view(np.int64)),
         batch.column("doc_id").take(at), batch.column("tkey").take(at), pa.array(start.astype(np.int32)), pa.array(windows.astype(np.int32)),
         pa.array(anchor.astype(np.int32))], names=["mini", "h1", "h2", "doc_id", "tkey", "start", "windows", "anchor"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = held_in_worker("words", 0, WordHashes)
    for batch in batches:
        row, found, size = [], [], 0
        for i, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
            words = text.split() if text else []
            if len(words) >= WINDOW:
                found.append(segments(hashes.of(words)))
                row.append(i)
                size += len(found[-1][0])
            if size > 50_000:
                yield _segment_rows(batch, row, found)
                row, found, size = [], [], 0
        yield _segment_rows(batch, row, found)


def _single_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each window of the listed segments as a segment of its own, anchored at its own hash."""
    hashes = held_in_worker("words", 0, WordHashes)
    for batch in batches:
        for i, (text, places) in enumerate(zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("places").to_pylist(), strict=True)):
            h = hashes.of(text.split())
            start = np.unique(np.concatenate([np.arange(p["start"], p["start"] + p["windows"]) for p in places]))
            one, two = (Rolling(h, k).of(start, start + WINDOW) for k in (0, 1))
            yield _segment_rows(batch, [i], [(mix(one), one, two, start, np.ones(len(start), np.int64), np.zeros(len(start), np.int64))])


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of the listed segments."""
    for batch in batches:
        out: dict[str, list] = {n: [] for n in ("mini", "h1", "h2", "anchor", "words")}
        row = []
        for i, (text, places) in enumerate(zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("places").to_pylist(), strict=True)):
            words = text.split()
            for p in places:
                row.append(i)
                for n in ("mini", "h1", "h2", "anchor"):
                    out[n].append(p[n])
                out["words"].append(b" ".join(words[p["start"]:p["start"] + p["windows"] + WINDOW - 1]))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        columns = [pa.array(out[n], k) for n, k in zip(out, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([*columns, batch.column("doc_id").take(pa.array(row, pa.int64()))], names=[*out, "doc_id"])


def _at_places(docs: DataFrame, places: DataFrame) -> tuple[DataFrame, str]:
    """Documents with the ``places`` listed for them (``at_id, at_key, places``), and the path of the list."""
    own, path = written(places, "places")
    held = docs.join(small(own), (F.col("doc_id") == F.col("at_id")) & (F.col("tkey") == F.col("at_key")))
    return held.select("doc_id", "tkey", "text", "places"), path


def _solver(kernel: Kernel):
    def run(shard: pd.DataFrame) -> pd.DataFrame:
        texts = [x.split() for x in shard["words"]]
        vocab: dict[bytes, int] = {}
        coded = [np.array([vocab.setdefault(w, len(vocab) + 1) for w in words], np.int64) for words in texts]
        ids, rank = np.unique(shard["doc_id"].to_numpy(), return_inverse=True)
        found = kernel(coded, shard["anchor"].to_numpy(), rank)
        runs = []
        for least in found:
            cut = np.flatnonzero(np.diff(least, prepend=-1))
            runs.append([{"from": int(a), "n": int(n), "least": ids[least[a]]} for a, n in zip(cut, np.diff(cut, append=len(least)), strict=True)])
        return pd.DataFrame({"h1": shard["h1"], "h2": shard["h2"], "runs": runs})

    return run


def repeated_spans(docs: DataFrame, kernel: Kernel) -> DataFrame:
    """``doc_id, tkey, spans array<struct<from,to>>`` (in words, merged): what goes, of documents that lose words."""
    with working(docs.sparkSession):
        return written(_spans(docs, kernel), "spans", result=True)[0]


def _spans(docs: DataFrame, kernel: Kernel) -> DataFrame:
    """Working tables are dropped after their last reader, so that they don't add up."""
    spark, id_type = docs.sparkSession, docs.schema["doc_id"].dataType
    row = T.StructType([*(T.StructField(n, T.LongType()) for n in ("mini", "h1", "h2")), T.StructField("doc_id", id_type), T.StructField("tkey", T.IntegerType()),
                        *(T.StructField(n, T.IntegerType()) for n in ("start", "windows", "anchor"))])
    cut, p1 = written(docs.mapInArrow(_cut, row), "segments")
    shared = cut.groupBy("mini").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).where("x < y").select("mini")
    shared, p2 = written(shared, "shared")  # so that the join has an exchange of its own on both sides and a hot anchor can be split
    some, _ = written(cut.join(shared, "mini", "left_semi"), "shared")
    dropped(spark, p1, p2)  # the largest working tables

    group = lambda rows: rows.groupBy("mini", "h1", "h2").agg(
        F.min(F.struct("doc_id", "tkey", "start")).alias("at"), F.first("windows").alias("windows"), F.first("anchor").alias("anchor"))
    distinct, p3 = written(group(some), "distinct")
    hot, _ = written(distinct.groupBy("mini").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("mini"), "hot")
    if not hot.isEmpty():
        many = some.join(small(hot), "mini", "left_semi")
        lists = many.groupBy(F.col("doc_id").alias("at_id"), F.col("tkey").alias("at_key")).agg(F.collect_list(F.struct("start", "windows")).alias("places"))
        held, p4 = _at_places(docs, lists)
        single, _ = written(held.mapInArrow(_single_windows, row), "single")
        some = some.join(small(hot), "mini", "left_anti").unionAll(single)
        cold, p5 = distinct.join(small(hot), "mini", "left_anti").unionAll(group(single)), p3
        distinct, p3 = written(cold, "distinct")
        dropped(spark, p4, p5)

    lists = distinct.groupBy(F.col("at.doc_id").alias("at_id"), F.col("at.tkey").alias("at_key")).agg(
        F.collect_list(F.struct("mini", "h1", "h2", "anchor", "windows", "at.start")).alias("places"))
    text = T.StructType([*row.fields[:3], T.StructField("anchor", T.IntegerType()), T.StructField("words", T.BinaryType()), T.StructField("doc_id", id_type)])
    held, p4 = _at_places(docs, lists)
    worded, p5 = written(held.mapInArrow(_words, text), "words")
    dropped(spark, p3, p4)
    shards = max(1, -(-worded.count() // SHARD_SEGMENTS))
    answer = T.StructType([T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("runs", T.ArrayType(T.StructType(
        [T.StructField("from", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("least", id_type)])))])
    solved, _ = written(worded.withColumn("shard", F.pmod(F.xxhash64("mini"), F.lit(shards))).groupBy("shard").applyInPandas(_solver(kernel), answer), "answers")
    dropped(spark, p5)

    # one answer for each segment's words; both sides have exchanges of their own, so a hot segment can be split
    runs = (some.select("h1", "h2", "doc_id", "tkey", "start").join(solved, ["h1", "h2"])
            .select("doc_id", "tkey", "start", F.filter("runs", lambda r: r["least"] < F.col("doc_id")).alias("runs")).where(F.size("runs") > 0))
    spans = runs.select("doc_id", "tkey", F.explode(F.transform("runs", lambda r: F.struct(
        (F.col("start") + r["from"]).alias("from"), (F.col("start") + r["from"] + r["n"] + (WINDOW - 1)).alias("to")))).alias("span"))
    return spans.groupBy("doc_id", "tkey").agg(F.sort_array(F.collect_set("span")).alias("spans"))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_gone, kept, marked = [], [], [], []
        for text, spans in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True):
            words = text.split() if text else []
            left, done, merged = [], 0, []
            for s in spans or ():
                if s["from"] > done or not merged:
                    left += words[done:s["from"]]
                    merged.append({"from": s["from"], "to": s["to"]})
                merged[-1]["to"] = done = max(done, s["to"])
            left += words[done:]
            n_words.append(len(words))
            n_gone.append(len(words) - len(left))
            kept.append(b" ".join(left))
            marked.append(merged)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()),
             pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()), pa.array(marked, batch.schema.field("spans").type)],
            names=["doc_id", "n_words", "n_removed", "kept", "kept_sha256", "spans"])


def without_repeats(docs: DataFrame, kernel: Kernel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` (the words that stay, joined by one space)``, kept_sha256, spans``."""
    frame = id_text(docs, id_col, text_col).withColumn("tkey", F.hash("text"))
    spans = repeated_spans(frame.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()), kernel)
    own = small(spans.withColumnsRenamed({"doc_id": "at_id", "tkey": "at_key"}))
    held = frame.join(own, (F.col("doc_id") == F.col("at_id")) & (F.col("tkey") == F.col("at_key")), "left").select("doc_id", "text", "spans")
    schema = T.StructType([frame.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
                           T.StructField("kept", T.StringType()), T.StructField("kept_sha256", T.StringType()), held.schema["spans"]])
    return held.mapInArrow(_kept, schema)


def digest(done: DataFrame) -> DataFrame:
    return done.select("doc_id", "n_words", "n_removed", "kept_sha256")
