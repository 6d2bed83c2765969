"""Line dedup over all documents with a deletion-neighbourhood join.

Lines are parted by line breaks and compared as their words (ASCII letters lower-cased, ASCII white
space apart).  A line goes if an earlier line, by (doc_id, line number), has the same words, or if both
have ``MIN_WORDS`` words or more and one inserted, deleted or replaced word parts them.  Lines are
judged on the input, not on what is left; blank lines stay.

1. Equal lines are gathered by a 128-bit hash, with map-side minima, to distinct lines with their
   first place.
2. Two lines within one edit share one half (of the words of the shorter one) whole.  Lines that share
   neither half with another distinct line have no neighbour and go no further: a lossless prune.
3. Of the others every variant with one word deleted is emitted as a hashed key, with the place of the
   deletion (equal keys: one replaced word) and without (equal to a whole line: one inserted word).  A
   key's group yields its earliest line, so a hot key costs one row for each member and no pairs.
4. The earliest neighbour of each line is checked word by word.

Broadcasts are made only up to ``common.BROADCAST_ROWS`` counted rows; beyond, the same joins shuffle.

Defined cases: null text stays null, empty text has one blank line; lines of any length are linear in
work (variant hashes come from prefix sums); rows that repeat a doc_id and text share their places and
so their result; null ids sort first; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyrisk.llm.common import id_text, nothing_held, slices, small, working, written

MIN_WORDS = 10

_PRIME = (1 << 127) - 1
_BASE = 0x5DEECE66D1234567890ABCDEF1357BD
_BACK = pow(_BASE, -1, _PRIME)


def words_of(line: bytes) -> list[bytes]:
    return line.lower().split()


def _hash(*parts: bytes) -> bytes:
    return hashlib.blake2b(b" ".join(parts), digest_size=16).digest()


def _halves(words: list[bytes]) -> list[int]:
    """A key for each half of the line, as the shorter or the longer one of a pair."""
    out = []
    for n in (len(words), len(words) - 1):
        h = n // 2
        for side, part in ((b"p", words[:h]), (b"s", words[len(words) - (n - h):])):
            out.append(int.from_bytes(hashlib.blake2b(b" ".join(part), digest_size=8, person=b"%d%s" % (n, side)).digest(), "little", signed=True))
    return out


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    nothing_held()
    for batch in slices(batches):
        row, number, name, halves = [], [], [], []
        for i, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
            for k, line in enumerate(text.split(b"\n") if text is not None else ()):
                words = words_of(line)
                if words:
                    row.append(i)
                    number.append(k)
                    name.append(_hash(*words))
                    halves.append(_halves(words) if len(words) >= MIN_WORDS else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(number, pa.int32()), pa.array(name, pa.binary()),
             pa.array(halves, pa.list_(pa.int64()))], names=["doc_id", "line_no", "line", "halves"])


def _variant_keys(words: list[bytes]) -> tuple[bytes, list[bytes], list[bytes]]:
    """Key of the whole line, of each distinct deletion, and of each deletion with its place."""
    value = [int.from_bytes(hashlib.blake2b(w, digest_size=15).digest(), "little") for w in words]
    before, power = [0], 1
    for v in value:
        before.append((before[-1] + v * power) % _PRIME)
        power = power * _BASE % _PRIME
    total = before[-1]
    gone = [(before[i] + (total - before[i + 1]) * _BACK) % _PRIME for i in range(len(words))]
    key = lambda x, i=0: x.to_bytes(16, "little") + i.to_bytes(4, "little")
    n = len(words)
    return key(total), [key(x) for x in dict.fromkeys(gone)], [key(x, n << 1 | 1) + i.to_bytes(4, "little") for i, x in enumerate(gone)]


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, key, role = [], [], []

        def out(row=row, key=key, role=role):
            at = pa.array(row, pa.int64())
            return pa.RecordBatch.from_arrays([batch.column("line").take(at), batch.column("first").take(at), pa.array(key, pa.binary()), pa.array(role, pa.string())],  # noqa: B023
                                              names=["line", "first", "key", "role"])

        for i, words in enumerate(batch.column("words").to_pylist()):
            whole, gone, placed = _variant_keys(words.split())
            for r, keys in (("whole", [whole]), ("gone", gone), ("placed", placed)):
                row += [i] * len(keys)
                key += keys
                role += [r] * len(keys)
            if len(row) > 100_000:
                yield out()
                row.clear(), key.clear(), role.clear()
        yield out()


def one_edit(a: list, b: list) -> bool:
    """Whether at most one inserted, deleted or replaced word parts the two."""
    if abs(len(a) - len(b)) > 1:
        return False
    n, same, tail = min(len(a), len(b)), 0, 0
    while same < n and a[same] == b[same]:
        same += 1
    while tail < n - same and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    return same + tail >= max(len(a), len(b)) - 1


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fine = [one_edit(a.split(), b.split()) for a, b in zip(batch.column("words").to_pylist(), batch.column("near_words").to_pylist(), strict=True)]
        yield batch.select(["line", "near"]).filter(pa.array(fine, pa.bool_()))


def _first_lines(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``line, first, words`` of distinct lines, read at their first place."""
    places = wanted.groupBy(F.col("first.doc_id").alias("at")).agg(F.collect_list(F.struct("first.line_no", "line", "first")).alias("places"))
    held = docs.join(small(written(places, "places")[0]), F.col("doc_id").eqNullSafe(F.col("at")))
    schema = T.StructType([T.StructField("line", T.BinaryType()), wanted.schema["first"], T.StructField("words", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            line, at, found = [], [], []
            places = batch.column("places")
            flat, offset = places.flatten(), 0
            numbers, names = flat.field("line_no").to_pylist(), flat.field("line").to_pylist()
            for text, n in zip(batch.column("text").cast(pa.binary()).to_pylist(), places.value_lengths().to_pylist(), strict=True):
                lines = text.split(b"\n") if text is not None else []
                for k in range(offset, offset + n):
                    words = words_of(lines[numbers[k]]) if numbers[k] < len(lines) else []
                    if _hash(*words) == names[k]:  # rows may repeat an id with another text
                        line.append(names[k])
                        at.append(k)
                        found.append(b" ".join(words))
                offset += n
            yield pa.RecordBatch.from_arrays([pa.array(line, pa.binary()), flat.field("first").take(pa.array(at, pa.int64())), pa.array(found, pa.binary())],
                                             names=["line", "first", "words"])

    return held.select("text", "places").mapInArrow(run, schema).dropDuplicates(["line"])


def _near(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """``line, near``: the earliest place of a line within one edit, where that is earlier than the line's own."""
    keys = distinct.where(F.col("halves").isNotNull()).select("line", F.explode("halves").alias("half"))
    shared = keys.groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select("half")
    likely = keys.join(shared, "half", "left_semi").select("line").distinct()
    wanted, _ = written(distinct.join(likely, "line", "left_semi").select("line", "first"), "likely-lines")
    lines, _ = written(_first_lines(docs, wanted), "lines")
    schema = T.StructType([*lines.schema.fields[:2], T.StructField("key", T.BinaryType()), T.StructField("role", T.StringType())])
    variants, _ = written(lines.mapInArrow(_variants, schema), "variants")
    of = lambda role: F.min(F.when(F.col("role") == role, F.col("first"))).alias(f"{role}_first")
    groups = variants.groupBy("key").agg(F.count("*").alias("n"), of("whole"), of("gone"), of("placed")).where("n > 1")
    other = (F.when(F.col("role") == "whole", F.col("gone_first")).when(F.col("role") == "gone", F.col("whole_first")).otherwise(F.col("placed_first")))
    best = (variants.join(groups, "key").select("line", "first", other.alias("near")).where(F.col("near") < F.col("first"))
            .groupBy("line").agg(F.min("near").alias("near")))
    pairs = (best.join(lines.select("line", "words"), "line")
             .join(lines.select(F.col("first").alias("near"), F.col("words").alias("near_words")), "near").select("line", "near", "words", "near_words"))
    return written(pairs.mapInArrow(_checked, T.StructType([pairs.schema["line"], pairs.schema["near"]])), "near-lines")[0]


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, gone array<struct<line_no,line>>``: the lines that an earlier line repeats, for documents that have any."""
    frame = id_text(docs, id_col, text_col)
    schema = T.StructType([frame.schema["doc_id"], T.StructField("line_no", T.IntegerType()), T.StructField("line", T.BinaryType()),
                           T.StructField("halves", T.ArrayType(T.LongType()))])
    with working(docs.sparkSession):
        lines, _ = written(frame.mapInArrow(_lines, schema), "all-lines")
        distinct = lines.groupBy("line").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count("*").alias("n"), F.first("halves").alias("halves"))
        distinct, _ = written(distinct, "distinct-lines")
        kept = distinct.where("n > 1").select("line", F.col("first").alias("from")).unionAll(_near(frame, distinct).select("line", F.col("near").alias("from")))
        # written, so that the join has an exchange of its own on both sides and a hot line can be split
        kept, _ = written(kept.groupBy("line").agg(F.min("from").alias("from")), "kept-from")
        gone = (lines.select("doc_id", "line_no", "line").join(small(kept), "line").where(F.col("from") < F.struct("doc_id", "line_no"))
                .groupBy("doc_id").agg(F.collect_set(F.struct("line_no", "line")).alias("gone")))
        return written(gone, "repeated-lines", result=True)[0]


def _rebuilt(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing_held()
        for batch in slices(batches):
            texts, n_lines, n_gone = [], [], []
            for text, gone in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("gone").to_pylist(), strict=True):
                lines = text.split(b"\n") if text is not None else []
                off = {g["line_no"] for g in gone or () if g["line_no"] < len(lines) and _hash(*words_of(lines[g["line_no"]])) == g["line"]}
                texts.append(b"\n".join(x for i, x in enumerate(lines) if i not in off).decode() if off else text.decode() if text is not None else None)
                n_lines.append(len(lines))
                n_gone.append(len(off))
            columns = [c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n not in ("text", "gone")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_gone, pa.int64())], names=schema)

    return run


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``doc_id, text`` (without its repeated lines)``, n_lines, n_removed``, and ``kept``: a struct of further columns."""
    gone = repeated_lines(docs, id_col, text_col)
    own = [F.col(id_col).alias("doc_id"), *([F.struct(*keep).alias("kept")] if keep else []), F.col(text_col).cast("string").alias("text")]
    held = docs.select(*own).join(small(gone.withColumnRenamed("doc_id", "at")), F.col("doc_id").eqNullSafe(F.col("at")), "left").drop("at")
    fields = [*[f for f in held.schema.fields if f.name in ("doc_id", "kept")], T.StructField("text", T.StringType()),
              T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())]
    return held.mapInArrow(_rebuilt([f.name for f in fields]), T.StructType(fields))


def digest(done: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_removed, kept_sha256`` (lowercase hex of the text that is left, UTF-8)."""
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
