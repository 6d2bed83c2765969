"""Token ids in binary shards, compressed by a Re-Pair grammar per shard.

Documents are dealt by ascending id over the partitions (ranges from Spark's own sampling, no single
task), encoded by a tokenizer file, each ended by ``end_id``, and gathered into shards of about
``SHARD_IDS`` ids.  In a shard the most frequent neighbouring symbols are replaced by nonterminals, in
rounds: a round knows the count of every pair, takes up to ``ROUND_RULES`` of the most frequent ones that occur at
least ``MIN_COUNT`` times (fewer hardly pay for a rule), and replaces their occurrences from left to right, until no
pair occurs that often.  Pairs never reach over
the end of a document, so every document is a run of whole symbols and can be decoded alone.

File format (``GRMR1``; little endian; one binary value per shard in a Parquet table, so that Spark's
committer and any file system can hold it): magic, then unsigned 32-bit counts ``ids, documents, base,
rules, symbols, width``; the rules' left and right symbols; the rules' expansion lengths; for each
document its number of symbols and of ids; then the symbols, ``width`` bytes each.  Symbols under
``base`` are ids, symbol ``base + r`` is rule ``r``, which refers to smaller symbols only.

Defined cases: null or empty texts are the end id alone; rows with equal ids are ordered by text (null
first); null ids come first; an empty table gives no shards and no rows; further columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyrisk.llm.common import id_text, scratch
from skyrisk.llm.tokens import encoder, shipped, tokenizer_file

SHARD_IDS = 1 << 20
ROUND_RULES = 2048
MIN_COUNT = 16
END_ID = 0
MAGIC = b"GRMR1\0\0\0"
_HEAD = struct.Struct("<6I")


def _occurrences(sym: np.ndarray, nxt: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places ``at`` whose pairs occur ``MIN_COUNT`` times there, by pair and place, with each such pair's code and count."""
    a, b = sym[at], sym[nxt[at]]
    cell = ((a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA6B)) >> np.uint32(14)).astype(np.int64)
    maybe = np.flatnonzero((np.bincount(cell, minlength=1 << 18) >= MIN_COUNT)[cell])  # a cell has all places of a pair, or more
    at, a, b = at[maybe], a[maybe].astype(np.uint64), b[maybe].astype(np.uint64)
    bits, place_bits = int(max(a.max(initial=0), b.max(initial=0))).bit_length(), len(sym).bit_length()
    if 2 * bits + place_bits <= 64:  # pair and place in one number
        a <<= np.uint64(bits)
        a |= b
        a <<= np.uint64(place_bits)
        a |= at.view(np.uint64)
        a.sort()
        at = (a & np.uint64((1 << place_bits) - 1)).view(np.int64)
        code = a >> np.uint64(place_bits)
    else:
        bits, code = 32, a << np.uint64(32) | b
        order = np.lexsort((at, code))
        at, code = at[order], code[order]
    start = np.append(np.zeros(min(1, len(code)), np.int64), np.flatnonzero(code[1:] != code[:-1]) + 1)
    count = np.diff(start, append=len(code))
    often = count >= MIN_COUNT
    code = code[start[often]]
    code = code >> np.uint64(bits) << np.uint64(32) | code & np.uint64((1 << bits) - 1)
    return at[np.repeat(often, count)], code, count[often]


def compress(ids: np.ndarray, doc_lengths: np.ndarray) -> bytes:
    """One shard: ``ids`` (unsigned 32-bit) of documents of ``doc_lengths`` ids (each at least 1).

    Places are linked, so a round touches only what it replaces and the neighbours.  A pair gains occurrences only in the round
    that names one of its symbols, so all its places are listed then, its count falls by those that end, and a pair that is
    rare once stays so and is not looked at again.  The counts of each round are those of a full count."""
    base, n = int(ids.max(initial=0)) + 1, len(ids)
    sym = np.append(ids.astype(np.uint32), np.uint32(0))  # and a place after the end
    nxt, prv = np.arange(1, n + 2), np.arange(-1, n)
    last = np.zeros(n + 1, bool)  # the last symbol of a document takes no part as a left one
    last[np.cumsum(doc_lengths) - 1] = last[n] = True
    gone = np.zeros(n, bool)
    left, right = [], []
    at, code, count = _occurrences(sym, nxt, np.flatnonzero(~last))
    size, begin = count.copy(), np.cumsum(count) - count  # listed places of each pair
    pair = np.full(n + 1, -1)  # the listed pair that begins at a place
    pair[at] = np.repeat(np.arange(len(code)), count)
    while True:
        top = np.flatnonzero(count >= MIN_COUNT)
        if not len(top):
            break
        top = top[np.lexsort((code[top], -count[top]))][:ROUND_RULES]  # the others have their turn in a later round
        top = top[np.argsort(code[top])]
        name = np.uint32(base + len(left))
        left += (code[top] >> np.uint64(32)).tolist()
        right += (code[top] & np.uint64(0xFFFFFFFF)).tolist()
        rule = np.zeros(len(code), np.uint32)
        rule[top] = name + np.arange(len(top), dtype=np.uint32)
        listed = size[top]
        here = at[np.repeat(begin[top] - np.cumsum(listed) + listed, listed) + np.arange(int(listed.sum()))]
        here = np.sort(here[pair[here] == np.repeat(top, listed)])
        run = np.flatnonzero(np.append(True, nxt[here[:-1]] != here[1:]))  # in a run of neighbours every second one is replaced
        offset = np.arange(len(here)) - np.repeat(run, np.diff(run, append=len(here)))
        here = here[offset % 2 == 0]
        second = nxt[here]
        after = nxt[second]
        sym[here], last[here], gone[second] = rule[pair[here]], last[second], True
        nxt[here], prv[after] = after, here
        before = prv[here]
        before = before[before >= 0]
        before = before[~last[before] & (sym[before] < name)]  # a place replaced in this round is in ``here``
        ended = np.concatenate([pair[here], pair[second], pair[before]])
        count -= np.bincount(ended[ended >= 0], minlength=len(count))
        pair[here] = pair[second] = pair[before] = -1
        new_at, new_code, new_count = _occurrences(sym, nxt, np.concatenate([here[~last[here]], before]))
        pair[new_at] = np.repeat(np.arange(len(code), len(code) + len(new_code)), new_count)
        begin = np.append(begin, len(at) + np.cumsum(new_count) - new_count)
        at, code, count, size = np.append(at, new_at), np.append(code, new_code), np.append(count, new_count), np.append(size, new_count)
    sym, last = sym[:n][~gone], last[:n][~gone]
    size = _lengths(base, left, right)
    symbols = np.diff(np.flatnonzero(last), prepend=-1)
    width = 2 if base + len(left) <= 1 << 16 else 4
    head = _HEAD.pack(n, len(doc_lengths), base, len(left), len(sym), width)
    parts = [left, right, size, symbols, doc_lengths]
    return MAGIC + head + b"".join(np.asarray(x, "<u4").tobytes() for x in parts) + sym.astype(f"<u{width}").tobytes()


def _lengths(base: int, left: list[int], right: list[int]) -> list[int]:
    size: list[int] = []
    of = lambda s: 1 if s < base else size[s - base]
    for a, b in zip(left, right, strict=True):
        size.append(of(a) + of(b))
    return size


class Shard:
    """Random access to the documents of one shard."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a shard of this format")
        self.n_ids, n_docs, self.base, n_rules, n_sym, width = _HEAD.unpack_from(data, 8)
        at = 8 + _HEAD.size

        def take(n: int, kind: str = "<u4") -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        left, right, self.size, symbols, self.doc_ids = take(n_rules), take(n_rules), take(n_rules), take(n_docs), take(n_docs)
        self.ends = np.cumsum(symbols)
        self.symbols = take(n_sym, f"<u{width}")
        begin = np.cumsum(self.size, dtype=np.int64) - self.size
        flat = np.empty(int(self.size.sum()), np.uint32)
        for r, (a, b, n, to) in enumerate(zip(left.tolist(), right.tolist(), self.size.tolist(), begin.tolist(), strict=True)):
            for s, put in ((a, to), (b, to + n - (1 if b < self.base else int(self.size[b - self.base])))):
                if s < self.base:
                    flat[put] = s
                else:
                    m, src = int(self.size[s - self.base]), int(begin[s - self.base])
                    flat[put:put + m] = flat[src:src + m]
        self.flat, self.begin = flat, begin

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        if not len(self.size):
            return symbols.astype("<u4")
        rule = symbols.astype(np.int64) - self.base
        is_rule = rule >= 0
        n = np.where(is_rule, self.size[np.maximum(rule, 0)], 1).astype(np.int64)
        start = np.cumsum(n) - n
        out = np.empty(int(n.sum()), "<u4")
        out[start[~is_rule]] = symbols[~is_rule]
        n, start, begin = n[is_rule], start[is_rule], self.begin[rule[is_rule]]
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(start, n) + within] = self.flat[np.repeat(begin, n) + within]
        return out

    def document(self, k: int) -> np.ndarray:
        return self.expand(self.symbols[self.ends[k - 1] if k else 0:self.ends[k]])


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID,
                 id_col: str = "doc_id", text_col: str = "text") -> None:
    """Shards as a Parquet table ``part, seq, n_ids, doc_ids, shard``; (part, seq) is the order."""
    spark = docs.sparkSession
    frame = id_text(docs, id_col, text_col)
    spec = shipped(spark, tokenizer or tokenizer_file())
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = frame.repartitionByRange(parts, "doc_id", "text").sortWithinPartitions("doc_id", "text")
    id_type = frame.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("seq", T.IntegerType()), T.StructField("n_ids", T.LongType()),
                           T.StructField("doc_ids", T.ArrayType(id_type)), T.StructField("shard", T.BinaryType())])
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(spec)
        seq, names, data, size = 0, [], [], 0

        def shard():
            lengths = np.array([len(x) // 4 for x in data])
            ids = np.frombuffer(b"".join(data), "<u4")
            own = pa.concat_arrays(names)
            doc_ids = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(ids)], pa.int64()), doc_ids,
                 pa.array([compress(ids, lengths)], pa.binary())], names=["part", "seq", "n_ids", "doc_ids", "shard"])

        for batch in batches:
            part = batch.column("part")[0].as_py() if batch.num_rows else 0
            for i, text in enumerate(batch.column("text").to_pylist()):
                data.append(enc.encode(text) + end)
                names.append(batch.column("doc_id").slice(i, 1))
                size += len(data[-1]) // 4
                if size >= SHARD_IDS:
                    yield shard()
                    seq, names, data, size = seq + 1, [], [], 0
        if data:
            yield shard()

    ordered.withColumn("part", F.spark_partition_id()).mapInArrow(run, schema).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, decoded from the files."""
    files = spark.read.parquet(path)
    id_type = files.schema["doc_ids"].dataType.elementType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("part", T.IntegerType()), T.StructField("seq", T.IntegerType()),
                           T.StructField("before", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard(batch.column("shard")[i].as_py())
                n = shard.doc_ids.astype(np.int64)
                before = np.cumsum(n) - n
                ids = shard.expand(shard.symbols)
                crc = [zlib.crc32(ids[a:a + m]) for a, m in zip(before.tolist(), n.tolist(), strict=True)]
                k = len(n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_ids")[i].values, pa.array([batch.column("part")[i].as_py()] * k, pa.int32()),
                     pa.array([batch.column("seq")[i].as_py()] * k, pa.int32()), pa.array(before, pa.int64()), pa.array(n, pa.int64()),
                     pa.array(crc, pa.int64())], schema=pa.schema([(f.name, t.type) for f, t in zip(schema.fields, [
                         batch.schema.field("doc_ids").type.value_field, *[pa.field("x", x) for x in (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())]], strict=True)]))

    docs = files.select("part", "seq", "doc_ids", "shard").mapInArrow(run, schema)
    # ids before a shard: running sums over the shards of a part, and over the parts (a row each)
    sizes = files.select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("ahead"))
    own = sizes.select("part", "seq", (F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")).alias("inside"))
    at = own.join(earlier, "part").select("part", "seq", (F.col("ahead") + F.col("inside")).alias("at"))
    return docs.join(at, ["part", "seq"]).select("doc_id", (F.col("at") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def encoded(docs: DataFrame, **cols) -> DataFrame:
    """Write the shards to the shared folder and give what the files hold."""
    path = scratch(docs.sparkSession, "tokens")
    write_tokens(docs, path, **cols)
    return read_tokens(docs.sparkSession, path)
