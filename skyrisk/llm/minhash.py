"""Near-duplicate classes with DartMinHash over word shingles.

A document is the weighted set of its runs of five words (ASCII letters lower-cased; a shorter text is
one run), each weighted by its count.  Two documents are linked if their weighted Jaccard similarity is
``SIMILARITY`` or more, and a class is a connected component of links.

1. Texts with equal words are one node (a 128-bit hash), so groups of copies cost one node.
2. DartMinHash: darts fall on an (element, weight, rank) space as a Poisson process that is drawn from
   hashes of (element, unit of weight, strip of rank), so that all documents see the same darts.  A dart
   counts if it lies under the element's weight, has a hashed coordinate, and each coordinate keeps the
   dart of least rank.  Strips are thrown from rank 0 on until no coordinate is empty, which takes about
   ``t ln t`` darts however many elements there are.
3. ``BANDS`` bands of ``ROWS`` coordinates each are hashed to buckets.  No bucket emits all its pairs.
   First each node is paired with the smallest bucket fellow it has and with its neighbours in the
   bucket, ordered by the following bands, so that the most alike stand together.  Then, round by round,
   nodes up to ``ROUND_REACH`` apart in a newly hashed order that are in different components are paired, while
   at least one pair in ``YIELD`` is a link.  These rounds only make large groups of near copies few nodes.
4. What is left is finished exactly: in buckets of up to ``REACH`` + 1 nodes all pairs of different
   components, held in one task; the nodes of larger buckets are joined on the rarest shingles of each
   (prefix filter: two texts of similarity 0.8 share one of the rarest fifth of either) if their sizes and
   the places of the shared shingle leave room for 0.8.  The order by rarity is by counts in ``CELLS``
   hashed cells; any order is exact.
5. Each pair is checked by the exact similarity of the whole texts.

Defined cases: null texts and texts without words are linked to nothing, each its own class; rows that
repeat id and text are copies; null ids take part and name a class only if it has no other id; an empty
table gives no rows; ties need no rule, as the class is named by its smallest id.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyrisk.llm.common import BROADCAST_ROWS, WordHashes, dropped, held_in_worker, id_text, mix, small, working, written
from skyrisk.llm.components import components

SHINGLE = 5
SIMILARITY = (4, 5)
BANDS, ROWS = 26, 5
REACH = 16
ROUND_REACH = 4
YIELD = 100
CELLS = 1 << 20
SLICE_PAIRS = 200_000

_STEP = np.uint64(0x9E3779B97F4A7C15)


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)) * 2.0**-53


class Shingler(WordHashes):
    """Hashed shingles of texts."""

    def shingles(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The distinct shingles (64-bit) and their counts."""
        w = self.of(words)
        n = min(SHINGLE, len(w))
        out = np.zeros(len(w) - n + 1, np.uint64)
        for k in range(n):
            out = mix(out + w[k:len(w) - n + 1 + k] + _STEP)
        return np.unique(out, return_counts=True)


FIRST = 8  # the first strip of ranks is [0, 2**-FIRST); strips double up to a half, then all are halves


def _strip(k: int) -> tuple[float, float, int]:
    """First rank, width, and the row of ``_DARTS``."""
    if k == 0:
        return 0.0, 2.0**-FIRST, 0
    if k < FIRST:
        return 2.0 ** (k - 1 - FIRST), 2.0 ** (k - 1 - FIRST), k - 1
    return (k - FIRST + 1) / 2, 0.5, FIRST - 1


def _at_most(mean: float) -> list[float]:
    """Chances of at most 0, 1, 2 ... darts, of 2**64."""
    p = [math.exp(-mean)]
    while len(p) < 16:
        p.append(p[-1] * mean / len(p))
    return [min(x, 1.0) * 2.0**64 for x in itertools.accumulate(p)]


_DARTS = np.array([_at_most(2.0 ** (i - FIRST)) for i in range(FIRST)])
_NONE = np.array([int(x) for x in _DARTS[:, 0]], np.uint64)


def dart_minhash(elements: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    """``size`` coordinates; two sets agree in each with the probability of their weighted Jaccard similarity.
    ``weights`` are positive and may be fractions."""
    units = np.ceil(weights).astype(np.int64)
    owner = np.repeat(np.arange(len(elements)), units)
    unit = np.arange(len(owner)) - np.repeat(np.cumsum(units) - units, units)
    seed = mix(elements[owner] + _STEP * (unit + 1).astype(np.uint64))
    room = weights[owner] - unit  # how much of this unit of weight the element has
    out, empty = np.zeros(size, np.uint64), np.ones(size, bool)
    upto, k = size * (math.log(size) + 1) / float(weights.sum()), 0
    while empty.any():
        strips = [_strip(k)]
        while strips[-1][0] + strips[-1][1] < upto and len(strips) * len(seed) < 1 << 18:
            strips.append(_strip(k + len(strips)))
        number = np.arange(k, k + len(strips), dtype=np.uint64)
        k += len(strips)
        upto = strips[-1][0] + strips[-1][1] + size / float(weights.sum())
        low, width, kind = (np.array(x) for x in zip(*strips, strict=True))
        region = seed[:, None] ^ mix((number + np.uint64(1)) * _STEP)[None, :]
        region = mix(region)
        row, strip = np.nonzero(region >= _NONE[kind][None, :])
        region = region[row, strip]
        darts, more = np.ones(len(row), np.int64), np.arange(len(row))
        for n in range(1, _DARTS.shape[1]):
            more = more[region[more] >= _DARTS[kind[strip[more]], n]]
            if not len(more):
                break
            darts[more] += 1
        nth = np.arange(int(darts.sum())) - np.repeat(np.cumsum(darts) - darts, darts)
        row, strip, region = np.repeat(row, darts), np.repeat(strip, darts), np.repeat(region, darts)
        dart = mix(region + _STEP * (nth + 1).astype(np.uint64))
        coordinate = (mix(dart + np.uint64(3)) % np.uint64(size)).astype(np.int64)
        fit = np.flatnonzero((_unit(mix(dart + np.uint64(1))) < room[row]) & empty[coordinate])
        dart, coordinate, strip = dart[fit], coordinate[fit], strip[fit]
        order = np.argsort(-(low[strip] + width[strip] * _unit(mix(dart + np.uint64(2)))), kind="stable")
        out[coordinate[order]] = dart[order]  # the last one set is the one of least rank
        empty[coordinate] = False
    return out


def _bands(signature: np.ndarray) -> list[int]:
    rows = signature.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _STEP
    for k in range(ROWS):
        key = mix(key + rows[:, k])
    return key.view(np.int64).tolist()


def words_of(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler, seen = held_in_worker("shingles", 0, Shingler), {}
    for batch in batches:
        nodes, bands = [], []
        for text in batch.column("text").cast(pa.binary()).to_pylist():
            words = words_of(text)
            node = hashlib.blake2b(b" ".join(words), digest_size=16).digest() if words else None
            if node and node not in seen:
                if len(seen) >= 20_000:
                    seen.clear()
                seen[node] = _bands(dart_minhash(*shingler.shingles(words), BANDS * ROWS))
            nodes.append(node)
            bands.append(seen[node] if node else None)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tkey"), pa.array(nodes, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                                         names=["doc_id", "tkey", "node", "bands"])


def similar(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> bool:
    """Whether the weighted Jaccard similarity of two shingle sets reaches ``SIMILARITY``; exact."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = int(np.minimum(a[1][i], b[1][j]).sum())
    return shared * SIMILARITY[1] >= (int(a[1].sum()) + int(b[1].sum()) - shared) * SIMILARITY[0]


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler = held_in_worker("shingles", 0, Shingler)
    for batch in batches:
        fine, last, own = [], None, None
        for a, b in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), strict=True):
            if a != last:
                last, own = a, shingler.shingles(a.split())
            fine.append(similar(own, shingler.shingles(b.split())))
        yield batch.select(["a", "b"]).append_column("linked", pa.array(fine, pa.bool_()))


def _adjacent(reach: int):
    """Pairs of nodes up to ``reach`` apart in a bucket, in different components; rows are sorted by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[tuple] = []
        for batch in batches:
            rows = [*last, *zip(*(batch.column(c).to_pylist() for c in ("key", "node", "comp")), strict=True)]
            a, b = [], []
            for i in range(len(last), len(rows)):
                key, node, comp = rows[i]
                for j in range(i - 1, max(i - reach, 0) - 1, -1):
                    if rows[j][0] != key:
                        break
                    if rows[j][2] != comp:
                        a.append(min(node, rows[j][1]))
                        b.append(max(node, rows[j][1]))
            last = rows[-reach:]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return run


_PAIR = "a binary, b binary"


def _check(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``a, b, linked`` by the exact similarity of the whole texts."""
    few = small(pairs)
    left = texts.join(few, F.col("node") == F.col("a")).select("a", "b", F.col("words").alias("text_a"))
    right = texts.join(few, F.col("node") == F.col("b")).select("a", "b", F.col("words").alias("text_b"))
    return written(left.join(right, ["a", "b"]).mapInArrow(_verified, f"{_PAIR}, linked boolean"), "checked")[0]


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = [b" ".join(words_of(x)) for x in batch.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(text, pa.binary())], names=["node", "words"])


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, comp) after new links between nodes."""
    ends = (labels.select(F.col("node").alias("a"), F.col("comp").alias("ca")).join(small(links), "a").select("ca", "b"))
    ends = labels.select(F.col("node").alias("b"), F.col("comp").alias("cb")).join(small(written(ends, "ends")[0]), "b")
    moved = components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(F.col("node").alias("comp"), F.col("comp").alias("to"))
    return written(labels.join(small(moved), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), "labels")[0]


def _neighbours(mixed: DataFrame, order: list, reach: int) -> DataFrame:
    """Pairs of nodes up to ``reach`` apart, in different components, of each bucket in the given order.  Rows are sorted by
    bucket over all partitions, so a hot bucket is cut into ranges; up to ``BROADCAST_ROWS`` rows go to one
    task."""
    n = int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    few = mixed.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    held = mixed.coalesce(1) if few else mixed.repartitionByRange(n, "key", *order)
    return held.sortWithinPartitions("key", *order).select("key", "node", "comp").mapInArrow(_adjacent(reach), _PAIR).distinct()


def _elements(shingler: Shingler, text: bytes) -> np.ndarray:
    """The shingles of a text as a set: the k-th of equal ones has a hash of its own."""
    shingle, count = shingler.shingles(text.split())
    nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    return mix(np.repeat(shingle, count) + _STEP * (nth + 1).astype(np.uint64))


def _cell(elements: np.ndarray) -> np.ndarray:
    return (elements & np.uint64(CELLS - 1)).astype(np.int64)


def _cell_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler, seen, held, size = held_in_worker("shingles", 0, Shingler), np.zeros(CELLS, np.int64), [], 0
    for batch in batches:
        for text in batch.column("words").to_pylist():
            held.append(_cell(_elements(shingler, text)))
            size += len(held[-1])
            if size > CELLS:
                seen += np.bincount(np.concatenate(held), minlength=CELLS)
                held, size = [], 0
    if held:
        seen += np.bincount(np.concatenate(held), minlength=CELLS)
    cells = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(seen[cells], pa.int64())], names=["cell", "n"])


def _prefixes(held):
    """The rarest elements of each text, of which two texts of similarity ``SIMILARITY`` share one, with their
    places in the order by rarity and the number of all elements."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, often = held_in_worker("shingles", 0, Shingler), held.value

        def out(batch, of, parts, sizes):
            long = np.array([len(x) for x in parts])
            row = np.repeat(np.array(of), long)
            at = np.arange(len(row)) - np.repeat(np.cumsum(long) - long, long)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(parts).view(np.int64)), pa.array(at, pa.int32()), pa.array(np.repeat(np.array(sizes), long), pa.int32()),
                 *(batch.column(c).take(pa.array(row)) for c in ("node", "comp"))], names=["element", "at", "size", "node", "comp"])

        for batch in batches:
            of, parts, sizes, rows = [], [], [], 0
            for i, text in enumerate(batch.column("words").to_pylist()):
                e = _elements(shingler, text)
                e = e[np.lexsort((e, often[_cell(e)]))]
                of.append(i)
                sizes.append(len(e))
                parts.append(e[:len(e) + 1 + (-len(e) * SIMILARITY[0] // SIMILARITY[1])])
                rows += len(parts[-1])
                if rows > 100_000:
                    yield out(batch, of, parts, sizes)
                    of, parts, sizes, rows = [], [], [], 0
            if of:
                yield out(batch, of, parts, sizes)

    return run


def _alike(texts: DataFrame) -> DataFrame:
    """All pairs of ``texts`` (node, words, comp) of different components that can reach ``SIMILARITY``."""
    counts = texts.select("words").mapInArrow(_cell_counts, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # up to CELLS rows
    often = np.zeros(CELLS, np.int64)
    often[counts.column("cell").to_numpy()] = counts.column("n").to_numpy()
    held = texts.sparkSession.sparkContext.broadcast(often)
    rows, path = written(texts.select("node", "words", "comp").mapInArrow(_prefixes(held), "element long, at int, size int, node binary, comp binary"), "prefixes")
    held.destroy()
    a, b = (rows.select("element", *(F.col(c).alias(f"{c}_{x}") for c in ("at", "size", "node", "comp"))) for x in "ab")
    p, q = SIMILARITY
    # the shared elements are at or behind the first one that both have
    room = F.least(F.expr("size_a - at_a"), F.expr("size_b - at_b")) * (p + q) >= (F.col("size_a") + F.col("size_b")) * p
    fit = (F.col("node_a") < F.col("node_b")) & (F.col("comp_a") != F.col("comp_b")) & room
    fit &= (F.col("size_a") * p <= F.col("size_b") * q) & (F.col("size_b") * p <= F.col("size_a") * q)
    pairs = written(a.join(b, (a["element"] == b["element"]) & fit).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct(), "alike")[0]
    dropped(texts.sparkSession, path)
    return pairs


def _finished(mixed: DataFrame, labels: DataFrame, texts: DataFrame, tried: DataFrame) -> DataFrame:
    """``labels`` after all pairs of different components in ``mixed`` that were not tried."""
    sizes = mixed.groupBy("key").agg(F.count("*").alias("n"))
    few = mixed.join(sizes.where(f"n <= {REACH + 1}"), "key").repartition("key").sortWithinPartitions("key", "node")
    pairs = few.select("key", "node", "comp").mapInArrow(_adjacent(REACH), _PAIR).distinct()
    many, _ = written(mixed.join(sizes.where(f"n > {REACH + 1}").select("key"), "key", "left_semi").select("node", "comp").distinct(), "many")
    if not many.isEmpty():
        pairs = pairs.unionAll(_alike(texts.join(small(many), "node"))).distinct()
    pairs = written(pairs.join(small(tried), ["a", "b"], "left_anti"), "pairs")[0]
    slices = -(-pairs.count() // max(SLICE_PAIRS, texts.count()))  # so that the texts of the pairs need bounded room at a time
    for s in range(slices):
        part = pairs.where(F.pmod(F.xxhash64("a", "b"), F.lit(slices)) == s)
        if s:
            for x in "ab":
                part = part.join(small(labels.select(F.col("node").alias(x), F.col("comp").alias(f"c{x}"))), x)
            part = written(part.where("ca <> cb").select("a", "b"), "slice")[0]
        links = _check(part, texts).where("linked").select("a", "b")
        if not links.isEmpty():
            labels = _merged(labels, links)
    return labels


def near_members(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, tkey, node, comp``: the node of each row's words and its component (null without words)."""
    with working(docs.sparkSession):
        return written(_members(docs, id_col, text_col), "members", result=True)[0]


def _members(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    frame = id_text(docs, id_col, text_col).withColumn("tkey", F.xxhash64("text"))
    schema = T.StructType([frame.schema["doc_id"], T.StructField("tkey", T.LongType()), T.StructField("node", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])
    signed, _ = written(frame.mapInArrow(_nodes, schema), "signed")
    worded = signed.where(F.col("node").isNotNull())
    nodes = worded.groupBy("node").agg(F.first("bands").alias("bands"))
    keys = nodes.select("node", F.posexplode("bands").alias("i", "key"), "bands").select(
        "key", "node", *(F.col("bands")[(F.col("i") + k) % BANDS].alias(f"o{k}") for k in (1, 2)))
    keys, p2 = written(keys, "keys")
    shared = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("least")).where("n > 1").select("key", "least")
    buckets, _ = written(keys.join(shared, "key"), "buckets")
    dropped(spark, p2)

    # the texts of the nodes that share a bucket, read once
    some = buckets.select("node").distinct()
    first = worded.join(small(written(some, "bucket-nodes")[0]), "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "tkey")).alias("at"))
    wanted, _ = written(first.select("node", F.col("at.doc_id").alias("i"), F.col("at.tkey").alias("t")), "wanted")
    at = F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("tkey") == F.col("t"))
    texts, _ = written(frame.join(small(wanted), at).select("node", "text").mapInArrow(_words, "node binary, words binary"), "texts")

    labels = wanted.select("node", F.col("node").alias("comp"))
    mixed = buckets.withColumn("comp", F.col("node"))
    star = buckets.where("least <> node").groupBy("node").agg(F.min("least").alias("a")).select("a", F.col("node").alias("b"))
    pairs = written(star.unionAll(_neighbours(mixed, ["o1", "o2", "node"], 1)).distinct(), "pairs")[0]
    tried, turn = None, 0
    while not pairs.isEmpty():
        done = _check(pairs, texts)
        tried = done if tried is None else tried.unionAll(done)
        links = done.where("linked").select("a", "b")
        linked = links.count()
        if linked:
            labels = _merged(labels, links)
        # components only grow together, so a bucket of one component is done with
        mixed = mixed.select("key", "node").join(small(labels), "node")
        more = mixed.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("key")
        mixed = written(mixed.join(more, "key", "left_semi"), "mixed")[0]
        if turn and linked * YIELD < done.count():
            break
        turn += 1
        new = _neighbours(mixed, [F.xxhash64("node", F.lit(turn))], ROUND_REACH)
        pairs = written(new.join(small(tried.select("a", "b")), ["a", "b"], "left_anti"), "pairs")[0]
    if tried is not None and not mixed.isEmpty():
        labels = _finished(mixed, labels, texts, tried.select("a", "b"))
    return signed.select("doc_id", "tkey", "node").join(labels, "node", "left").select("doc_id", "tkey", "node", F.coalesce("comp", "node").alias("comp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, class_id, class_docs``: one row per document; the class is named by its smallest id."""
    members = near_members(docs, id_col, text_col)
    classes = members.where(F.col("comp").isNotNull()).groupBy("comp").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_docs"))
    linked = members.where(F.col("comp").isNotNull()).join(classes, "comp").select("doc_id", "class_id", "class_docs")
    alone = members.where(F.col("comp").isNull()).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_docs"))
    return linked.unionAll(alone)


def first_of_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, that are the first of their class; of rows that repeat id and
    text one stays."""
    members = near_members(docs, id_col, text_col)
    best = members.where(F.col("comp").isNotNull()).groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tkey")).alias("best"), F.count("*").alias("n")).where("n > 1").select("comp", "best")
    held = members.where(F.col("comp").isNotNull()).join(best, "comp")
    same = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("tkey") == F.col("best.tkey"))
    off, _ = written(held.where(~same).select(F.col("doc_id").alias("__i"), F.col("tkey").alias("__t")).distinct(), "later")
    twice, _ = written(held.where(same).groupBy("doc_id", "tkey").agg(F.count("*").alias("n")).where("n > 1")
                       .select(F.col("doc_id").alias("__i"), F.col("tkey").alias("__t")), "twice")
    on = docs[id_col].eqNullSafe(F.col("__i")) & (F.xxhash64(docs[text_col].cast("string")) == F.col("__t"))
    kept = docs.join(small(off), on, "left_anti")
    if twice.isEmpty():
        return kept
    once = kept.join(small(twice), kept[id_col].eqNullSafe(F.col("__i")) & (F.xxhash64(kept[text_col].cast("string")) == F.col("__t")), "left_semi")
    rest = kept.join(small(twice), kept[id_col].eqNullSafe(F.col("__i")) & (F.xxhash64(kept[text_col].cast("string")) == F.col("__t")), "left_anti")
    return rest.unionAll(once.dropDuplicates([id_col, text_col]))
