"""The training-corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

1. ``language_id``: texts without a language for at least half of their words go.
2. ``line_dedup``: lines that an earlier line repeats, but for one word, go; so does a document of which
   nothing is left.
3. ``near_dedup``: of each class of near duplicates the document with the smallest id stays.
4. ``decontamination``: passages of ten words or more of a benchmark item are cut out; a document that is
   such passages for more than half goes.
5. ``packing``: the texts that are left, as token sequences of 2048.

A stage gets all that the one before kept.  All but the last return the columns of ``documents``, with
``n_chars`` of a changed text counted anew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyrisk.llm import decontaminate, langid, linededup, minhash, packing
from skyrisk.llm.common import table, working, written


def _with_text(done: DataFrame, docs: DataFrame, changed: F.Column) -> DataFrame:
    """The columns of ``docs`` (the others are in ``kept``) with the text of ``done``."""
    new = {"text": F.col("text"), "n_chars": F.when(changed, F.length("text").cast("long")).otherwise(F.col("kept.n_chars"))}
    return done.select(*(new[c].cast(docs.schema[c].dataType).alias(c) if c in new else F.col("kept")[c].alias(c) for c in docs.columns))


def _others(docs: DataFrame) -> list[str]:
    return [c for c in docs.columns if c != "text"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.known_language(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = linededup.dedup_lines(docs, keep=_others(docs))
    left = F.col("text").rlike("[^ \\t-\\r]")  # something but white space
    return _with_text(done.where((F.col("n_removed") == 0) | left), docs, F.col("n_removed") > 0)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.first_of_class(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), keep=_others(docs))
    return _with_text(done, docs, F.col("n_hit") > 0)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: SQL has neither the learned model nor the tokenizer; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with working(spark):  # a stage's working tables go when its result is written
            docs, _ = written(stage(spark, docs, sf_dir), name, result=True)
    return docs
