"""The queries of this subpackage: name -> (callable(spark, sf_dir), DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyrisk.llm import collocations, decontaminate, fmindex, langid, linededup, minhash, oracles, packing, repair, repeats, sharding, sparse_suffix, topk, toxicity, whitening
from skyrisk.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(fmindex.substring_dedup(table(spark, sf_dir, "documents")))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digest(linededup.dedup_lines(table(spark, sf_dir, "documents")))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(sparse_suffix.suffix_array_dedup(table(spark, sf_dir, "documents")))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.find_overlap(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_token_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.encoded(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predict(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def registry() -> dict[str, tuple[Query, str | None]]:
    return {
        "op1_substring_dedup": (op1_substring_dedup, oracles.REPEATS),
        "op2_line_dedup": (op2_line_dedup, oracles.LINE_DEDUP),
        "op3_suffix_array_dedup": (op3_suffix_array_dedup, oracles.REPEATS),
        "op4_sharding": (op4_sharding, sharding.oracle()),
        "op5_benchmark_decontamination": (op5_benchmark_decontamination, oracles.DECONTAMINATION),
        "op6_minhash_near_dedup": (op6_minhash_near_dedup, oracles.NEAR_DUPLICATES),
        "op7_token_repair": (op7_token_repair, None),
        "op8_language_id": (op8_language_id, None),
        "op9_best_fit_packing": (op9_best_fit_packing, None),
        "op10_exact_topk": (op10_exact_topk, oracles.TOP_K),
        "op11_phrase_collocations": (op11_phrase_collocations, oracles.COLLOCATIONS),
        "op12_embedding_whitening": (op12_embedding_whitening, None),
        "op13_toxicity": (op13_toxicity, None),
    }
