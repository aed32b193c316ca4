"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash_dedup import minhash_components

    return minhash_components(_table(spark, sf_dir, "documents"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import read_token_files, write_token_files

    return read_token_files(write_token_files(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json")))


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import digests, encode_pieces

    path = tokenizer_file("piece_bpe_32k.model")
    return digests(encode_pieces(_table(spark, sf_dir, "documents").select("doc_id", "text"), path).drop("text"), path)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit_toxicity, score_toxicity

    docs = _table(spark, sf_dir, "documents")
    scored = score_toxicity(docs.select("doc_id", "text", "lang"), fit_toxicity(docs, _table(spark, sf_dir, "labels")))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted", "over_threshold")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import suffix_dedup

    return suffix_dedup(_table(spark, sf_dir, "documents")).drop("kept")


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mix_sources import mix_sources

    return mix_sources(_table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    return dedup_lines(_table(spark, sf_dir, "documents"), count_col="n_removed")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import scan_secrets

    return scan_secrets(_table(spark, sf_dir, "documents"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ivf_pq import neighbours

    return neighbours(_table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0")


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_topk import exact_topk

    return exact_topk(_table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


def op11_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash_dedup import simhash_components

    return simhash_components(_table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import hard_negatives

    vectors = _table(spark, sf_dir, "embeddings")
    relabelled = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", relabelled), "vec_id % 100 = 0")


def op13_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .importance_resample import resample

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample(docs, _table(spark, sf_dir, "benchmark")).drop("text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {f.__name__: f for f in (op1_minhash_dedup, op2_token_files, op3_pieces, op4_toxicity, op5_suffix_dedup, op6_mix_sources, op7_line_dedup, op8_secret_scan, op9_neighbours, op10_exact_topk)}
    found |= {f.__name__: f for f in (op11_simhash_dedup, op12_hard_negatives, op13_importance_resample)}
    return found


def oracle_sql() -> dict[str, str]:
    from . import exact_topk, hard_negatives, importance_resample, mix_sources

    found = {"op6_mix_sources": mix_sources.ORACLE, "op10_exact_topk": exact_topk.ORACLE}
    return found | {"op12_hard_negatives": hard_negatives.ORACLE, "op13_importance_resample": importance_resample.ORACLE}
