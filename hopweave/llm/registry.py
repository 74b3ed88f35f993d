"""opN_<name> queries over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_replay, forced_bpe, hard_negatives, harmonic_pack, langid, merkle, quality_crf, rp_forest, secret_scan, simhash_bk, suffix_dedup, token_counts, token_output
from .common import new_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_rans_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_output.token_digests(_table(spark, sf_dir, "documents"), new_path(spark, "token-file"), path, end_id=0)


def op2_suffix_merge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(_table(spark, sf_dir, "documents"), length=400, passage=suffix_dedup.PASSAGE)


def op3_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp_forest.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op4_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(_table(spark, sf_dir, "documents"))


def op5_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_crf.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).drop("content_share")


def op6_bpe_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_replay.encoded(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken")).drop("ids")


def op7_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return harmonic_pack.pack(_table(spark, sf_dir, "documents"), path, end_id=1, capacity=2048).drop("ids")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op9_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_bk.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_marginal_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_forced_boundary_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forced_bpe.encoded(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).drop("ids")


def op12_bitsliced_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mined(hard_negatives.shifted(_table(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op4_trigram_secrets": secret_scan.oracle_sql(), "op12_bitsliced_negatives": hard_negatives.oracle_sql(), "op13_merkle_manifest": merkle.oracle_sql()}
