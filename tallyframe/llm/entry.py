"""The queries opN_<name> over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyframe.llm import archives, bpe, infill, interactions, minhash, mpeg, oracle, packing, quality, secret_tags, sharding, suffixes, token_files, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.query(_table(spark, sf_dir, "documents"))


def op8_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.query(_table(spark, sf_dir, "pages"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.query(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.query(_table(spark, sf_dir, "documents"))


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.query(_table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.query(_table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.query(_table(spark, sf_dir, "documents"))


def op4_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg.query(_table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.query(_table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.query(_table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.query(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_secret_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_tags.query(_table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.query(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_token_files": op3_token_files,
    "op4_mpeg_audio": op4_mpeg_audio,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_sharding": op6_sharding,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_arc_to_warc": op8_arc_to_warc,
    "op9_toxicity": op9_toxicity,
    "op10_quality_rules": op10_quality_rules,
    "op11_filter_audit": op11_filter_audit,
    "op12_secret_crf": op12_secret_crf,
    "op13_fill_in_middle": op13_fill_in_middle,
}

SQL: dict[str, str] = {
    "op1_minhash_dedup": oracle.NEAR_DUPLICATES,
    "op2_suffix_dedup": oracle.REPEATED_STRINGS,
    "op8_arc_to_warc": archives.query_sql(),
    "op10_quality_rules": quality.query_sql(),
    "op11_filter_audit": interactions.QUERY_SQL,
    "op13_fill_in_middle": infill.QUERY_SQL,
}
