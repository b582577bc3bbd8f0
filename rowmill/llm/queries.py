"""The registered queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.llm import bpe, decontaminate, hard_negatives, line_dedup, minhash_dedup, packing, pii, prefix_trie, quality_rules, secrets, sql, substring_dedup, suffix_dedup, toxicity


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(line_dedup.line_dedup(_documents(spark, sf_dir)))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.pii(_documents(spark, sf_dir)))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.substring_dedup(_documents(spark, sf_dir)))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.minhash_dedup(_documents(spark, sf_dir), shingle=4)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.secrets(_documents(spark, sf_dir)))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.decontaminate(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.digest(quality_rules.quality_rules(_documents(spark, sf_dir)))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.suffix_dedup(_documents(spark, sf_dir)))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir)).withColumn("sequence_id", F.col("sequence_id").cast("long"))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(bpe.encode(_documents(spark, sf_dir)))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    operators = (
        op1_line_dedup, op2_pii, op3_substring_dedup, op4_minhash_dedup, op5_secrets, op6_decontamination, op7_quality_rules, op8_toxicity, op9_suffix_dedup,
        op10_best_fit_packing, op11_bpe, op12_hard_negatives, op13_prefix_trie,
    )
    return {f.__name__: f for f in operators}


def oracle_sql() -> dict[str, str]:
    """The others need positions of matches, trained models, tokenizers or windows of bytes; tests hold them against brute force."""
    return {"op3_substring_dedup": sql.OP3, "op4_minhash_dedup": sql.OP4, "op7_quality_rules": sql.OP7, "op12_hard_negatives": sql.OP12, "op13_prefix_trie": sql.OP13}
