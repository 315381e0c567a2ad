"""The queries of this subpackage, and SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galleyproof.llm import decontaminate, gif, html_text, near_dup, packing, quality, repeats, secrets, tokens, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(of: int):
    """crc32(doc_id as text) mod ``of``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % of


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), train=fold(4) != 2)
    return found.select("doc_id", (fold(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "evidence")


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.media_table(_table(spark, sf_dir, "documents"), with_media=False).drop("media")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_spans(_table(spark, sf_dir, "documents"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), train=fold(5) != 0)
    return found.select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_packing, op2_html_extraction, op3_secret_scans, op4_toxicity, op5_media_columns, op6_substring_dedup, op7_near_dedup, op8_quality, op9_decontamination, op10_token_counts)
    return {f.__name__: f for f in own}
