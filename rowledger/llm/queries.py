"""One query per operator over its whole table, with the parameters of production."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowledger.llm import decontaminate, html, language, licenses, lm, mixing, neardup, pii, quality, resampling, sharding, toxicity, whitening
from rowledger.llm.common import documents, held_out, table


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text."""
    return pii.personal_data_report(documents(spark, sf_dir))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, also with other numbers and names in them."""
    return decontaminate.contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and compression bands."""
    return quality.quality_rules(documents(spark, sf_dir))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents replicated so that sources get their target weights, in random order."""
    return mixing.mix_sources(documents(spark, sf_dir))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html.extract_main_text(table(spark, sf_dir, "pages"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every text under a model of the texts that are not held out."""
    return lm.score_texts(documents(spark, sf_dir), held_out(F.col("doc_id"), 7, 2))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and text blocks that contain a license template."""
    return licenses.scan_licenses(documents(spark, sf_dir)).drop("blocks")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text, learned from labels that are not held out."""
    return toxicity.score_toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels"), held_out(F.col("doc_id"), 5, 0))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the smallest doc_id of its class of near copies."""
    return neardup.near_duplicates(documents(spark, sf_dir)).select("doc_id", "class_id")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, learned from those that are not held out."""
    return language.identify_language(documents(spark, sf_dir), held_out(F.col("doc_id"), 4, 2))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of every sound vector."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight of every document towards the benchmark's texts, and the place of those drawn."""
    return resampling.resample(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    return sharding.shard_documents(documents(spark, sf_dir))


REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_personal_data, op2_decontaminate, op3_quality_rules, op4_mix_sources, op5_main_text, op6_lm_score,
        op7_license_scan, op8_toxicity, op9_near_duplicates, op10_language,
        op11_whitening, op12_importance_resampling, op13_sharding,
    )
}

# the others have models, parsers or regular expressions that SQL doesn't; they are tested against brute force
ORACLES: dict[str, str] = {"op4_mix_sources": mixing.oracle(), "op12_importance_resampling": resampling.oracle(), "op13_sharding": sharding.oracle()}
