"""Queries over the given tables: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import ship, table
from .oracles import ORACLE_SQL  # noqa: F401  read by the entry module


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import repeated_passages

    ship(spark)
    return repeated_passages(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_rows

    return shard_rows(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mixing_report

    ship(spark)
    return mixing_report(table(spark, sf_dir, "documents"))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash_dedup import near_duplicates

    ship(spark)
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract_main_text

    ship(spark)
    return extract_main_text(table(spark, sf_dir, "pages"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of both policies rejects, and what it alone rejects."""
    from .quality_rules import ablation_report

    return ablation_report(table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sp_lattice import encode

    ship(spark)
    return encode(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    ship(spark)
    return exact_dedup(table(spark, sf_dir, "documents"))


def op9_fm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fm_quality import quality_scores

    ship(spark)
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_dedup_report

    return line_dedup_report(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversation_repair import repair_report

    ship(spark)
    return repair_report(table(spark, sf_dir, "conversations"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle_manifest import verified

    return verified(table(spark, sf_dir, "documents"))


def op13_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .maxent_lm import language_scores

    ship(spark)
    return language_scores(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_sharding, op3_mixing, op4_minhash_dedup, op5_html_extract, op6_quality_rules, op7_sentencepiece, op8_exact_dedup, op9_fm_quality, op10_line_dedup, op11_conversation_repair, op12_merkle_manifest, op13_maxent_lm, quality_ablation)}
