"""The thin queries ``opN_<name>``: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kerf.llm.common import table


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kerf.llm.neardup import near_duplicate_report

    return near_duplicate_report(table(spark, sf_dir, "documents"))


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kerf.llm.repeats import repeat_report

    return repeat_report(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kerf.llm.quality import quality_report

    return quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kerf.llm.rules import rule_report

    return rule_report(table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kerf.llm.bpe import bpe_digests

    return bpe_digests(table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kerf.llm.secrets import secret_report

    return secret_report(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kerf.llm.pii import pii_report

    return pii_report(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kerf.llm.wordpiece import token_counts

    return token_counts(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kerf.llm.decontam import contamination_report

    return contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kerf.llm.tokenfile import token_file_digests

    return token_file_digests(table(spark, sf_dir, "documents"))


def op11_ball_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kerf.llm.balltree import cluster_report

    return cluster_report(table(spark, sf_dir, "embeddings"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kerf.llm.simhash import simhash_report

    return simhash_report(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kerf.llm.divergence import source_divergence

    return source_divergence(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from kerf.llm import sql

    return sql.ORACLES
