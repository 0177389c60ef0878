"""The operators' registered queries: each runs over the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import factorization, mixing, near_dedup, packing, quality_rules, revisits, spotsigs, suffixes, token_counts, toxicity
from .common import table
from .oracles import ORACLE  # noqa: F401


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"))


def op2_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.compared(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisits.resolved(revisits.captures(table(spark, sf_dir, "pages")))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), token_counts.byte_counting())


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), packing.word_packing())


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factorization.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_near_dedup, op2_spotsigs, op3_suffix_dedup, op4_toxicity, op5_warc_revisits, op6_token_counts, op7_quality_rules, op8_best_fit_packing, op9_source_mix, op10_quality_classifier)}
