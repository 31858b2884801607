"""Queries over the given tables, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from attestra.llm import (
    decontaminate,
    edit_counts,
    exact_dedup,
    language_id,
    line_dedup,
    ngram_join,
    periodic_runs,
    pii,
    piece_lattice,
    quality,
    turn_repair,
    url_rules,
    warc,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data_report(table(spark, sf_dir, "documents"))


def op3_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_counts.edited_counts_report(table(spark, sf_dir, "documents"))


def op4_piece_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_lattice.piece_report(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup_report(table(spark, sf_dir, "documents"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicate_report(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_report(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup_report(table(spark, sf_dir, "documents"))


def op9_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives_report(table(spark, sf_dir, "pages"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


def op11_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.url_report(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair_report(table(spark, sf_dir, "conversations"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.periodic_report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_quality_classifier,
        op2_personal_data,
        op3_edit_counts,
        op4_piece_segmentation,
        op5_line_dedup,
        op6_ngram_jaccard_join,
        op7_language_id,
        op8_exact_dedup,
        op9_warc_derivatives,
        op10_decontamination,
        op11_url_rules,
        op12_conversation_repair,
        op13_periodic_runs,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    """Operators 1 to 4, 7, 11 and 13 have none: models, trees, segmentations and runs are tested against brute force instead."""
    return {
        "op5_line_dedup": line_dedup.SQL,
        "op6_ngram_jaccard_join": ngram_join.SQL,
        "op8_exact_dedup": exact_dedup.SQL,
        "op9_warc_derivatives": warc.SQL,
        "op10_decontamination": decontaminate.SQL,
        "op12_conversation_repair": turn_repair.SQL,
    }
