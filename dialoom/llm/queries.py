"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dialoom.llm import op01_substring, op02_toxicity, op03_quality, op04_wrappers, op05_packing, op06_url_filters, op07_suffix_tree, op08_jaccard, op09_media, op10_decontaminate, op11_vector_codes, op12_mixing, op13_repair
from dialoom.session import table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op01_substring.digest(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op02_toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op03_quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op04_wrappers.extract(table(spark, sf_dir, "pages"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op05_packing.packed(table(spark, sf_dir, "documents"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op06_url_filters.judge(table(spark, sf_dir, "pages"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op07_suffix_tree.score_texts(table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op08_jaccard.digest(table(spark, sf_dir, "documents"))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op09_media.digest(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_vector_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_vector_codes.digest(table(spark, sf_dir, "embeddings"))


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_mixing.digest(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_repair.digest(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_substring_dedup,
            op2_toxicity,
            op3_quality,
            op4_html_extraction,
            op5_packing,
            op6_url_filters,
            op7_lm_scoring,
            op8_jaccard_join,
            op9_media_columns,
            op10_decontamination,
            op11_vector_code_compression,
            op12_source_mixing,
            op13_conversation_repair,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_url_filters": op06_url_filters.ORACLE,
        "op10_decontamination": op10_decontaminate.ORACLE,
        "op11_vector_code_compression": op11_vector_codes.ORACLE,
        "op12_source_mixing": op12_mixing.ORACLE,
    }
