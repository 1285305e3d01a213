"""The corpus queries, one for each operator, over whole tables; and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, caps, decontaminate, extract, line_dedup, lm, minhash, oracles, suffix_dedup, surrogates, toxicity
from ._common import table


def op1_cap_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), threshold=85)


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_report(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_report(table(spark, sf_dir, "documents"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extraction_report(table(spark, sf_dir, "pages"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup_report(table(spark, sf_dir, "documents"))


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.surrogate_report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_cap_near_dedup": op1_cap_near_dedup,
        "op2_minhash_near_dedup": op2_minhash_near_dedup,
        "op3_bpe_round_trip": op3_bpe_round_trip,
        "op4_suffix_dedup": op4_suffix_dedup,
        "op5_benchmark_decontamination": op5_benchmark_decontamination,
        "op6_lm_scoring": op6_lm_scoring,
        "op7_toxicity": op7_toxicity,
        "op8_html_extraction": op8_html_extraction,
        "op9_line_dedup": op9_line_dedup,
        "op10_pii_surrogates": op10_pii_surrogates,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_cap_near_dedup": oracles.EMBEDDINGS,
        "op2_minhash_near_dedup": oracles.NEAR_DUPLICATES,
        "op4_suffix_dedup": oracles.REPEATS,
        "op5_benchmark_decontamination": oracles.CONTAMINATION,
        "op9_line_dedup": line_dedup.ORACLE_SQL,
    }
