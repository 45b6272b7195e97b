"""The corpus operators' queries over the driver's tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from priorline.llm import leaks, lines, mixing, passages, personal, quality, secrets, sharding, simhash, substrings
from priorline.llm.common import documents
from priorline.llm.oracles import ORACLES


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = secrets.scan_documents(documents(spark, sf_dir).select("doc_id", "text"))
    return rows


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(documents(spark, sf_dir))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_drops(documents(spark, sf_dir))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.find_personal(documents(spark, sf_dir))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(documents(spark, sf_dir).select("doc_id", "text"), 24).drop("text")


def op8_near_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.passage_classes(documents(spark, sf_dir))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: value for name, value in globals().items() if name.startswith("op") and callable(value)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
