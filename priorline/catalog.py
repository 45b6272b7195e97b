"""Named queries of the engine and, for each, the statement that DuckDB runs on the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from priorline import queries as themes  # noqa: F401  registers all
from priorline.registry import ORACLES, QUERIES, Query


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each side's strictly earlier record."""
    return QUERIES["pit_counts"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
