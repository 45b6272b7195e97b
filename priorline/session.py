"""One place that builds a session, so that time zone, ANSI mode and AQE agree everywhere."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table, with a few columns each, that a join sends to all tasks; beyond, both sides are dealt by key.
MOST_SENT_ROWS = 2_000_000


def build_session(app: str = "priorline", cores: int | None = None, **conf: str) -> SparkSession:
    """A session with UTC times and AQE on; local unless a master is already configured."""
    cores = cores or os.cpu_count() or 8
    builder = SparkSession.builder.appName(app)
    if "SPARK_MASTER" not in os.environ:
        builder = builder.master(f"local[{cores}]")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": str(cores),
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; timestamps stay without a zone."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def looked_up(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table that another looks its keys up in: sent to all tasks if its rows, which are counted, are few."""
    rows = table(spark, sf_dir, name).select(*columns)
    return F.broadcast(rows) if rows.count() <= MOST_SENT_ROWS else rows
