"""Rows that fail a check go to a quarantine with a reason; nothing is dropped silently."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Check = tuple[str, Column]


def failures(checks: Sequence[Check]) -> Column:
    """All reasons of a row, in the checks' order; a check's column says when a row fails, null counting as failure."""
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(reason)) for reason, bad in checks]))


def marked(rows: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """Adds reason: the first check that fails, or null."""
    return rows.withColumn("reason", F.try_element_at(failures(checks), F.lit(1)))


def split(rows: DataFrame, checks: Sequence[Check], key: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): rejected rows have key, reason and the row as JSON details."""
    all_rows = marked(rows, checks)
    details = F.to_json(F.struct(*sorted(rows.columns))).alias("details")
    return all_rows.filter("reason is null").drop("reason"), all_rows.filter("reason is not null").select(key, "reason", details)


def first_wins(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adds duplicate: whether a row with this key stands earlier."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("duplicate", F.row_number().over(w) > 1)


def unique_value(column: str) -> Column:
    """A group's one non-empty value as struct(value, n): n is how many different ones there are."""
    values = F.collect_set(F.nullif(F.trim(F.col(column).cast("string")), F.lit("")))
    return F.struct(F.when(F.size(values) == 1, values[0]).alias("value"), F.size(values).alias("n"))


def complete(source: DataFrame, accepted: DataFrame, rejected: DataFrame, key: str) -> DataFrame:
    """Ids that are in the source but in neither result, or the other way round; empty if the split is complete."""
    out = accepted.select(key).unionAll(rejected.select(key))
    lost = source.select(key).exceptAll(out).withColumn("side", F.lit("lost"))
    return lost.unionAll(out.exceptAll(source.select(key)).withColumn("side", F.lit("invented")))
