"""Series of games: sessions, sequence checks and the score before each game."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(rows: DataFrame, group: list[str], game: str, order: list[str]) -> DataFrame:
    """Adds run: a new one begins with every game 1; rows before the first have run 0."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("run", F.coalesce(F.sum(F.when(F.col(game) == 1, 1)).over(w), F.lit(0)))


def validated(rows: DataFrame, series: list[str], game: str, ts: str, order: list[str] | None = None) -> DataFrame:
    """Adds problem to all rows of a series: its games are not 1 to n, or times do not rise; else null."""
    w = Window.partitionBy(*series).orderBy(game, *(order or []))
    bad_number = (F.row_number().over(w) != F.col(game)).cast("int")
    bad_time = F.coalesce((F.lag(ts).over(w) >= F.col(ts)).cast("int"), F.lit(0))
    whole = Window.partitionBy(*series)
    flagged = rows.withColumn("_n", bad_number).withColumn("_t", bad_time)
    problem = F.when(F.max("_n").over(whole) == 1, "invalid_series_sequence").when(F.max("_t").over(whole) == 1, "invalid_series_timestamps")
    return flagged.withColumn("problem", problem).drop("_n", "_t")


def score_before(rows: DataFrame, series: list[str], team: str, win: str, order: list[str]) -> DataFrame:
    """Adds wins_before: the team's wins in earlier games of the series."""
    w = Window.partitionBy(*series, team).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("wins_before", F.coalesce(F.sum(win).over(w), F.lit(0)))


def series_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *parts).cast("binary"), 256), 1, 24))
