"""Chronological splits. Rows of one time are never parted; sizes are counted in distinct times."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def time_numbers(rows: DataFrame, ts: str = "ts") -> DataFrame:
    """(ts, k): distinct times, numbered from 0; the window goes over times, not rows."""
    return rows.select(ts).distinct().select(ts, (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(ts)) - 1).cast("long").alias("k"))


def numbered(rows: DataFrame, ts: str = "ts") -> tuple[DataFrame, int]:
    times = time_numbers(rows, ts)
    return rows.join(times, ts), times.count()


def by_fraction(rows: DataFrame, train: float, validation: float, tail: float = 0.0, ts: str = "ts") -> DataFrame:
    """Adds split: train, calibration (the last part of train), validation, test."""
    marked, n = numbered(rows, ts)
    a, b = math.floor(n * train), math.floor(n * validation)
    if n < 10 or min(a, b, n - a - b) < 2:
        raise ValueError(f"{n} distinct times are too few for these fractions")
    calibration = max(1, math.ceil(a * tail)) if tail else 0
    if a - calibration < 2:
        raise ValueError("calibration leaves too little to fit on")
    k = F.col("k")
    split = F.when(k < a - calibration, "train").when(k < a, "calibration").when(k < a + b, "validation").otherwise("test")
    return marked.withColumn("split", split).drop("k")


def by_boundary(rows: DataFrame, validation_from: str, test_from: str, ts: str = "ts") -> DataFrame:
    if validation_from >= test_from:
        raise ValueError("validation must start before test")
    v, t = (F.lit(x).cast("timestamp_ntz") for x in (validation_from, test_from))
    return rows.withColumn("split", F.when(F.col(ts) < v, "train").when(F.col(ts) < t, "validation").otherwise("test"))


def rolling_sizes(n: int, validation: float, test: float, folds: int) -> tuple[int, int, int]:
    v, t = max(2, math.floor(n * validation)), max(2, math.floor(n * test))
    first = n - v - folds * t
    if first < 4:
        raise ValueError(f"{n} distinct times are too few for {folds} folds")
    return first, v, t


def rolling(rows: DataFrame, validation: float, test: float, folds: int, ts: str = "ts") -> DataFrame:
    """Rows once for each expanding fold they take part in, with fold and split; the last fold ends at the last time."""
    marked, n = numbered(rows, ts)
    first, v, t = rolling_sizes(n, validation, test, folds)
    fold = F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))
    end = F.lit(first) + F.col("fold") * t
    split = F.when(F.col("k") < end, "train").when(F.col("k") < end + v, "validation").when(F.col("k") < end + v + t, "test")
    return marked.withColumn("fold", fold).withColumn("split", split).filter("split is not null").drop("k")


def nested(rows: DataFrame, validation: float, test: float, outer: int, inner: int, ts: str = "ts") -> DataFrame:
    """Outer folds whose history (train and validation) is split again into inner rolling folds; test rows score."""
    marked, n = numbered(rows, ts)
    first, v, t = rolling_sizes(n, validation, test, outer)
    parts = []
    for k in range(outer):
        history = first + k * t + v
        a, iv, it = rolling_sizes(history, validation, test, inner)
        for i in range(inner):
            end = a + i * it
            label = F.when(F.col("k") < end, "train").when(F.col("k") < end + iv, "validation").when(F.col("k") < end + iv + it, "test")
            parts.append((k, i, label))
        parts.append((k, -1, F.when((F.col("k") >= history) & (F.col("k") < history + t), "score")))
    labels = F.array(*[F.struct(F.lit(k).alias("outer_fold"), F.lit(i).alias("inner_fold"), label.alias("split")) for k, i, label in parts])
    spread = marked.withColumn("f", F.explode(F.filter(labels, lambda x: x["split"].isNotNull())))
    return spread.select(*rows.columns, "f.*")


def trailing(rows: DataFrame, share: float, least_fit: int = 4, ts: str = "ts") -> DataFrame:
    """Adds part: fit, or calibration for the last share of times."""
    marked, n = numbered(rows, ts)
    tail = max(2, math.ceil(n * share))
    if n - tail < least_fit:
        raise ValueError("too few times to fit on")
    return marked.withColumn("part", F.when(F.col("k") < n - tail, "fit").otherwise("calibration")).drop("k")


def recency_weights(rows: DataFrame, half_life_days: float, ts: str = "ts") -> DataFrame:
    """Adds weight: halved for each half-life before the newest row."""
    newest = rows.agg(F.max(ts).alias("_newest"))
    days = (F.unix_micros(F.col("_newest").cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))) / 86_400_000_000.0
    joined = rows.withColumn("_k", F.lit(0)).join(newest.withColumn("_k", F.lit(0)), "_k")
    return joined.withColumn("weight", F.pow(F.lit(0.5), days / half_life_days)).select(*rows.columns, "weight")
