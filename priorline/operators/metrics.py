"""Metrics of probabilities (p) against labels (y), as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EDGE = 1e-6
BINS = 10

#: Cells of equal width into which probabilities are dealt for ranking.
RANK_CELLS = 4096


def clipped(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(EDGE)), F.lit(1 - EDGE))


def row_log_loss(y: Column, p: Column) -> Column:
    q = clipped(p)
    return -(y * F.ln(q) + (1 - y) * F.ln(1 - q))


def log_loss(y: Column, p: Column) -> Column:
    return F.avg(row_log_loss(y, p))


def brier(y: Column, p: Column) -> Column:
    return F.avg(F.pow(p - y, 2))


def accuracy(y: Column, p: Column) -> Column:
    return F.avg(((p >= 0.5).cast("int") == y).cast("double"))


def calibration_bins(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Equal-width bins of the clipped probability; empty ones are left out."""
    q = clipped(F.col("p"))
    number = F.least(F.floor(q * BINS), F.lit(BINS - 1)).cast("int")
    return scored.groupBy(*(by or []), number.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(q).alias("mean_p"), F.avg("y").alias("rate"))


def expected_calibration_error(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    by = by or []
    gap = F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("rate"))) / F.sum("n")
    return calibration_bins(scored, by).groupBy(*by).agg(gap.alias("ece"))


def roc_auc(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The chance that a positive outranks a negative, ties counting half; null with one class only.

    Rows meet as one per distinct probability. Running counts go along the values of a cell of equal width, and along the
    cells' totals, of which there are RANK_CELLS at most, so no task sees all values.
    """
    by = by or []
    cell = F.floor(F.col("p") * RANK_CELLS).alias("_cell")
    values = scored.groupBy(*by, cell, "p").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = values.groupBy(*by, "_cell").agg(F.sum("neg").alias("_neg")).withColumn("_before", F.coalesce(F.sum("_neg").over(before), F.lit(0))).drop("_neg")
    inside = Window.partitionBy(*by, "_cell").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    met = cells.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_cell").alias("_c"), "_before")
    same = F.col("_cell").eqNullSafe(F.col("_c"))
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_by{i}"))
    ranked = values.withColumn("_own", F.coalesce(F.sum("neg").over(inside), F.lit(0))).join(met, same).withColumn("below", F.col("_own") + F.col("_before"))
    won = F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2))
    return ranked.groupBy(*by).agg(F.try_divide(won, F.sum("pos") * F.sum("neg")).alias("auc"))


def breakdowns(scored: DataFrame, dimensions: dict[str, Column]) -> DataFrame:
    """Metrics by each value of each dimension, from one pass: rows are spread over (dimension, value)."""
    spread = F.explode(F.array(*[F.struct(F.lit(n).alias("dimension"), F.coalesce(c.cast("string"), F.lit("unknown")).alias("value")) for n, c in dimensions.items()]))
    rows = scored.select("y", "p", spread.alias("d"))
    return rows.groupBy("d.dimension", "d.value").agg(F.count(F.lit(1)).alias("n"), log_loss(F.col("y"), F.col("p")).alias("log_loss"), brier(F.col("y"), F.col("p")).alias("brier"), accuracy(F.col("y"), F.col("p")).alias("accuracy"))


def cluster_losses(scored: DataFrame, cluster: str) -> DataFrame:
    return scored.groupBy(cluster).agg(F.sum(row_log_loss(F.col("y"), F.col("p"))).alias("loss"), F.count(F.lit(1)).alias("n"))


def bootstrap_interval(clusters: DataFrame, iterations: int = 1000, seed: int = 0, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Percentile interval of the mean loss when clusters are drawn anew; null with fewer than two clusters.

    Every cluster draws a Poisson number of copies for each iteration from a hash of its name, so draws need no
    list of clusters on the driver and reruns agree. It stands in for drawing exactly as many clusters as
    there are; for more than a few dozen clusters the intervals agree closely.
    """
    name = clusters.columns[0]
    draws = F.explode(F.sequence(F.lit(0), F.lit(iterations - 1)))
    u = (F.pmod(F.xxhash64(F.lit(seed), "i", name), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    steps, total, term = [], 0.0, 0.36787944117144233
    for k in range(12):
        total += term
        steps.append(total)
        term /= k + 1
    copies = sum(((F.col("u") > s).cast("int") for s in steps[1:]), (F.col("u") > steps[0]).cast("int"))
    drawn = clusters.withColumn("i", draws).withColumn("u", u).withColumn("c", copies)
    means = drawn.groupBy("i").agg(F.try_divide(F.sum(F.col("c") * F.col("loss")), F.sum(F.col("c") * F.col("n"))).alias("mean"))
    ends = means.agg(F.percentile("mean", F.lit(low)).alias("low"), F.percentile("mean", F.lit(high)).alias("high"))
    size = clusters.agg(F.count(F.lit(1)).alias("clusters"))
    both = ends.withColumn("_k", F.lit(0)).join(size.withColumn("_k", F.lit(0)), "_k")
    return both.select("clusters", F.when(F.col("clusters") > 1, F.col("low")).alias("low"), F.when(F.col("clusters") > 1, F.col("high")).alias("high"))
