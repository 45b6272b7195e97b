"""Gates over small tables of metrics: all checks must hold, and there is a fallback."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gated(rows: DataFrame, checks: Sequence[tuple[str, Column]]) -> DataFrame:
    """Adds failed (names of failing checks, in order) and eligible; a check that is null fails."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks]))
    return rows.withColumn("failed", F.array_join(failed, ",")).withColumn("eligible", F.size(failed) == 0)


#: Probabilities that a candidate's row carries beside its own (p): what it is judged against.
CONTROLS = ("base", "elo", "roster", "current")
#: Fixed limits of the gates.
BREAKDOWN_ROWS = 100


def candidate_summary(rows: DataFrame, major: Sequence[str]) -> DataFrame:
    """One row per candidate and segment with all that the gates read.

    Rows have name, segment, fold, league, cluster, y, p and p_base, p_elo, p_roster, p_current of the same contest. One pass makes cells of
    (name, segment, fold, league, bin), out of which losses, calibration, folds and leagues roll up; a second one goes over clusters.
    worst_*: the largest regression in a fold or in a major league of at least BREAKDOWN_ROWS rows (null: none judged). upper_*: the upper end of the
    95% interval of the mean difference, from the spread between clusters (null with fewer than two).
    """
    from priorline.operators.metrics import BINS, clipped, row_log_loss

    by, y, p = ["name", "segment"], F.col("y"), F.col("p")
    q = clipped(p)
    scored = rows.select(
        "*", F.least(F.floor(q * BINS), F.lit(BINS - 1)).alias("bin"), q.alias("q"), row_log_loss(y, p).alias("loss"), F.pow(p - y, 2).alias("square"), F.pow(F.col("p_elo") - y, 2).alias("elo_square"),
        (p.isNull() | F.isnan(p) | (p < 0) | (p > 1)).cast("int").alias("broken"), *[row_log_loss(y, F.col(f"p_{c}")).alias(c) for c in CONTROLS],
    )
    summed = ["loss", *CONTROLS, "square", "elo_square", "broken", "q", "y"]
    cells = scored.groupBy(*by, "fold", "league", "bin").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in summed])

    def rolled(*more: str) -> DataFrame:
        return cells.groupBy(*by, *more).agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in summed])

    means = rolled().select(*by, "n", *[(F.col(c) / F.col("n")).alias(c) for c in ("loss", *CONTROLS)], (F.col("square") / F.col("n")).alias("brier"), (F.col("elo_square") / F.col("n")).alias("elo_brier"), (F.col("broken") == 0).alias("valid"))
    bins = rolled("bin").groupBy(*by).agg((F.sum(F.abs(F.col("q") - F.col("y"))) / F.sum("n")).alias("ece"))
    judged = {"fold": rolled("fold"), "league": rolled("league").filter(F.col("league").isin(*major) & (F.col("n") >= BREAKDOWN_ROWS))}
    worst = [t.groupBy(*by).agg(*[F.max((F.col("loss") - F.col(c)) / F.col("n")).alias(f"worst_{k}_{c}") for c in ("elo", "current")]) for k, t in judged.items()]
    clusters = scored.groupBy(*by, "cluster").agg(F.count(F.lit(1)).alias("k"), *[F.sum(F.col("loss") - F.col(c)).alias(c) for c in ("elo", "current")])
    k, total = F.col("k"), F.sum("k")
    ends = [F.when(F.count(F.lit(1)) > 1, upper_end(F.sum(c), total, F.sum(F.pow(F.col(c), 2)), F.sum(F.col(c) * k), F.sum(F.pow(k, 2)), F.count(F.lit(1)))).alias(f"upper_{c}") for c in ("elo", "current")]
    spread = clusters.groupBy(*by).agg(F.count(F.lit(1)).alias("series"), *ends)
    out = means
    for part in (bins, *worst, spread):
        out = out.join(part, by, "left")
    return out


def upper_end(total: Column, n: Column, squares: Column, products: Column, sizes: Column, clusters: Column) -> Column:
    """Mean difference plus 1.96 of its standard errors, from sums over clusters of differences and sizes."""
    mean = total / n
    spread = squares - 2 * mean * products + mean * mean * sizes
    return mean + 1.96 * F.sqrt(F.greatest(spread * F.try_divide(clusters, clusters - 1), F.lit(0.0))) / n


def segments_side_by_side(summary: DataFrame, segments: Sequence[str]) -> DataFrame:
    """One row per candidate; a segment's values stand under its name, as in test_loss."""
    values = [c for c in summary.columns if c not in ("name", "segment")]
    return summary.groupBy("name").agg(*[F.max(F.when(F.col("segment") == s, F.col(c))).alias(f"{s}_{c}") for s in segments for c in values])
