"""Models fitted on early contests and scored on later ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priorline.contest import matches, team_facts
from priorline.models.estimators import Calibrator, Logistic, Trees, mirrored
from priorline.operators import metrics as M
from priorline.operators.asof import smoothed, with_prior
from priorline.operators.replay import replay
from priorline.operators.splits import by_boundary
from priorline.queries.ratings import contests
from priorline.registry import query

COLUMNS = ("rate_diff", "games_diff")


def frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """match_id, y, split and two strictly earlier features."""
    m = matches(spark, sf_dir)
    sides = with_prior(team_facts(m), ["team"], {"wins": "win", "games": "1"})
    sign = F.when(F.col("side") == 0, 1).otherwise(-1)
    diff = sides.groupBy("match_id").agg(F.sum(sign * smoothed(F.col("wins"), F.col("games"), 0.5, 6.0)).alias("rate_diff"), F.sum(sign * F.log1p("games")).alias("games_diff"))
    return by_boundary(m, "1996-01-01", "1997-01-01").join(diff, "match_id").select("match_id", F.col("blue_win").alias("y"), "split", *COLUMNS)


def _report(scored: DataFrame, p: str) -> DataFrame:
    return scored.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.round(M.log_loss(F.col("y"), F.col(p)), 4).alias("log_loss"))


@query()
def model_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame(spark, sf_dir)
    return _report(Logistic(COLUMNS).fit(rows.filter("split = 'train'")).predict(rows), "p")


@query()
def model_platt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calibrated(spark, sf_dir, "platt")


@query()
def model_beta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calibrated(spark, sf_dir, "beta")


@query()
def model_isotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calibrated(spark, sf_dir, "isotonic")


def _calibrated(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    rows = frame(spark, sf_dir)
    scored = Logistic(COLUMNS[:1]).fit(rows.filter("split = 'train'")).predict(rows)
    return _report(Calibrator(kind).fit(scored.filter("split = 'validation'")).apply(scored), "calibrated")


@query()
def model_elo_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A logistic model of the rating difference alone."""
    ratings = replay(contests(spark, sf_dir, with_rosters=False)).select("match_id", (F.col("blue_elo") - F.col("red_elo")).alias("elo_diff"))
    rows = by_boundary(matches(spark, sf_dir), "1996-01-01", "1997-01-01").select("match_id", F.col("blue_win").alias("y"), "split").join(ratings, "match_id")
    # The fit and the report pass over the rows five times; kept, they are folded once.
    rows = rows.select("y", "split", "elo_diff").persist()
    return _report(Logistic(("elo_diff",)).fit(rows.filter("split = 'train'")).predict(rows), "p")


@query()
def model_recency_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The logistic model with weights that halve with each year before the last contest it is fitted on."""
    rows = frame(spark, sf_dir).join(matches(spark, sf_dir).select("match_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at")), "match_id")
    last = rows.filter("split = 'train'").agg(F.max("at")).first()[0]
    weighted = rows.withColumn("weight", F.pow(F.lit(0.5), (F.lit(last) - F.col("at")) / (365 * 86_400)))
    return _report(Logistic(COLUMNS, weight="weight").fit(weighted.filter("split = 'train'")).predict(weighted), "p")


@query()
def model_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees over the same features."""
    rows = frame(spark, sf_dir)
    return _report(Trees(COLUMNS).fit(rows.filter("split = 'train'")).predict(rows), "p")


@query()
def model_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A paired-comparison model: differences and their mirror images, the side as one more difference, no intercept."""
    rows = frame(spark, sf_dir).withColumn("side", F.lit(1.0))
    columns = (*COLUMNS, "side")
    return _report(Logistic(columns, intercept=False).fit(mirrored(rows.filter("split = 'train'"), columns)).predict(rows), "p")
