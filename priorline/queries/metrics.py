"""Metrics over a deterministic score of the contests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priorline.contest import MATCHES_SQL, matches
from priorline.operators import metrics as M
from priorline.registry import query

SCORED_SQL = f"""{MATCHES_SQL}, s AS (SELECT match_id, ts, league, tier, series_id, blue_win AS y, ((match_id * 7919) % 1000) / 1000.0::DOUBLE AS p, ((match_id * 104729) % 1000) / 1000.0::DOUBLE AS p2 FROM m),
q AS (SELECT *, greatest(1e-6, least(1 - 1e-6, p)) AS c, greatest(1e-6, least(1 - 1e-6, p2)) AS c2 FROM s),
x AS (SELECT *, -(y * ln(c) + (1 - y) * ln(1 - c)) AS loss, -(y * ln(c2) + (1 - y) * ln(1 - c2)) AS loss2 FROM q)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matches(spark, sf_dir)
    return m.select("match_id", "ts", "league", "tier", "series_id", F.col("blue_win").alias("y"), ((F.col("match_id") * 7919) % 1000 / 1000.0).alias("p"), ((F.col("match_id") * 104729) % 1000 / 1000.0).alias("p2"))


Y, P = "y", "p"


@query(f"WITH {SCORED_SQL} SELECT round(avg(loss), 9) AS log_loss FROM x")
def metric_log_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).agg(F.round(M.log_loss(F.col(Y), F.col(P)), 9).alias("log_loss"))


@query(f"WITH {SCORED_SQL} SELECT round(avg(pow(p - y, 2)), 9) AS brier FROM x")
def metric_brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).agg(F.round(M.brier(F.col(Y), F.col(P)), 9).alias("brier"))


_BINS = "b AS (SELECT CAST(least(floor(c * 10), 9) AS INTEGER) AS bin, count(*) AS n, avg(c) AS mean_p, avg(y) AS rate FROM x GROUP BY 1)"


@query(f"WITH {SCORED_SQL}, {_BINS} SELECT bin, n, round(mean_p, 9) AS mean_p, round(rate, 9) AS rate FROM b")
def calibration_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.calibration_bins(scored(spark, sf_dir)).select("bin", "n", F.round("mean_p", 9).alias("mean_p"), F.round("rate", 9).alias("rate"))


@query(f"WITH {SCORED_SQL}, {_BINS} SELECT round(sum(n * abs(mean_p - rate)) / sum(n), 9) AS ece FROM b")
def metric_ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.expected_calibration_error(scored(spark, sf_dir)).select(F.round("ece", 9).alias("ece"))


@query(f"""WITH {SCORED_SQL}, r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rk FROM x)
SELECT round((sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 9) AS auc FROM r""")
def metric_roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.roc_auc(scored(spark, sf_dir)).select(F.round("auc", 9).alias("auc"))


@query(f"WITH {SCORED_SQL} SELECT count(*) AS n, round(avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END), 9) AS accuracy, round(avg(y), 9) AS base_rate, round(avg(p), 9) AS mean_p FROM x")
def metric_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.round(M.accuracy(F.col(Y), F.col(P)), 9).alias("accuracy"), F.round(F.avg(Y), 9).alias("base_rate"), F.round(F.avg(P), 9).alias("mean_p"))


_DIMS = {
    "time_period": "strftime(ts, '%Y-%m')", "patch": "strftime(ts, '%Y.%m')", "league": "league", "region": "CASE WHEN league = 'MACHINERY' THEN 'unknown' WHEN match_id % 4 = 0 THEN 'International' ELSE league END",
    "tournament_level": "tier", "official_status": "CASE WHEN tier LIKE '5%' THEN 'unofficial' ELSE 'official' END",
}


@query(f"WITH {SCORED_SQL}, d AS ({' UNION ALL '.join(f'''SELECT '{k}' AS dimension, {v} AS value, * FROM x''' for k, v in _DIMS.items())}) SELECT dimension, value, count(*) AS n, round(avg(loss), 9) AS log_loss, round(avg(pow(p - y, 2)), 9) AS brier, round(avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM d GROUP BY dimension, value")
def metric_breakdowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = F.when(F.col("league") == "MACHINERY", None).when(F.col("match_id") % 4 == 0, "International").otherwise(F.col("league"))
    official = F.when(F.col("tier").startswith("5"), "unofficial").otherwise("official")
    dimensions = {"time_period": F.date_format("ts", "yyyy-MM"), "patch": F.date_format("ts", "yyyy.MM"), "league": F.col("league"), "region": region, "tournament_level": F.col("tier"), "official_status": official}
    rows = M.breakdowns(scored(spark, sf_dir), dimensions)
    return rows.select("dimension", "value", "n", *[F.round(c, 9).alias(c) for c in ("log_loss", "brier", "accuracy")])


@query(f"WITH {SCORED_SQL} SELECT round(avg(loss), 9) AS log_loss, count(*) AS n FROM ({' UNION ALL '.join(f'SELECT * FROM x WHERE match_id % 5 = {k}' for k in range(5))})")
def pooled_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir)
    folds = [s.filter(F.col("match_id") % 5 == k) for k in range(5)]
    return reduce(DataFrame.unionByName, folds).agg(F.round(M.log_loss(F.col(Y), F.col(P)), 9).alias("log_loss"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {SCORED_SQL} SELECT series_id, round(sum(loss), 6) AS loss, count(*) AS n FROM x GROUP BY series_id")
def cluster_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.cluster_losses(scored(spark, sf_dir), "series_id").select("series_id", F.round("loss", 6).alias("loss"), "n")


@query()
def bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.bootstrap_interval(M.cluster_losses(scored(spark, sf_dir), "series_id"))


@query(f"WITH {SCORED_SQL} SELECT series_id, round(sum(loss - loss2), 6) AS loss, count(*) AS n FROM x GROUP BY series_id")
def paired_loss_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    diff = M.row_log_loss(F.col(Y), F.col(P)) - M.row_log_loss(F.col(Y), F.col("p2"))
    return scored(spark, sf_dir).groupBy("series_id").agg(F.round(F.sum(diff), 6).alias("loss"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {SCORED_SQL} SELECT a.match_id, round(a.p - b.p2, 9) AS apart FROM x a JOIN x b ON a.match_id = b.match_id")
def paired_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir)
    return s.select("match_id", "p").join(s.select("match_id", "p2"), "match_id").select("match_id", F.round(F.col("p") - F.col("p2"), 9).alias("apart"))


@query(f"WITH {SCORED_SQL}, a AS (SELECT league, count(*) AS n, avg(loss) AS l, avg(loss2) AS l2 FROM x GROUP BY league) SELECT league, n, round(l - l2, 9) AS change, CASE WHEN l - l2 > 0.01 THEN 1 ELSE 0 END AS regressed FROM a WHERE n >= 10")
def slice_regression_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir)
    sides = [s.groupBy("league").agg(F.count(F.lit(1)).alias(f"n_{c}"), M.log_loss(F.col(Y), F.col(c)).alias(f"l_{c}")) for c in ("p", "p2")]
    change = F.col("l_p") - F.col("l_p2")
    return sides[0].join(sides[1], "league").filter("n_p >= 10").select("league", F.col("n_p").alias("n"), F.round(change, 9).alias("change"), (change > 0.01).cast("int").alias("regressed"))


@query(f"WITH {SCORED_SQL} SELECT match_id, round(greatest(1e-6, least(1 - 1e-6, 0.7 * c + 0.3 * c2)), 9) AS blend FROM x")
def model_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = 0.7 * M.clipped(F.col("p")) + 0.3 * M.clipped(F.col("p2"))
    return scored(spark, sf_dir).select("match_id", F.round(M.clipped(mixed), 9).alias("blend"))


@query(f"WITH {SCORED_SQL} SELECT league, round(avg(y), 9) AS p FROM x GROUP BY league")
def model_base_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).groupBy("league").agg(F.round(F.avg("y"), 9).alias("p"))
