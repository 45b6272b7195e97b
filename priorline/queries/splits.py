"""Chronological splits of the contests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priorline.contest import MATCHES_SQL, matches
from priorline.operators import splits as S
from priorline.registry import query

_K = f"{MATCHES_SQL}, t AS (SELECT match_id, ts, dense_rank() OVER (ORDER BY ts) - 1 AS k FROM m), z AS (SELECT count(DISTINCT ts) AS n FROM m)"


@query(f"""WITH {_K}, c AS (SELECT *, CAST(floor(n * 0.6) AS BIGINT) AS a, CAST(floor(n * 0.2) AS BIGINT) AS b FROM t, z)
SELECT match_id, CASE WHEN k < a - greatest(1, ceil(a * 0.2)) THEN 'train' WHEN k < a THEN 'calibration' WHEN k < a + b THEN 'validation' ELSE 'test' END AS split FROM c""")
def split_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.by_fraction(matches(spark, sf_dir), 0.6, 0.2, 0.2).select("match_id", "split")


@query(f"WITH {MATCHES_SQL} SELECT match_id, CASE WHEN ts < TIMESTAMP '1996-01-01' THEN 'train' WHEN ts < TIMESTAMP '1997-01-01' THEN 'validation' ELSE 'test' END AS split FROM m")
def split_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.by_boundary(matches(spark, sf_dir), "1996-01-01", "1997-01-01").select("match_id", "split")


_ROLL = "CAST(greatest(2, floor(n * 0.1)) AS BIGINT)"


@query(f"""WITH {_K}, c AS (SELECT *, {_ROLL} AS v, n - {_ROLL} - 3 * {_ROLL} AS f0 FROM t, z), f AS (SELECT *, unnest([0, 1, 2]) AS fold FROM c)
SELECT match_id, fold, CASE WHEN k < f0 + fold * v THEN 'train' WHEN k < f0 + fold * v + v THEN 'validation' ELSE 'test' END AS split FROM f WHERE k < f0 + fold * v + 2 * v""")
def split_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.rolling(matches(spark, sf_dir), 0.1, 0.1, 3).select("match_id", "fold", "split")


@query(f"""WITH {_K}, o AS (SELECT *, {_ROLL} AS v, n - 3 * {_ROLL} AS f0, unnest([0, 1]) AS outer_fold FROM t, z),
h AS (SELECT *, f0 + outer_fold * v + v AS hist FROM o), i AS (SELECT *, CAST(greatest(2, floor(hist * 0.1)) AS BIGINT) AS w FROM h),
j AS (SELECT *, unnest([0, 1]) AS inner_fold FROM i)
SELECT match_id, outer_fold, inner_fold, CASE WHEN k < hist - 3 * w + inner_fold * w THEN 'train' WHEN k < hist - 2 * w + inner_fold * w THEN 'validation' ELSE 'test' END AS split FROM j WHERE k < hist - w + inner_fold * w
UNION ALL SELECT match_id, outer_fold, -1 AS inner_fold, 'score' AS split FROM h WHERE k >= hist AND k < hist + v""")
def split_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.nested(matches(spark, sf_dir), 0.1, 0.1, 2, 2).select("match_id", "outer_fold", "inner_fold", "split")


@query(f"WITH {_K} SELECT match_id, CASE WHEN k < n - greatest(2, ceil(n * 0.15)) THEN 'fit' ELSE 'calibration' END AS part FROM t, z")
def split_trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.trailing(matches(spark, sf_dir), 0.15).select("match_id", "part")


@query(f"WITH {MATCHES_SQL} SELECT match_id, round(pow(0.5, (epoch_us(max(ts) OVER ()) - epoch_us(ts)) / 86400000000.0 / 365.0), 9) AS weight FROM m")
def recency_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.recency_weights(matches(spark, sf_dir), 365.0).select("match_id", F.round("weight", 9).alias("weight"))
