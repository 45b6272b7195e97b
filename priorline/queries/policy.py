"""Release and selection gates over deterministic scores of the contests.

Seven candidates are judged by three segments: a fifth of all contests validates, a fifth is held out, three fifths are rolling folds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priorline.operators.policy import BREAKDOWN_ROWS, CONTROLS, candidate_summary, gated, segments_side_by_side
from priorline.queries.metrics import SCORED_SQL, scored
from priorline.registry import query

#: Candidate -> how much it knows of the label, how much noise it adds, and the league it errs in.
CANDIDATES = {
    "base": (0.0, 0.0, "-"), "elo": (0.2, 0.2, "-"), "roster": (0.25, 0.2, "-"), "current": (0.3, 0.2, "-"), "sharp": (0.97, 0.01, "-"), "noisy": (0.3, 0.6, "-"), "uneven": (0.96, 0.01, "BUILDING"),
}
MAJOR = ("AUTOMOBILE", "BUILDING", "FURNITURE")
SEARCHED = ("sharp", "noisy", "uneven")


def _score(known: str, noise: str, apart: str) -> str:
    """A probability as SQL text for both engines; in the league it errs in, a candidate knows the contrary."""
    return f"0.5e0 + (y - 0.5e0) * {known} * (CASE WHEN league = {apart} THEN -0.5e0 ELSE 1e0 END) + (match_id * 7919 % 1000 / 1000e0 - 0.5e0) * {noise}"


_CONTROL_SCORES = {c: _score(f"{CANDIDATES[c][0]}e0", f"{CANDIDATES[c][1]}e0", "'-'") for c in CONTROLS}
_THREE = "CASE WHEN match_id % 5 = 0 THEN 'val' WHEN match_id % 5 = 1 THEN 'test' ELSE 'roll' END"
_OUTER = "concat('outer', CAST(1 + match_id % 2 AS INT))"


def _rows(spark: SparkSession, sf_dir: str, segment: str) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(a).alias("known"), F.lit(b).alias("noise"), F.lit(x).alias("apart")) for n, (a, b, x) in CANDIDATES.items()]))
    s = scored(spark, sf_dir).select("match_id", "league", "series_id", "y", each.alias("c")).select("*", "c.*")
    return s.select("name", F.expr(segment).alias("segment"), F.expr("match_id % 5").alias("fold"), "league", F.col("series_id").alias("cluster"), "y", F.expr(_score("known", "noise", "apart")).alias("p"), *[F.expr(v).alias(f"p_{c}") for c, v in _CONTROL_SCORES.items()])


def _ln(p: str) -> str:
    q = f"greatest(1e-6, least(1 - 1e-6, {p}))"
    return f"-(y * ln({q}) + (1 - y) * ln(1 - {q}))"


def _summary_sql(segment: str) -> str:
    listed = ", ".join(f"('{n}', {a}::DOUBLE, {b}::DOUBLE, '{x}')" for n, (a, b, x) in CANDIDATES.items())
    major = ", ".join(f"'{x}'" for x in MAJOR)

    def upper(c: str) -> str:
        return f"CASE WHEN count(*) > 1 THEN sum({c}) / sum(k) + 1.96 * sqrt(greatest(0, (sum({c} * {c}) - 2 * sum({c}) / sum(k) * sum({c} * k) + pow(sum({c}) / sum(k), 2) * sum(k * k)) * count(*) / (count(*) - 1))) / sum(k) END AS upper_{c}"

    def worst(kind: str, having: str = "") -> str:
        return f"SELECT name, segment, max(elo) AS worst_{kind}_elo, max(current) AS worst_{kind}_current FROM (SELECT name, segment, avg(loss - elo) AS elo, avg(loss - current) AS current FROM z GROUP BY name, segment, {kind} {having}) GROUP BY name, segment"

    return f"""{SCORED_SQL}, cand(name, known, noise, apart) AS (VALUES {listed}), y0 AS (SELECT name, {segment} AS segment, match_id % 5 AS fold, league, series_id AS cluster, y, {_score('known', 'noise', 'apart')} AS p, {', '.join(f'{v} AS p_{c}' for c, v in _CONTROL_SCORES.items())} FROM s, cand),
z AS (SELECT *, {_ln('p')} AS loss, {', '.join(f"{_ln(f'p_{c}')} AS {c}" for c in CONTROLS)}, least(floor(greatest(1e-6, least(1 - 1e-6, p)) * 10), 9) AS bin FROM y0),
g AS (SELECT * FROM (SELECT name, segment, count(*) AS n, count(DISTINCT cluster) AS series, avg(loss) AS loss, {', '.join(f'avg({c}) AS {c}' for c in CONTROLS)}, avg(pow(p - y, 2)) AS brier, avg(pow(p_elo - y, 2)) AS elo_brier, bool_and(p BETWEEN 0 AND 1) AS valid FROM z GROUP BY name, segment)
  LEFT JOIN (SELECT name, segment, sum(k * abs(mp - my)) / sum(k) AS ece FROM (SELECT name, segment, count(*) AS k, avg(greatest(1e-6, least(1 - 1e-6, p))) AS mp, avg(y) AS my FROM z GROUP BY name, segment, bin) GROUP BY name, segment) USING (name, segment)
  LEFT JOIN ({worst('fold')}) USING (name, segment) LEFT JOIN ({worst('league', f'HAVING count(*) >= {BREAKDOWN_ROWS} AND league IN ({major})')}) USING (name, segment)
  LEFT JOIN (SELECT name, segment, {upper('elo')}, {upper('current')} FROM (SELECT name, segment, cluster, count(*) AS k, sum(loss - elo) AS elo, sum(loss - current) AS current FROM z GROUP BY ALL) GROUP BY name, segment) USING (name, segment))"""


_WIDE = ("loss", "base", "elo", "brier", "elo_brier", "valid", "ece", "n", "series", "upper_elo", "worst_league_elo")
_SIDE_BY_SIDE = f"w AS (SELECT name, {', '.join(f'''max(CASE WHEN segment = '{s}' THEN {c} END) AS {s}_{c}''' for s in ('val', 'test', 'roll') for c in _WIDE)} FROM g GROUP BY name)"


def _case(checks: dict[str, str]) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN NOT coalesce({sql}, false) THEN '{name}' END" for name, sql in checks.items()) + ")"


#: The gates with their fixed limits, as SQL text for both engines.
RELEASE = {
    "holdout_sample_sufficiency": "test_n >= 750 AND test_series >= 300",
    "validation_beats_base_rate": "val_loss < val_base",
    "validation_beats_elo": "val_loss < val_elo",
    "rolling_log_loss_improvement": "roll_elo - roll_loss >= 0.003",
    "holdout_log_loss_improvement": "test_elo - test_loss >= 0.003",
    "paired_series_interval": "test_upper_elo < 0",
    "holdout_brier": "test_brier <= test_elo_brier",
    "holdout_calibration": "test_ece <= 0.04",
    "major_league_regression": "coalesce(test_worst_league_elo, 0) <= 0.01",
    "probability_contract": "test_valid",
}
_SIMPLE = "least(elo, roster)"
DEVELOPMENT = {
    "beats_elo": "loss < elo",
    "beats_best_simple_control": f"loss < {_SIMPLE}",
    "series_clustered_interval_beats_elo": "upper_elo < 0",
    "improves_or_matches_elo_in_every_fold": "worst_fold_elo <= 0",
    "calibration_within_limit": "ece <= 0.04",
    "major_league_regressions_within_limit": "coalesce(worst_league_elo, 0) <= 0.01",
}
TRIAL = {
    "beats_elo": "loss < elo",
    "beats_best_simple_control": f"loss < {_SIMPLE}",
    "beats_current_v4_control": "loss < current",
    "calibration_within_limit": "ece <= 0.04",
    "no_inner_fold_regression_vs_elo": "worst_fold_elo <= 0",
    "major_league_regressions_within_limit": "coalesce(worst_league_elo, 0) <= 0.01",
}
ELIGIBILITY = {
    "beats_v4": "loss < current",
    "beats_elo": "loss < elo",
    "calibration_within_limit": "ece <= 0.04",
    "inner_fold_regressions_within_limit": "worst_fold_current <= 0.005",
    "major_league_regressions_within_limit": "coalesce(worst_league_current, 0) <= 0.01",
}
DECISION = {
    "minimum_games": "n >= 750",
    "minimum_series": "series >= 300",
    "minimum_log_loss_improvement_vs_v4": "current - loss >= 0.003",
    "paired_interval_upper_below_zero": "upper_current < 0",
    "calibration_within_limit": "ece <= 0.04",
    "outer_fold_regressions_within_limit": "worst_fold_current <= 0.01",
    "major_league_regressions_within_limit": "coalesce(worst_league_current, 0) <= 0.01",
}


def _columns(checks: dict[str, str]) -> list:
    return [(name, F.expr(sql)) for name, sql in checks.items()]


def _summary(spark: SparkSession, sf_dir: str, segment: str = _THREE) -> DataFrame:
    return candidate_summary(_rows(spark, sf_dir, segment), MAJOR)


def _rolling(spark: SparkSession, sf_dir: str, checks: dict[str, str]) -> DataFrame:
    return gated(_summary(spark, sf_dir).filter("segment = 'roll'"), _columns(checks))


@query(f"WITH {_summary_sql(_THREE)}, {_SIDE_BY_SIDE} SELECT name, {_case(RELEASE)} AS failed, CASE WHEN {_case(RELEASE)} = '' THEN name ELSE 'elo' END AS recommended, NOT coalesce({RELEASE['holdout_sample_sufficiency']}, false) AS provisional FROM w")
def release_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ten gates must hold, or the fallback is recommended."""
    rows = gated(segments_side_by_side(_summary(spark, sf_dir), ("val", "test", "roll")), _columns(RELEASE))
    enough = F.coalesce(F.expr(RELEASE["holdout_sample_sufficiency"]), F.lit(False))
    return rows.select("name", "failed", F.when(F.col("eligible"), F.col("name")).otherwise("elo").alias("recommended"), (~enough).alias("provisional"))


@query(f"WITH {_summary_sql(_THREE)} SELECT name, {_case(DEVELOPMENT)} AS failed, {_case(DEVELOPMENT)} = '' AS eligible FROM g WHERE segment = 'roll'")
def dev_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rolling(spark, sf_dir, DEVELOPMENT).select("name", "failed", "eligible")


_TRIED = ", ".join(f"'{x}'" for x in SEARCHED)


@query(f"""WITH {_summary_sql(_OUTER)}, t AS (SELECT *, {_case(TRIAL)} = '' AS ok FROM g WHERE name IN ({_TRIED}))
SELECT segment, coalesce(arg_min(name, (loss, name)) FILTER (ok), 'elo') AS selected, CASE WHEN bool_or(ok) THEN 'searched_trial' ELSE 'fallback_control' END AS selection_kind,
  count(*) AS n_completed, count(*) FILTER (ok) AS n_eligible FROM t GROUP BY segment""")
def trial_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best eligible trial of each outer fold, by its own inner folds only; the fallback where none is eligible."""
    tried = gated(_summary(spark, sf_dir, _OUTER).filter(F.col("name").isin(*SEARCHED)), _columns(TRIAL))
    best = F.min_by("name", F.when(F.col("eligible"), F.struct("loss", "name")))
    rows = tried.groupBy("segment").agg(best.alias("best"), F.count(F.lit(1)).alias("n_completed"), F.count_if("eligible").alias("n_eligible"))
    kind = F.when(F.col("n_eligible") > 0, "searched_trial").otherwise("fallback_control")
    return rows.select("segment", F.coalesce("best", F.lit("elo")).alias("selected"), kind.alias("selection_kind"), "n_completed", "n_eligible")


@query(f"WITH {_summary_sql(_THREE)} SELECT name, {_case(ELIGIBILITY)} AS failed, {_case(ELIGIBILITY)} = '' AS eligible FROM g WHERE segment = 'roll'")
def candidate_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rolling(spark, sf_dir, ELIGIBILITY).select("name", "failed", "eligible")


@query(f"WITH {_summary_sql(_THREE)} SELECT name, {_case(DECISION)} AS failed, CASE WHEN {_case(DECISION)} = '' THEN 'replace_v4_shadow' ELSE 'retain_v4_shadow' END AS recommendation FROM g WHERE segment = 'roll'")
def decision_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rolling(spark, sf_dir, DECISION).select("name", "failed", F.when(F.col("eligible"), "replace_v4_shadow").otherwise("retain_v4_shadow").alias("recommendation"))
