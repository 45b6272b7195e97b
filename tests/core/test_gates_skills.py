from __future__ import annotations

import math
import random

import pytest

from priorline.operators import latent, policy
from priorline.queries import frame

SCHEMA = "name string, segment string, fold int, league string, cluster long, y int, p double, p_base double, p_elo double, p_roster double, p_current double"


def loss(y: int, p: float) -> float:
    q = min(max(p, 1e-6), 1 - 1e-6)
    return -math.log(q if y else 1 - q)


def candidate_rows() -> list[tuple]:
    rng = random.Random(3)
    rows = [(n, s, i % 3, "abc"[i % 2 if i % 40 else 2], i // 4, rng.randint(0, 1), rng.random(), 0.5, rng.random(), 0.4, rng.random()) for n in "xy" for s in ("val", "test") for i in range(400)]
    return [*rows, ("lone", "val", 0, "a", 1, 1, 1.5, 0.5, 0.5, 0.5, 0.5)]


def test_candidates_are_summed_up_as_a_plain_pass_would(spark):
    rows = candidate_rows()
    got = {(r["name"], r.segment): r for r in policy.candidate_summary(spark.createDataFrame(rows, SCHEMA), ("a", "c")).collect()}
    assert set(got) == {("x", "val"), ("x", "test"), ("y", "val"), ("y", "test"), ("lone", "val")}
    for key, r in got.items():
        own = [x for x in rows if x[:2] == key]
        gap = [(x, loss(x[5], x[6]) - loss(x[5], x[8])) for x in own]
        assert r.n == len(own) and r.series == len({x[4] for x in own})
        assert r.loss == pytest.approx(sum(loss(x[5], x[6]) for x in own) / len(own))

        def worst(part, column, least=0):
            groups = {}
            for x, g in part:
                groups.setdefault(x[column], []).append(g)
            return max((sum(v) / len(v) for v in groups.values() if len(v) >= least), default=None)

        assert r.worst_fold_elo == pytest.approx(worst(gap, 2))
        leagues = worst([g for g in gap if g[0][3] in "ac"], 3, policy.BREAKDOWN_ROWS)
        assert r.worst_league_elo == (leagues if leagues is None else pytest.approx(leagues))
        bins = {}
        for x in own:
            q = min(max(x[6], 1e-6), 1 - 1e-6)
            bins.setdefault(min(int(q * 10), 9), []).append((q, x[5]))
        assert r.ece == pytest.approx(sum(abs(sum(q for q, _ in v) - sum(y for _, y in v)) for v in bins.values()) / len(own))
        clusters = {}
        for x, g in gap:
            clusters.setdefault(x[4], []).append(g)
        if len(clusters) < 2:
            assert r.upper_elo is None and not r.valid
            continue
        mean, k = sum(g for _, g in gap) / len(gap), len(clusters)
        error = math.sqrt(k / (k - 1) * sum((sum(v) - mean * len(v)) ** 2 for v in clusters.values())) / len(gap)
        assert r.upper_elo == pytest.approx(mean + 1.96 * error) and r.valid


def test_a_null_check_fails(spark):
    from pyspark.sql import functions as F

    rows = policy.gated(spark.createDataFrame([("x", None), ("y", -1.0)], "name string, upper double"), [("interval", F.expr("upper < 0"))])
    assert {(r["name"], r.failed, r.eligible) for r in rows.collect()} == {("x", "interval", False), ("y", "", True)}


def test_a_batch_update_is_what_the_fold_learns(spark):
    rng, fold = random.Random(5), latent.Skills()
    contests = [([("team", t, c) for t, c in zip(rng.sample("abcdef", 3), (1.0, -1.0, 0.5))], rng.randint(0, 1)) for _ in range(12)]
    fold.learn(contests, 0.0)
    terms = [(i, kind, key, c, 0.0, 0.64, 0, 0.64, y) for i, (own, y) in enumerate(contests) for kind, key, c in own]
    made = latent.batch_update(spark.createDataFrame(terms, "match_id long, kind string, key string, coef double, mean double, variance double, games int, prior double, label int"))
    for r in made.collect():
        mean, variance, _, games = fold.state[r.kind, r.key]
        assert (r.mean, r.variance, r.games) == (pytest.approx(mean), pytest.approx(variance), games)


def test_a_contest_reads_strengths_by_kind_and_both_sides_spread(spark):
    from datetime import datetime

    side = [("team", "1", 1.0), ("team", "2", -1.0), ("player", "7", 0.12), ("roster", "1\x1f7", 0.35), ("roster", "2", -0.35)]
    rows = [(i, datetime(2024, 1, 1 + i), float(i), 1, 2, [7], [], 1, True, side) for i in range(3)]
    schema = "match_id long, ts timestamp_ntz, day double, blue long, red long, blue_players array<long>, red_players array<long>, blue_win int, eligible boolean, terms array<struct<kind:string,key:string,coef:double>>"
    got = {r.match_id: r for r in latent.replay_skills(spark.createDataFrame(rows, schema)).collect()}
    first, last = got[0], got[2]
    assert first.state_space_blue_win_probability == 0.5 and first.state_space_observed_component_fraction == 0
    assert first.state_space_blue_roster_standard_deviation == pytest.approx(math.sqrt(0.35**2 * 0.25 + 0.12**2 * 0.64))
    assert first.state_space_red_roster_standard_deviation == pytest.approx(0.35 * 0.5)
    kinds = ("team_strength_diff", "player_strength_diff", "roster_strength_diff")
    assert last.state_space_log_odds_mean == pytest.approx(sum(last[f"state_space_{k}"] for k in kinds)) and last.state_space_team_strength_diff > 0
    assert last.state_space_observed_component_fraction == 1


def test_the_frame_has_every_feature_once():
    assert len(frame.ALL) == len(set(frame.ALL)) == 172
    assert (len(frame.HISTORY), len(frame.RATINGS), len(frame.FEATURES)) == (126, 29, 17)
