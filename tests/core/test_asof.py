from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from priorline.contest import team_facts
from priorline.operators.asof import as_of, with_prior
from priorline.operators.replay import EloSettings, Ratings, replay
from priorline.queries.pit import recent_form

START = datetime(2024, 1, 1, 12)
SCHEMA = "match_id long, ts timestamp_ntz, blue int, red int, league string, tier string, blue_win int, series_id long"


def contests(flip: int | None = None) -> list[tuple]:
    rng, rows = random.Random(7), []
    for i in range(120):
        blue, red = rng.sample(range(8), 2)
        win = rng.randint(0, 1)
        rows.append((i, START + timedelta(days=3 * (i // 4)), blue, red, "ab"[i % 2], "1", 1 - win if i == flip else win, i // 3))
    return rows


def features(spark, rows):
    facts = team_facts(spark.createDataFrame(rows, SCHEMA))
    counted = with_prior(facts, ["team"], {"wins": "win", "games": "1"}, maxima={"seen": F.col("ts")})
    got = counted.join(recent_form(facts, ["team"], 8), ["team", "ts"])
    return {(r.match_id, r.side): (r.wins, r.games, r.seen, r.form_wins, r.form_games) for r in got.collect()}


def test_prior_against_a_plain_replay(spark):
    rows, state, want = contests(), {}, {}
    times = sorted({r[1] for r in rows})
    for ts in times:
        group = [r for r in rows if r[1] == ts]
        for r in group:
            for side, team in ((0, r[2]), (1, r[3])):
                past = state.get(team, [])
                want[r[0], side] = (sum(w for w, _ in past), len(past), past[-1][1] if past else None, sum(w for w, _ in past[-8:]), len(past[-8:]))
        for r in group:
            state.setdefault(r[2], []).append((r[6], ts))
            state.setdefault(r[3], []).append((1 - r[6], ts))
    assert features(spark, rows) == want


@pytest.mark.parametrize("flip", [40, 41])
def test_an_outcome_changes_strictly_later_rows_only(spark, flip):
    rows, before, after = contests(), features(spark, contests()), features(spark, contests(flip))
    time = {r[0]: r[1] for r in rows}
    changed = {k for k in before if before[k] != after[k]}
    assert changed and all(time[m] > time[flip] for m, _ in changed)


def test_probes_need_no_facts(spark):
    facts = spark.createDataFrame([("a", START, 1), ("a", START + timedelta(days=1), 0)], "k string, ts timestamp_ntz, win int")
    probes = spark.createDataFrame([("a", START + timedelta(days=5)), ("b", START), ("a", START), (None, START)], "k string, ts timestamp_ntz")
    got = as_of(probes, facts, ["k"], {"wins": F.coalesce("win", F.lit(0)), "games": F.col("win").isNotNull().cast("long")}).collect()
    assert {(r.k, r.ts): (r.wins, r.games) for r in got} == {("a", START + timedelta(days=5)): (1, 2), ("b", START): (0, 0), ("a", START): (0, 0), (None, START): (0, 0)}


def with_rosters(spark, rows):
    named = spark.createDataFrame(rows, SCHEMA)
    squad = [F.array(*[F.concat(F.col(t).cast("string"), F.lit(f"-{k}")) for k in range(5)]).alias(f"{s}_players") for s, t in (("blue", "blue"), ("red", "red"))]
    day = (F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000.0).alias("day")
    region = [F.concat(F.lit("R"), F.col(s) % 2).alias(f"{s}_region") for s in ("blue", "red")]
    return named.select("match_id", "ts", day, "blue", "red", "blue_win", *squad, *region, F.lit(True).alias("eligible"))


def test_replay_sees_no_simultaneous_outcome_and_ignores_order(spark):
    base = {r.match_id: r for r in replay(with_rosters(spark, contests())).collect()}
    shuffled = {r.match_id: r for r in replay(with_rosters(spark, list(reversed(contests())))).collect()}
    assert base == shuffled
    flipped = {r.match_id: r for r in replay(with_rosters(spark, contests(40))).collect()}
    time = {r[0]: r[1] for r in contests()}
    assert {m for m in base if base[m] != flipped[m]} and all(time[m] > time[40] for m in base if base[m] != flipped[m])
    assert base[0].blue_elo == 1500 and base[0].elo_probability == 0.5


def test_a_team_twice_in_one_time_gets_both_changes_from_one_base():
    class Row:
        def __init__(self, **k):
            self.__dict__.update(k)

    state = Ratings(EloSettings())
    rows = [Row(match_id=i, day=0.0, blue=1, red=2 + i, blue_win=1, blue_players=[], red_players=[], blue_region=None, red_region=None, eligible=False) for i in range(2)]
    state.learn(rows)
    assert state.teams == {1: 1524.0, 2: 1488.0, 3: 1488.0}


def test_the_fold_by_columns_agrees_with_the_plain_replay(spark):
    rows = with_rosters(spark, contests()).withColumns({
        "blue_players": F.when(F.col("match_id") % 5 > 0, F.slice("blue_players", 1, (F.col("match_id") % 5).cast("int"))), "red_region": F.when(F.col("match_id") % 7 > 0, F.col("red_region")),
        "eligible": F.when(F.col("match_id") % 11 > 0, F.col("match_id") % 3 > 0),
    }).withColumn("blue_players", F.coalesce("blue_players", F.array().cast("array<string>")))
    got = {r.match_id: r.asDict() for r in replay(rows, {"a": EloSettings(), "b": EloSettings(team_k=8.0)}).filter("setting = 'b'").collect()}
    state, by_time = Ratings(EloSettings(team_k=8.0)), {}
    for r in rows.orderBy("ts", "match_id").collect():
        by_time.setdefault(r.ts, []).append(r)
    for met in by_time.values():
        for r in met:
            for k, v in state.read(r).items():
                assert got[r.match_id][k] == pytest.approx(v, abs=1e-9), k
        state.learn(met)
    assert len(got) == len(contests())


def test_a_time_is_whole_across_batches_and_columns_take_its_rows_together():
    import pyarrow as pa

    from priorline.operators import replay as R

    n = 60_000
    rows = pa.record_batch({"ts": [i // 20_000 for i in range(n)], "match_id": list(range(n))})
    met = list(R.times((rows.slice(i, 7000) for i in range(0, n, 7000)), ["ts"]))
    assert [len(x) for x in met] == [20_000] * 3 and pa.concat_batches(met).equals(rows)
