from __future__ import annotations

import random
from datetime import datetime, timedelta

import duckdb
import pytest

from priorline import contest, session
from priorline.operators import storage
from priorline.operators.replay import replay
from priorline.queries import frame, ratings
from priorline.queries.pit import recent_form


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Contests of 12 days with few teams, brands and players: ties in time, brands that meet themselves, contests without picks."""
    rng, at = random.Random(5), tmp_path_factory.mktemp("frame")
    orders = [(i, rng.randint(1, 9), rng.choice("FOP"), float(i), datetime(1996, 1, 25) + timedelta(days=rng.randrange(12)), rng.choice(["1-URGENT", "5-LOW"])) for i in range(1, 141)]
    lines = [(i, rng.randint(1, 8), rng.randint(1, 6), n, 1.0, 1.0, 0.1, 0.1) for i in range(1, 141) for n in range(1, rng.randint(1, 8))]
    tables = {
        "orders": (orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"),
        "lineitem": (lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double"),
        "customer": ([(i, i % 4, ["A", "B", "MACHINERY"][i % 3]) for i in range(1, 10)], "c_custkey long, c_nationkey int, c_mktsegment string"),
        "part": ([(i, f"Brand#1{1 + i % 3}") for i in range(1, 9)], "p_partkey long, p_brand string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{at}/{name}.parquet")
    return str(at)


def stated(folder: str, sql: str) -> dict:
    with duckdb.connect() as db:
        for name in ("orders", "lineitem", "customer", "part"):
            db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
        found = db.execute(sql)
        names = [c[0] for c in found.description]
        return {r[0]: dict(zip(names, r, strict=True)) for r in found.fetchall()}


@pytest.mark.parametrize("most_sent", [None, 0])
def test_the_history_deals_the_line_items_once_and_agrees_with_its_statement(spark, folder, monkeypatch, most_sent):
    read, table = [], contest.table
    monkeypatch.setattr(contest, "table", lambda spark, sf_dir, name: read.append(name) or table(spark, sf_dir, name))
    if most_sent is not None:
        for module in (session, storage):
            monkeypatch.setattr(module, "MOST_SENT_ROWS", most_sent, raising=False)
    got = {r.match_id: r.asDict() for r in frame.feature_frame_history(spark, folder).collect()}
    assert got == stated(folder, frame.ORACLES["feature_frame_history"])
    assert read.count("lineitem") == 1


def test_a_times_form_is_made_of_the_last_results_before_it(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(3), datetime(1995, 1, 1) + timedelta(days=rng.choice([0, 1, 2, 3, 5, 8])), i, i % 2, rng.randint(0, 1)) for i in range(90)]
    got = {(r.team, r.ts): (r.form_wins, r.form_games) for r in recent_form(spark.createDataFrame(rows, "team int, ts timestamp_ntz, match_id long, side int, win int"), ["team"], 8).collect()}
    for team, ts in {r[:2] for r in rows}:
        past = [r[4] for r in sorted(rows, key=lambda r: r[1:4]) if r[0] == team and r[1] < ts][-8:]
        assert got.pop((team, ts)) == (sum(past), len(past))
    assert not got


def test_the_frame_deals_the_line_items_once_and_agrees_with_the_folds(spark, folder, monkeypatch):
    elo = {r.match_id: r.asDict() for r in replay(ratings.contests(spark, folder)).collect()}
    skills = {r.match_id: r.asDict() for r in ratings.latent_features(spark, folder).collect()}
    history = {r.match_id: r.asDict() for r in frame.feature_frame_history(spark, folder).collect()}
    read, table = [], contest.table
    monkeypatch.setattr(contest, "table", lambda spark, sf_dir, name: read.append(name) or table(spark, sf_dir, name))
    got = {r.match_id: r.asDict() for r in frame.feature_frame(spark, folder).collect()}
    assert read.count("lineitem") == 1
    assert got.keys() == elo.keys() == history.keys() and len(skills) < len(got)
    same = {"pooled_elo_diff": "pooled_diff", "pooled_elo_blue_win_probability": "pooled_probability", "elo_blue_win_probability": "elo_probability"}
    same |= {f"{s}_{k}": f"{s}_{k}" for s in frame.SIDES for k in ("elo", "player_elo", "adjusted_elo", "region_elo")}
    for i, row in got.items():
        assert {c: row[c] for c in frame.HISTORY} == pytest.approx({c: history[i][c] for c in frame.HISTORY}, abs=1e-9)
        assert {c: row[c] for c in same} == pytest.approx({c: elo[i][k] for c, k in same.items()}, abs=2e-9)
        neutral = {c: 0.5 if c.endswith("probability") else 0.0 for c in frame.FEATURES}
        assert {c: row[c] for c in frame.FEATURES} == pytest.approx({c: skills.get(i, neutral)[c] for c in frame.FEATURES}, abs=2e-9)
        for kind, name in (("own", ""), ("faded", "adjusted_")):  # the first role's player is the first of a side
            first = [(elo[i][f"{s}_{kind}"] or [1500.0])[0] for s in frame.SIDES]
            assert row[f"top_{name}player_elo_diff"] == pytest.approx(first[0] - first[1], abs=2e-9)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("dealt_")]
