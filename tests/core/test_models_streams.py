from __future__ import annotations

import json
import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from priorline.models.estimators import Calibrator, Logistic, blend
from priorline.operators.asof import with_prior
from priorline.operators.latent import Skills
from priorline.sources import snapshot
from priorline.streaming.prior import prior_counts


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    made = []
    for i in range(400):
        x, z = rng.gauss(0, 1), rng.gauss(2, 3)
        made.append((i, float(x), float(z) if i % 9 else None, int(rng.random() < 1 / (1 + math.exp(-x)))))
    return spark.createDataFrame(made, "i int, x double, z double, y int")


def test_logistic_solves_its_objective(rows):
    model = Logistic(["x", "z"], c=0.5).fit(rows)
    data = rows.toPandas()
    z = data.z.fillna(data.z.median())
    x = np.stack([(v - v.mean()) / v.std(ddof=0) for v in (data.x, z)], axis=1)
    w = np.zeros(3)
    design = np.column_stack([x, np.ones(len(x))])
    penalty = np.diag([1 / 0.5, 1 / 0.5, 0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ w))
        w -= np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + penalty, design.T @ (p - data.y) + penalty @ w)
    got = np.array([r.p for r in model.predict(rows).orderBy("i").collect()])
    assert np.abs(got - 1 / (1 + np.exp(-design @ w))).max() < 1e-4
    assert Logistic(["x"]).fit(rows.filter("y = 1")).predict(rows).agg(F.min("p")).first()[0] == 1 - 1e-6


@pytest.mark.parametrize("kind", ["platt", "beta", "isotonic"])
def test_calibrators_are_monotone_and_abstain(rows, kind):
    scored = Logistic(["x"]).fit(rows).predict(rows)
    out = [(r.p, r.calibrated) for r in Calibrator(kind).fit(scored).apply(scored).orderBy("p").collect()]
    assert all(a[1] <= b[1] + 1e-9 for a, b in zip(out, out[1:], strict=False))
    flat = scored.withColumn("p", F.lit(0.4))
    assert {r.calibrated for r in Calibrator(kind).fit(flat).apply(flat).collect()} == {0.4}
    assert abs(blend(scored.withColumn("q", F.lit(0.5)), {"p": 1, "q": 1}, "b").select(F.max(F.abs(F.col("b") - (F.col("p") + 0.5) / 2))).first()[0]) < 1e-9


def test_skills_do_not_depend_on_order():
    batch = [([("team", "a", 1.0), ("team", "b", -1.0)], 1), ([("team", "c", 1.0), ("team", "a", -1.0)], 0)]
    one, two = Skills(), Skills()
    one.learn(batch, 0.0)
    two.learn(batch[::-1], 0.0)
    assert one.state == two.state and one.state["team", "a"][3] == 2
    assert one.read(batch[0][0], 0.0)[2] > 0.5
    mean, variance, _ = one.at("team", "a", 540.0)
    assert mean == pytest.approx(one.state["team", "a"][0] / 2) and one.state["team", "a"][1] < variance < 0.64


def test_a_stream_reads_what_a_batch_reads(spark, tmp_path):
    start, rng = datetime(2024, 1, 1), random.Random(1)
    facts = [(i, i % 2, start + timedelta(days=i // 6), rng.randint(0, 4), rng.randint(0, 1)) for i in range(60)]
    schema = "match_id long, side int, ts timestamp_ntz, team int, win int"
    whole = spark.createDataFrame(facts, schema)
    for k in range(5):
        spark.createDataFrame(facts[12 * k : 12 * k + 12], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    step = prior_counts(str(tmp_path))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    run = stream.writeStream.foreachBatch(step).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = {(r.match_id, r.side): (r.wins, r.games) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.match_id, r.side): (r.wins, r.games) for r in with_prior(whole, ["team"], {"wins": "win", "games": "1"}).collect()}
    assert got == want
    with pytest.raises(ValueError):
        step(whole, 5)


def test_snapshot(spark, tmp_path):
    def row(k: int, **change) -> dict:
        base = {
            "game_id": f"g{k}", "match_id": "m", "league": "L", "tournament": "T", "timestamp": f"2024-05-0{k} 10:00:00", "patch": "14.1", "team1": "x", "team2": "y", "blue": "x", "red": "y", "winner": "1", "game_number": "1", "first_pick": "y",
            "team1_picks": list("ABCDE"), "team2_picks": list("FGHIJ"), "team1_players": list("abcde"), "team2_players": list("fghij"), "team1_bans": ["K", "None"], "team2_bans": [],
        }
        return base | change

    rows = [row(1), row(2, blue="y", red="x"), row(3, winner="3"), row(1), row(4, timestamp="2025-01-01 00:00:00"), row(5, team1_picks=["A"]), row(6, red="z"), row(7, is_official="maybe")]
    head = {"snapshot_schema_version": "2", "source_name": "s", "source_endpoint": "e", "retrieved_at": "now", "interval": {"start_inclusive": "2024-01-01T00:00:00Z", "end_exclusive": "2024-12-31T00:00:00Z"}, "query_fields": {}, "row_count": len(rows), "rows": rows}
    path = tmp_path / "s.json"
    path.write_text(json.dumps(head, indent=1))
    accepted, rejected = snapshot.games(snapshot.read_snapshot(spark, str(path)))
    got = {r.game_id: (r.blue_team, r.blue_win, r.first_pick_side, r.blue_picks[0], r.blue_bans) for r in accepted.collect()}
    assert got == {"g1": ("x", True, "red", "A", ["K"]), "g2": ("y", False, "blue", "F", [])}
    assert {(r.game_id, r.reason) for r in rejected.collect()} == {("g3", "invalid_winner"), ("g1", "duplicate_source_game"), ("g4", "timestamp_outside_snapshot_interval"), ("g5", "invalid_source_list"), ("g6", "inconsistent_side_assignment"), ("g7", "invalid_boolean_value")}
    path.write_text(json.dumps(head | {"row_count": 1}))
    with pytest.raises(ValueError):
        snapshot.read_snapshot(spark, str(path))
