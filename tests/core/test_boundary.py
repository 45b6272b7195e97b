from __future__ import annotations

import json

import pytest

from priorline.functions.text import folded_text
from priorline.operators import metrics as M
from priorline.operators import splits as S
from priorline.sources import canonical, tabular

ROLES = ("top", "jng", "mid", "bot", "sup")


def record(**change) -> dict:
    base = {
        "match_id": "m1", "request_schema_version": "2", "match_timestamp": "2024-03-01T12:00:00Z", "league": "A", "tournament": "T", "patch": "14.05", "game_number": 1,
        "blue_series_wins_before": 0, "red_series_wins_before": 0, "blue_team": "x", "red_team": "y", "blue_players": list("abcde"), "red_players": list("fghij"),
        "blue_picks": list("ABCDE"), "red_picks": list("FGHIJ"), "blue_bans": ["K"], "red_bans": [], "fearless_bans": [], "blue_win": True,
    }
    return base | change


def test_canonical_records(spark, tmp_path):
    rows = [record(), record(match_id="m2", match_timestamp="2024-03-01 12:00:00"), record(match_id="m3", red_picks=list("AGHIJ")), record(match_id="m4", blue_bans=["A"])]
    rows += [record(match_id="m5", red_team="x"), record(match_id="m6", game_number=3), record(match_id="m7", patch="v14"), record(match_id="m8", blue_players=list("abcd")), record(match_id="m9", patch="025.S1.02")]
    rows += [record(match_id="n1", request_schema_version="9"), record(match_id="n2", blue_win=None), record(match_id="n3", kills=12), {k: v for k, v in record(match_id="n4").items() if k != "blue_win"}]
    path = tmp_path / "in.jsonl"
    path.write_text("\n".join(map(json.dumps, rows)) + "\n\n{broken\n")
    accepted, rejected = canonical.read_jsonl(spark, str(path))
    assert {r.match_id: r.patch for r in accepted.collect()} == {"m1": "14.5", "m9": "25.S1.2"}
    want = {"m2": "invalid_timestamp", "m3": "repeated_pick", "m4": "overlapping_draft", "m5": "same_team", "m6": "invalid_game_number", "m7": "invalid_patch", "m8": "invalid_list", None: "invalid_json"}
    want |= {"n1": "invalid_schema_version", "n2": "missing_label", "n3": "extra_field", "n4": "missing_label"}
    assert {r.match_id: r.reason for r in rejected.collect()} == want
    table = str(tmp_path / "table")
    assert canonical.append_matches(accepted, table) == 2
    with pytest.raises(ValueError):
        canonical.append_matches(accepted, table)
    assert canonical.load_matches(spark, table, "2024-03-01T12:00:00Z").count() == 0


def game_rows(game: str, number: int, date: str, winner: str = "Blue", **change) -> list[dict]:
    rows = []
    for side, team in (("Blue", "x"), ("Red", "y")):
        for i, role in enumerate((*ROLES, "team")):
            row = dict.fromkeys(tabular.COLUMNS, "") | {"gameid": game, "league": "L", "year": "2025", "date": date, "game": str(number), "patch": "15.1", "side": side, "position": role, "teamname": team, "result": str(int(side == winner)), "firstPick": str(int(side == "Blue"))}
            if role != "team":
                row |= {"playername": f"{team}{i}", "champion": f"{side}{i}"}
            rows.append(row | {"kills": "9"} | {k: v for k, v in change.items() if role == "top" or k != "position"})
    return rows


def test_tabular_games_and_series(spark, tmp_path):
    rows = game_rows("g1", 1, "2025-01-01 10:00:00") + game_rows("g2", 2, "2025-01-01 11:00:00", "Red") + game_rows("g3", 1, "2025-01-02 10:00:00", position="coach") + game_rows("g4", 2, "2024-12-31 10:00:00")
    names = [*tabular.COLUMNS, "kills"]
    path = tmp_path / "in.csv"
    path.write_text("\n".join([",".join(names), *[",".join(r[n] for n in names) for r in rows]]) + "\n")
    accepted, rejected = tabular.games(tabular.read_csv(spark, str(path)))
    assert {r.gameid: r.reason for r in rejected.collect()} == {"g3": "invalid_role_roster"}
    series, late = tabular.with_series(accepted)
    got = {r.gameid: (r.blue_series_wins_before, r.red_series_wins_before, r.blue_win, r.first_pick_side, r.blue_players) for r in series.collect()}
    assert got == {"g1": (0, 0, True, "blue", [f"x{i}" for i in range(5)]), "g2": (1, 0, False, "blue", [f"x{i}" for i in range(5)])}
    assert {r.gameid: r.reason for r in late.collect()} == {"g4": "series_missing_game_one"}


def test_folding_beyond_ascii(spark):
    df = spark.createDataFrame([("  Ｆｕｌｌ  Straße ",), (None,)], "x string")
    assert [r[0] for r in df.select(folded_text("x")).collect()] == ["full strasse", None]


def test_metrics_edges(spark):
    one = spark.createDataFrame([(1, 0.0, "a"), (1, 1.0, "a")], "y int, p double, s string")
    assert M.roc_auc(one).first().auc is None
    assert M.bootstrap_interval(M.cluster_losses(one, "s"), 20).first().low is None
    many = spark.createDataFrame([(i % 2, (i % 10) / 10, str(i // 3)) for i in range(300)], "y int, p double, s string")
    row, again = (M.bootstrap_interval(M.cluster_losses(many, "s"), 100).first() for _ in range(2))
    mean = many.agg(M.log_loss(many.y, many.p)).first()[0]
    assert row == again and row.low < mean < row.high


def test_splits_refuse_too_few_times(spark):
    rows = spark.range(8).selectExpr("id as match_id", "timestamp_ntz'2024-01-01' + make_dt_interval(cast(id as int)) as ts")
    with pytest.raises(ValueError):
        S.by_fraction(rows, 0.6, 0.2)
    with pytest.raises(ValueError):
        S.rolling(rows, 0.1, 0.1, 3)
