"""The tabular adapter: twelve CSV rows for a game, two of teams and five roles of each side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priorline.functions.text import timestamp, tri_state
from priorline.operators import quarantine as Q
from priorline.operators.series import runs, score_before, validated

#: Fixed names of the columns that are read; everything else in a file is ignored, so later facts can't leak in.
COLUMNS = (
    "gameid", "league", "year", "split", "playoffs", "date", "game", "patch", "participantid", "side", "position", "playername", "playerid",
    "teamname", "teamid", "firstPick", "champion", "ban1", "ban2", "ban3", "ban4", "ban5", "datacompleteness", "result",
)
#: Fixed roles in order, and other names for them.
ROLES = ("top", "jungle", "mid", "bottom", "support")
ROLE_NAMES = {"top": "top", "jng": "jungle", "jungle": "jungle", "mid": "mid", "middle": "mid", "bot": "bottom", "adc": "bottom", "bottom": "bottom", "sup": "support", "support": "support", "team": "team"}
TIMES = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """The allowed columns as strings, empty ones as the empty string; a missing column is an error, but for firstPick."""
    raw = spark.read.option("header", True).csv(path)
    missing = [c for c in COLUMNS if c not in raw.columns and c != "firstPick"]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    picked = raw if "firstPick" in raw.columns else raw.withColumn("firstPick", F.lit(""))
    return picked.select(*COLUMNS).na.fill("")


def games(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): one row per game, from one aggregation; rejected games have their first reason."""
    named = rows.withColumn("role", F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ROLE_NAMES.items() for x in kv]), F.lower(F.trim("position"))), F.lower(F.trim("position"))))
    named = named.withColumn("side", F.lower(F.trim("side")))

    def team(side: str, column: str):
        return F.max(F.when((F.col("side") == side) & (F.col("role") == "team"), F.nullif(F.trim(column), F.lit(""))))

    def slots(side: str, column: str):
        own = [F.max(F.when((F.col("side") == side) & (F.col("role") == r), F.nullif(F.trim(column), F.lit("")))) for r in ROLES]
        return F.array_compact(F.array(*own))

    def bans(side: str):
        return F.array_compact(F.array(*[team(side, f"ban{i}") for i in range(1, 6)]))

    parts = [F.count_if((F.col("role") == "team") & (F.col("side") == s)).alias(f"{s}_team_rows") for s in ("blue", "red")]
    parts += [F.count_if(~F.col("role").isin("team", *ROLES)).alias("odd_roles"), F.count(F.lit(1)).alias("n_rows")]
    parts += [Q.unique_value(c).alias(f"u_{c}") for c in ("league", "year", "split", "date", "game", "patch")]
    for s in ("blue", "red"):
        parts += [team(s, "teamname").alias(f"{s}_team"), team(s, "teamid").alias(f"{s}_team_id"), team(s, "result").alias(f"{s}_result"), team(s, "firstPick").alias(f"{s}_first")]
        parts += [slots(s, "playername").alias(f"{s}_players"), slots(s, "playerid").alias(f"{s}_player_ids"), slots(s, "champion").alias(f"{s}_picks"), bans(s).alias(f"{s}_bans")]
    wide = named.groupBy("gameid").agg(*parts)
    wide = wide.withColumn("ts", timestamp(F.col("u_date.value"), TIMES)).withColumn("game_number", F.col("u_game.value").try_cast("int"))
    wide = wide.withColumn("blue_win", tri_state(F.col("blue_result"))).withColumn("red_win", tri_state(F.col("red_result")))
    first = F.when(tri_state(F.col("blue_first")), "blue").when(tri_state(F.col("red_first")), "red")
    wide = wide.withColumn("first_pick_side", first)
    complete = (F.size("blue_players") == 5) & (F.size("red_players") == 5) & (F.size("blue_picks") == 5) & (F.size("red_picks") == 5)
    checks = [
        ("missing_required_value", F.col("u_league.n") * F.col("u_date.n") * F.col("u_game.n") * F.col("u_patch.n") == 0),
        ("inconsistent_source_values", F.greatest("u_league.n", "u_date.n", "u_game.n", "u_patch.n") > 1),
        ("invalid_timestamp", F.col("ts").isNull()),
        ("invalid_team_rows", (F.col("blue_team_rows") != 1) | (F.col("red_team_rows") != 1) | (F.col("blue_team") == F.col("red_team"))),
        ("invalid_role_roster", (F.col("odd_roles") > 0) | (F.col("n_rows") != 12) | ~complete),
        ("inconsistent_first_pick", tri_state(F.col("blue_first")).eqNullSafe(True) & tri_state(F.col("red_first")).eqNullSafe(True)),
        ("inconsistent_result", F.col("blue_win").isNull() | F.col("blue_win").eqNullSafe(F.col("red_win")) | F.col("red_win").isNull()),
        ("invalid_game_number", ~F.col("game_number").between(1, 9)),
    ]
    marked = Q.marked(wide, checks)
    out = ["gameid", F.col("u_league.value").alias("league"), F.col("u_patch.value").alias("patch"), "ts", "game_number", "blue_team", "red_team", "blue_team_id", "red_team_id", "blue_players", "red_players"]
    out += ["blue_picks", "red_picks", "blue_bans", "red_bans", "first_pick_side", F.col("blue_win")]
    return marked.filter("reason is null").select(*out), marked.filter("reason is not null").select("gameid", "reason")


def with_series(accepted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(games with series_run and both sides' wins before, rejected): a whole series is rejected if its games or times don't rise."""
    pair = F.concat_ws("|", F.array_sort(F.array("blue_team", "red_team")))
    runs_of = runs(accepted.withColumn("pair", pair), ["league", "pair"], "game_number", ["ts", "gameid"])
    checked = validated(runs_of, ["league", "pair", "run"], "game_number", "ts", ["gameid"])
    reason = F.when(F.col("run") == 0, "series_missing_game_one").otherwise(F.col("problem"))
    marked = checked.withColumn("reason", reason)
    good = marked.filter("reason is null")
    won = good.select("gameid", "league", "pair", "run", "game_number", F.explode(F.array(F.struct(F.col("blue_team").alias("team"), F.col("blue_win").cast("int").alias("win")), F.struct(F.col("red_team").alias("team"), (~F.col("blue_win")).cast("int").alias("win")))).alias("t"))
    before = score_before(won.select("gameid", "league", "pair", "run", "game_number", "t.*"), ["league", "pair", "run"], "team", "win", ["game_number"])
    scores = before.select("gameid", "team", "wins_before")
    blue = scores.select("gameid", F.col("team").alias("blue_team"), F.col("wins_before").alias("blue_series_wins_before"))
    red = scores.select("gameid", F.col("team").alias("red_team"), F.col("wins_before").alias("red_series_wins_before"))
    rows = good.join(blue, ["gameid", "blue_team"]).join(red, ["gameid", "red_team"])
    return rows.withColumnRenamed("run", "series_run").drop("reason", "problem", "pair"), marked.filter("reason is not null").select("gameid", "reason")
