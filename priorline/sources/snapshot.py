"""Whole-document JSON snapshots: an envelope that is checked, and rows that are oriented to sides and checked one by one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priorline.functions.text import timestamp, tri_state, without_sentinels
from priorline.operators import quarantine as Q

TEXTS = ("game_id", "match_id", "overview_page", "league", "tournament", "region", "tournament_level", "is_official", "timestamp", "patch", "team1", "team2", "blue", "red", "winner", "game_number", "first_pick", "first_selection", "selection", "pick_selection")
LISTS = ("team1_picks", "team2_picks", "team1_players", "team2_players", "team1_bans", "team2_bans")
ROW = ", ".join([*(f"{c}: string" for c in TEXTS), *(f"{c}: array<string>" for c in LISTS)])
ENVELOPE = f"snapshot_schema_version string, source_name string, source_endpoint string, retrieved_at string, interval struct<start_inclusive: string, end_exclusive: string>, query_fields map<string, string>, row_count int, rows array<struct<{ROW}>>"
VERSIONS = ("1", "2")


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a snapshot with start, end and row_index; an envelope that doesn't hold together is an error."""
    whole = spark.read.schema(ENVELOPE).option("multiLine", True).json(path)
    head = whole.select("snapshot_schema_version", "row_count", F.size("rows").alias("n"), F.to_timestamp("interval.start_inclusive").alias("a"), F.to_timestamp("interval.end_exclusive").alias("b")).collect()
    if len(head) != 1 or head[0].snapshot_schema_version not in VERSIONS:
        raise ValueError("this is no snapshot of a known version")
    if head[0].row_count != head[0].n or head[0].a is None or head[0].b is None or head[0].a >= head[0].b:
        raise ValueError("the snapshot's envelope and rows disagree")
    opened = whole.select(F.to_timestamp("interval.start_inclusive").alias("start"), F.to_timestamp("interval.end_exclusive").alias("end"), F.posexplode("rows").alias("row_index", "r"))
    return opened.select("start", "end", "row_index", "r.*")


def games(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) with teams, lists and the result turned to sides; the first failing check is the reason."""
    blue_is_1 = F.col("blue") == F.col("team1")
    marked = Q.first_wins(rows.withColumn("ts", timestamp(F.col("timestamp"), ["yyyy-MM-dd HH:mm:ss"])), ["game_id"], ["row_index"])
    marked = marked.withColumn("official", tri_state(F.col("is_official"))).withColumn("number", F.col("game_number").try_cast("int"))

    def blank(c: str):
        return F.coalesce(F.trim(c) == "", F.lit(True))

    pair = (blue_is_1 & (F.col("red") == F.col("team2"))) | ((F.col("blue") == F.col("team2")) & (F.col("red") == F.col("team1")))
    lists = (F.size("team1_picks") != 5) | (F.size("team2_picks") != 5) | (F.size("team1_players") != 5) | (F.size("team2_players") != 5)
    checks = [
        ("missing_required_value", blank("game_id") | blank("league") | blank("team1") | blank("team2") | blank("blue") | blank("red") | blank("patch")),
        ("invalid_boolean_value", F.col("is_official").isNotNull() & F.col("official").isNull()),
        ("invalid_source_list", F.coalesce(lists, F.lit(True))),
        ("invalid_timestamp", F.col("ts").isNull()),
        ("inconsistent_side_assignment", ~pair),
        ("invalid_winner", F.coalesce(~F.trim("winner").isin("1", "2"), F.lit(True))),
        ("invalid_game_number", F.coalesce(~F.col("number").between(1, 9), F.lit(True))),
        ("inconsistent_first_pick", F.coalesce(~F.col("first_pick").isin("") & (F.col("first_pick") != F.col("team1")) & (F.col("first_pick") != F.col("team2")), F.lit(False))),
        ("timestamp_outside_snapshot_interval", (F.col("ts") < F.col("start")) | (F.col("ts") >= F.col("end"))),
        ("duplicate_source_game", F.col("duplicate")),
    ]

    def side(name: str, blue: bool):
        mine = blue_is_1 if blue else ~blue_is_1
        return F.when(mine, F.col(f"team1_{name}")).otherwise(F.col(f"team2_{name}"))

    all_rows = Q.marked(marked, checks)
    out = ["game_id", "match_id", "league", "tournament", "region", "tournament_level", F.col("official").alias("is_official"), "ts", "patch", F.col("number").alias("game_number"), F.col("blue").alias("blue_team"), F.col("red").alias("red_team")]
    for s, blue in (("blue", True), ("red", False)):
        out += [side("picks", blue).alias(f"{s}_picks"), side("players", blue).alias(f"{s}_players"), without_sentinels(F.coalesce(side("bans", blue), F.array().cast("array<string>"))).alias(f"{s}_bans")]
    first = F.when(F.col("first_pick") == F.col("blue"), "blue").when(F.col("first_pick") == F.col("red"), "red")
    out += [first.alias("first_pick_side"), ((F.col("winner") == "1") == blue_is_1).alias("blue_win")]
    return all_rows.filter("reason is null").select(*out), all_rows.filter("reason is not null").select("game_id", "row_index", "reason")
