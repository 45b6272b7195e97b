"""The canonical contest record: schema, row rules, JSON Lines in and out, key-checked appends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from priorline.operators import quarantine as Q

REQUEST = """request_schema_version string, match_timestamp string, league string, tournament string, region string, tournament_level string,
 is_official boolean, patch string, series_id string, game_number int, blue_series_wins_before int, red_series_wins_before int,
 blue_team string, red_team string, blue_team_id string, red_team_id string, blue_players array<string>, red_players array<string>,
 blue_player_ids array<string>, red_player_ids array<string>, blue_picks array<string>, red_picks array<string>,
 blue_bans array<string>, red_bans array<string>, first_pick_side string, fearless_bans array<string>"""
RECORD = "match_id string, " + REQUEST + ", blue_win boolean"
#: Fixed: the version of the record that is read; a record without one is taken as such.
VERSION = "2"
FIELDS = tuple(f.split()[0] for f in RECORD.replace("\n", "").split(","))
LISTS = ("blue_players", "red_players", "blue_player_ids", "red_player_ids", "blue_picks", "red_picks", "blue_bans", "red_bans", "fearless_bans")


def _blank(x: Column) -> Column:
    return x.isNull() | (F.trim(x) == "")


def _distinct(x: Column) -> Column:
    return F.size(F.array_distinct(x)) == F.size(x)


def checks() -> list[Q.Check]:
    """What a record must satisfy, in the order in which reasons are given."""
    c = F.col
    picks = F.concat("blue_picks", "red_picks")
    bans = F.concat("blue_bans", "red_bans")
    five = [F.size(c(n)) != 5 for n in ("blue_players", "red_players", "blue_picks", "red_picks")]
    ids = [F.coalesce(F.size(c(n)) != 5, F.lit(False)) for n in ("blue_player_ids", "red_player_ids")]
    bad_size = five[0]
    for x in five[1:] + ids:
        bad_size = bad_size | x
    blank_items = F.exists(F.flatten(F.array(*[F.coalesce(c(n), F.array().cast("array<string>")) for n in LISTS])), lambda x: _blank(x))
    zoned = c("match_timestamp").rlike("(Z|[+-]\\d{2}:?\\d{2})$") & F.try_to_timestamp("match_timestamp").isNotNull()
    return [
        ("extra_field", F.size("_extra") > 0),
        ("invalid_schema_version", F.coalesce(c("request_schema_version"), F.lit(VERSION)) != VERSION),
        ("missing_label", c("blue_win").isNull()),
        ("missing_required_value", _blank(c("match_id")) | _blank(c("league")) | _blank(c("tournament")) | _blank(c("blue_team")) | _blank(c("red_team"))),
        ("invalid_timestamp", ~zoned),
        ("invalid_patch", ~c("patch").rlike("^\\d+\\.(?:\\d+|S\\d+\\.\\d+)$")),
        ("invalid_list", bad_size | blank_items | (F.size("blue_bans") > 5) | (F.size("red_bans") > 5) | (F.size("fearless_bans") > 40)),
        ("same_team", (c("blue_team") == c("red_team")) | F.coalesce(c("blue_team_id") == c("red_team_id"), F.lit(False))),
        ("invalid_game_number", ~c("game_number").between(1, 9) | ~c("blue_series_wins_before").between(0, 4) | ~c("red_series_wins_before").between(0, 4) | (c("game_number") != c("blue_series_wins_before") + c("red_series_wins_before") + 1)),
        ("repeated_pick", ~_distinct(picks)),
        ("repeated_ban", ~_distinct(bans) | ~_distinct(c("fearless_bans"))),
        ("overlapping_draft", F.arrays_overlap(picks, bans) | F.arrays_overlap(picks, c("fearless_bans")) | F.arrays_overlap(bans, c("fearless_bans"))),
        ("invalid_first_pick", F.coalesce(~c("first_pick_side").isin("blue", "red"), F.lit(False))),
    ]


def normalised(rows: DataFrame) -> DataFrame:
    """Accepted rows with their time as a timestamp, and the patch without leading zeros."""
    head = F.regexp_extract("patch", "^0*(\\d+)\\.", 1)
    plain, season = F.regexp_extract("patch", "\\.0*(\\d+)$", 1), F.regexp_extract("patch", "\\.(S\\d+)\\.", 1)
    return rows.withColumn("patch", F.when(season != "", F.concat_ws(".", head, season, plain)).otherwise(F.concat_ws(".", head, plain))).withColumn("match_timestamp", F.to_timestamp("match_timestamp"))


def read_jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of a JSON Lines file; blank lines are skipped, and lines that are no JSON are rejected with their text."""
    lines = spark.read.text(path).filter("trim(value) <> ''")
    parsed = F.from_json("value", RECORD + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"})
    keys = F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>"))
    rows = lines.select(parsed.alias("r"), F.array_except(keys, F.array(*[F.lit(f) for f in FIELDS])).alias("_extra")).select("r.*", "_extra")
    broken = rows.filter("_corrupt is not null").select(F.lit(None).cast("string").alias("match_id"), F.lit("invalid_json").alias("reason"), F.col("_corrupt").alias("details"))
    accepted, rejected = Q.split(rows.filter("_corrupt is null").drop("_corrupt"), checks(), "match_id")
    return normalised(accepted.drop("_extra")), rejected.unionByName(broken)


def append_matches(rows: DataFrame, path: str) -> int:
    """Append to the table at path; nothing is written if a match_id is repeated or there already."""
    spark = rows.sparkSession
    if not rows.groupBy("match_id").count().filter("count > 1").isEmpty():
        raise ValueError("the batch repeats a match_id")
    if _exists(spark, path) and not rows.join(spark.read.parquet(path).select("match_id"), "match_id", "left_semi").isEmpty():
        raise ValueError("a match_id is in the table already")
    rows.write.mode("append").parquet(path)
    return rows.count()


def load_matches(spark: SparkSession, path: str, before: str | None = None) -> DataFrame:
    """The table in order of time and id; `before` is exclusive and reaches the scan."""
    rows = spark.read.parquet(path)
    if before is not None:
        rows = rows.filter(F.col("match_timestamp") < F.lit(before).cast("timestamp"))
    return rows.orderBy("match_timestamp", "match_id")


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
