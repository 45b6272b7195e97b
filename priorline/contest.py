"""Contests and their long-form facts, derived from the driver's order tables.

An order is a contest between two nations; its line items are the picks. Days hold several contests, so ties
in time are real.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priorline.session import looked_up, table

#: The same views as DuckDB statements, for oracles.
MATCHES_SQL = """m AS (SELECT o_orderkey AS match_id, o_orderdate AS ts, c_nationkey AS blue,
  CAST((c_nationkey + 1 + o_orderkey % 24) % 25 AS INTEGER) AS red, c_mktsegment AS league, o_orderpriority AS tier,
  CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS blue_win, o_custkey AS series_id
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
TEAMS_SQL = """tf AS (SELECT match_id, ts, league, 0 AS side, blue AS team, red AS opponent, blue_win AS win FROM m
  UNION ALL SELECT match_id, ts, league, 1 AS side, red AS team, blue AS opponent, 1 - blue_win AS win FROM m)"""
PICKS_SQL = """pk AS (SELECT m.match_id, m.ts, p.side, p.role, p.champion, p.player, CASE WHEN p.side = 0 THEN m.blue ELSE m.red END AS team,
  CASE WHEN p.side = 0 THEN blue_win ELSE 1 - blue_win END AS win, strftime(m.ts, '%Y.%m') AS patch
  FROM m JOIN (SELECT l_orderkey AS match_id, 1 - l_linenumber % 2 AS side, (l_linenumber - 1) // 2 AS role, min(p_brand) AS champion, min(l_suppkey) AS player
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL) p ON m.match_id = p.match_id)"""
#: Everything at a strictly earlier time; rows of one time see the same past.
PRIOR_SQL = "RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING"


def matches(spark: SparkSession, sf_dir: str, customer: DataFrame | None = None) -> DataFrame:
    """One row per contest: match_id, ts, blue, red, league, tier, blue_win, series_id."""
    orders, customer = table(spark, sf_dir, "orders"), customer or table(spark, sf_dir, "customer")
    red = ((F.col("c_nationkey") + 1 + F.col("o_orderkey") % 24) % 25).cast("int")
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        F.col("o_orderkey").alias("match_id"), F.col("o_orderdate").alias("ts"), F.col("c_nationkey").alias("blue"), red.alias("red"),
        F.col("c_mktsegment").alias("league"), F.col("o_orderpriority").alias("tier"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("blue_win"), F.col("o_custkey").alias("series_id"),
    )


def team_facts(m: DataFrame) -> DataFrame:
    """Two rows per contest; one pass, no union of scans."""
    sides = F.array(
        F.struct(F.lit(0).alias("side"), F.col("blue").alias("team"), F.col("red").alias("opponent"), F.col("blue_win").alias("win")),
        F.struct(F.lit(1).alias("side"), F.col("red").alias("team"), F.col("blue").alias("opponent"), (1 - F.col("blue_win")).alias("win")),
    )
    return m.select("match_id", "ts", "league", F.explode(sides).alias("s")).select("match_id", "ts", "league", "s.*")


def picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per contest, side and role: champion, player, team, win, patch."""
    lines, part, m = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part"), matches(spark, sf_dir)
    side, role = (1 - F.col("l_linenumber") % 2).cast("int"), F.floor((F.col("l_linenumber") - 1) / 2).cast("int")
    rows = lines.join(part, lines.l_partkey == part.p_partkey).groupBy(F.col("l_orderkey").alias("match_id"), side.alias("side"), role.alias("role"))
    slots = rows.agg(F.min("p_brand").alias("champion"), F.min("l_suppkey").alias("player"))
    blue = F.col("side") == 0
    return slots.join(m, "match_id").select(
        "match_id", "ts", "side", "role", "champion", "player", F.when(blue, F.col("blue")).otherwise(F.col("red")).alias("team"),
        F.when(blue, F.col("blue_win")).otherwise(1 - F.col("blue_win")).alias("win"), F.date_format("ts", "yyyy.MM").alias("patch"),
    )


def picks_by_contest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(match_id, picks): the picks of each contest that has any, as (side, role, champion, player) in order of side and role.

    Line items are dealt by contest first, so that both aggregations take them where they are.
    """
    lines, part = table(spark, sf_dir, "lineitem"), looked_up(spark, sf_dir, "part", "p_partkey", "p_brand")
    side, role = (1 - F.col("l_linenumber") % 2).cast("int"), F.floor((F.col("l_linenumber") - 1) / 2).cast("int")
    rows = lines.join(part, lines.l_partkey == part.p_partkey).select(F.col("l_orderkey").alias("match_id"), "l_linenumber", "p_brand", "l_suppkey").repartition("match_id")
    slots = rows.groupBy("match_id", side.alias("side"), role.alias("role")).agg(F.min("p_brand").alias("champion"), F.min("l_suppkey").alias("player"))
    return slots.groupBy("match_id").agg(F.array_sort(F.collect_list(F.struct("side", "role", "champion", "player"))).alias("picks"))


def drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """matches() with the picks of each contest, as picks_by_contest() gives them; null where it has none."""
    customer = looked_up(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    return matches(spark, sf_dir, customer).join(picks_by_contest(spark, sf_dir), "match_id", "left")


def drafted(met: DataFrame) -> DataFrame:
    """The rows of picks(), out of drafts() and without moving any."""
    rows = met.select("match_id", "ts", "blue", "red", "blue_win", F.explode("picks").alias("p"))
    blue = F.col("p.side") == 0
    return rows.select("match_id", "ts", "p.side", "p.role", "p.champion", "p.player", F.when(blue, F.col("blue")).otherwise(F.col("red")).alias("team"), F.when(blue, F.col("blue_win")).otherwise(1 - F.col("blue_win")).alias("win"))


def draft_pairs(met: DataFrame) -> DataFrame:
    """Two champions of a contest that are of one side (role is null) or meet in a role: match_id, ts, side, role, a, b and win.

    Side and win are those of the first one, who is blue where the two meet.
    """
    one = met.select("match_id", "ts", "blue_win", "picks", F.posexplode("picks").alias("i", "x"))
    two = one.select("match_id", "ts", "blue_win", "x", F.explode(F.slice("picks", F.col("i") + 2, F.size("picks"))).alias("y"))
    same = F.col("x.side") == F.col("y.side")
    rows = two.filter(same | (F.col("x.role") == F.col("y.role")))
    win = F.when(F.col("x.side") == 0, F.col("blue_win")).otherwise(1 - F.col("blue_win"))
    return rows.select("match_id", "ts", "x.side", F.when(~same, F.col("x.role")).alias("role"), F.col("x.champion").alias("a"), F.col("y.champion").alias("b"), win.alias("win"))
