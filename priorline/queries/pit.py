"""Point-in-time features: everything a row may know of strictly earlier times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from priorline.contest import MATCHES_SQL, PICKS_SQL, PRIOR_SQL, TEAMS_SQL, matches, picks, team_facts
from priorline.operators.asof import as_of, days_between, decayed, prior_table, smoothed, with_prior
from priorline.registry import query

ONE = "1"
#: Fixed strengths of the priors.
RATE, PLAYER_CHAMPION, SYNERGY, MATCHUP = 6.0, 3.0, 16.0, 12.0
FORM = 8
WON_AND_PLAYED = {"wins": "win", "games": ONE}


def _global(m: DataFrame) -> DataFrame:
    """Blue wins and contests before each time, from one row per time."""
    return prior_table(m, [], {"g_wins": F.col("blue_win"), "g_games": ONE})


@query(f"""WITH {MATCHES_SQL}, {TEAMS_SQL}
SELECT match_id, side, team, coalesce(CAST(sum(win) OVER p AS BIGINT), 0) AS wins, count(*) OVER p AS games,
  round((coalesce(sum(win) OVER p, 0) + 3.0) / (count(*) OVER p + 6.0), 10) AS rate, round(ln(1 + count(*) OVER p), 10) AS games_log
FROM tf WINDOW p AS (PARTITION BY team ORDER BY ts {PRIOR_SQL})""")
def pit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_prior(team_facts(matches(spark, sf_dir)), ["team"], WON_AND_PLAYED)
    rate = smoothed(F.col("wins"), F.col("games"), 0.5, RATE)
    return rows.select("match_id", "side", "team", "wins", "games", F.round(rate, 10).alias("rate"), F.round(F.log1p("games"), 10).alias("games_log"))


@query(f"""WITH {MATCHES_SQL} SELECT match_id, round((coalesce(sum(blue_win) OVER p, 0) + 3.0) / (count(*) OVER p + 6.0), 10) AS blue_side_prior
FROM m WINDOW p AS (ORDER BY ts {PRIOR_SQL})""")
def pit_global_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matches(spark, sf_dir)
    rows = m.join(_global(m), "ts")
    return rows.select("match_id", F.round(smoothed(F.col("g_wins"), F.col("g_games"), 0.5, RATE), 10).alias("blue_side_prior"))


@query(f"""WITH {MATCHES_SQL}, g AS (SELECT *, (coalesce(sum(blue_win) OVER p, 0) + 3.0) / (count(*) OVER p + 6.0) AS gp FROM m WINDOW p AS (ORDER BY ts {PRIOR_SQL}))
SELECT match_id, league, round((coalesce(sum(blue_win) OVER p, 0) + 6.0 * gp) / (count(*) OVER p + 6.0), 10) AS league_blue_side_prior
FROM g WINDOW p AS (PARTITION BY league ORDER BY ts {PRIOR_SQL})""")
def pit_league_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matches(spark, sf_dir)
    rows = with_prior(m.withColumn("win", F.col("blue_win")), ["league"], WON_AND_PLAYED).join(_global(m), "ts")
    base = smoothed(F.col("g_wins"), F.col("g_games"), 0.5, RATE)
    return rows.select("match_id", "league", F.round(smoothed(F.col("wins"), F.col("games"), base, RATE), 10).alias("league_blue_side_prior"))


#: Which side picked first is known for tiers 1 to 4 only; odd contests had blue first.
_FIRST_SQL = "CASE WHEN tier LIKE '5%' THEN NULL WHEN match_id % 2 = 1 THEN 1 ELSE 0 END"


@query(f"""WITH {MATCHES_SQL}, f AS (SELECT *, {_FIRST_SQL} AS bf FROM m),
w AS (SELECT *, CASE WHEN bf IS NULL THEN NULL WHEN bf = 1 THEN blue_win ELSE 1 - blue_win END AS fw FROM f),
p AS (SELECT *, (coalesce(sum(fw) OVER q, 0) + 3.0) / (count(fw) OVER q + 6.0) AS pr FROM w WINDOW q AS (ORDER BY ts {PRIOR_SQL}))
SELECT match_id, CASE WHEN bf IS NULL THEN 0.0 WHEN bf = 1 THEN 1.0 ELSE -1.0 END::DOUBLE AS blue_first_pick, CASE WHEN bf IS NULL THEN 0 ELSE 1 END AS first_pick_known,
  round(CASE WHEN bf IS NULL THEN 0.5 WHEN bf = 1 THEN pr ELSE 1 - pr END, 10) AS blue_first_pick_prior FROM p""")
def pit_first_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matches(spark, sf_dir)
    first = F.when(F.col("tier").startswith("5"), None).when(F.col("match_id") % 2 == 1, 1).otherwise(0)
    rows = m.withColumn("bf", first).withColumn("fw", F.when(F.col("bf") == 1, F.col("blue_win")).when(F.col("bf") == 0, 1 - F.col("blue_win")))
    state = prior_table(rows, [], {"wins": F.coalesce("fw", F.lit(0)), "games": F.col("fw").isNotNull().cast("long")})
    prior = smoothed(F.col("wins"), F.col("games"), 0.5, RATE)
    unknown = F.col("bf").isNull()
    return rows.join(state, "ts").select(
        "match_id", F.when(unknown, 0.0).when(F.col("bf") == 1, 1.0).otherwise(-1.0).alias("blue_first_pick"), F.when(unknown, 0).otherwise(1).alias("first_pick_known"),
        F.round(F.when(unknown, 0.5).when(F.col("bf") == 1, prior).otherwise(1 - prior), 10).alias("blue_first_pick_prior"),
    )


def recent_form(facts: DataFrame, keys: list[str], size: int) -> DataFrame:
    """(keys, ts, form_wins, form_games): the last `size` results strictly before each time, in order of match and side.

    A time keeps its own last `size` results at most. It has one at least, so the form is in the `size` times before.
    """
    latest = Window.partitionBy(*keys, "ts").orderBy(F.desc("match_id"), F.desc("side"))
    last = facts.select(*keys, "ts", "match_id", "side", "win").withColumn("n", F.row_number().over(latest)).filter(F.col("n") <= size)
    own = last.groupBy(*keys, "ts").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "win"))), lambda x: x["win"]).alias("own"))
    before = F.collect_list("own").over(Window.partitionBy(*keys).orderBy("ts").rowsBetween(-size, -1))
    form = own.select(*keys, "ts", F.slice(F.flatten(F.reverse(before)), 1, size).alias("form"))
    wins = F.aggregate("form", F.lit(0).cast("long"), lambda total, win: total + win)
    return form.select(*keys, "ts", wins.alias("form_wins"), F.size("form").cast("long").alias("form_games"))


@query(f"""WITH {MATCHES_SQL}, {TEAMS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY ts, match_id, side) AS n FROM tf),
e AS (SELECT team, ts, min(n) - 1 AS upto FROM r GROUP BY team, ts),
f AS (SELECT e.team, e.ts, avg(r.win) AS form FROM e LEFT JOIN r ON r.team = e.team AND r.n <= e.upto AND r.n > e.upto - 8 GROUP BY e.team, e.ts)
SELECT tf.match_id, tf.side, round(coalesce(f.form, 0.5), 10) AS team_form FROM tf JOIN f ON tf.team = f.team AND tf.ts = f.ts""")
def pit_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = team_facts(matches(spark, sf_dir))
    rows = facts.join(recent_form(facts, ["team"], FORM), ["team", "ts"])
    return rows.select("match_id", "side", F.round(F.when(F.col("form_games") > 0, F.col("form_wins") / F.col("form_games")).otherwise(0.5), 10).alias("team_form"))


@query(f"""WITH {MATCHES_SQL}, {TEAMS_SQL}, s AS (SELECT *, max(ts) OVER (PARTITION BY team ORDER BY ts {PRIOR_SQL}) AS seen FROM tf)
SELECT match_id, side, seen AS last_seen, round(coalesce(ln(1 + greatest(0, epoch_us(ts) - epoch_us(seen)) / 86400000000.0), 0), 10) AS inactivity_log_days FROM s""")
def pit_inactivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_prior(team_facts(matches(spark, sf_dir)), ["team"], {}, maxima={"last_seen": F.col("ts")})
    days = F.greatest(days_between(F.col("ts"), F.col("last_seen")), F.lit(0.0))
    return rows.select("match_id", "side", "last_seen", F.round(F.coalesce(F.when(F.col("last_seen").isNotNull(), F.log1p(days)), F.lit(0.0)), 10).alias("inactivity_log_days"))


@query("""SELECT o_orderkey, round(1500 + (o_totalprice / 100 - 1500) * pow(0.5, (o_orderkey % 1000) / 365.0), 10) AS rating,
  round(1500 + (o_totalprice / 100 - 1500) * pow(0.5, 0 / 365.0), 10) AS unseen FROM orders""")
def rating_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    value = F.col("o_totalprice") / 100
    return o.select("o_orderkey", F.round(decayed(value, (F.col("o_orderkey") % 1000).cast("double"), 365.0), 10).alias("rating"), F.round(decayed(value, F.lit(None).cast("double"), 365.0), 10).alias("unseen"))


def _rates(keys_sql: str, own: str) -> str:
    """A rate of a composite key, shrunk to the champion's own rate before."""
    return f"""WITH {MATCHES_SQL}, {PICKS_SQL}, c AS (SELECT *, (coalesce(sum(win) OVER p, 0) + 3.0) / (count(*) OVER p + 6.0) AS base
  FROM pk WINDOW p AS (PARTITION BY champion ORDER BY ts {PRIOR_SQL}))
SELECT match_id, side, role, count(*) OVER p AS games, round((coalesce(sum(win) OVER p, 0) + {own} * base) / (count(*) OVER p + {own}), 10) AS rate
FROM c WINDOW p AS (PARTITION BY {keys_sql} ORDER BY ts {PRIOR_SQL})"""


def _shrunk(pk: DataFrame, keys: list[str], strength: float) -> DataFrame:
    base = prior_table(pk, ["champion"], {"c_wins": F.col("win"), "c_games": ONE})
    rows = with_prior(pk, keys, WON_AND_PLAYED).join(base, ["champion", "ts"])
    prior = smoothed(F.col("c_wins"), F.col("c_games"), 0.5, RATE)
    return rows.select("match_id", "side", "role", "games", F.round(smoothed(F.col("wins"), F.col("games"), prior, strength), 10).alias("rate"))


@query(f"""WITH {MATCHES_SQL}, {PICKS_SQL} SELECT match_id, side, round(avg(rate), 10) AS strength FROM
  (SELECT match_id, side, (coalesce(sum(win) OVER p, 0) + 3.0) / (count(*) OVER p + 6.0) AS rate FROM pk WINDOW p AS (PARTITION BY champion ORDER BY ts {PRIOR_SQL}))
GROUP BY match_id, side""")
def pit_champion_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_prior(picks(spark, sf_dir), ["champion"], WON_AND_PLAYED)
    return rows.groupBy("match_id", "side").agg(F.round(F.avg(smoothed(F.col("wins"), F.col("games"), 0.5, RATE)), 10).alias("strength"))


@query(_rates("role, champion", "6.0"))
def pit_role_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shrunk(picks(spark, sf_dir), ["role", "champion"], RATE)


@query(_rates("patch, champion", "6.0"))
def pit_patch_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shrunk(picks(spark, sf_dir), ["patch", "champion"], RATE)


@query(_rates("player, champion", "3.0"))
def pit_player_champion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shrunk(picks(spark, sf_dir), ["player", "champion"], PLAYER_CHAMPION)


@query(f"""WITH {MATCHES_SQL}, {PICKS_SQL}, c AS (SELECT *, (coalesce(sum(win) OVER p, 0) + 3.0) / (count(*) OVER p + 6.0) AS base FROM pk WINDOW p AS (PARTITION BY champion ORDER BY ts {PRIOR_SQL})),
pr AS (SELECT x.match_id, x.ts, x.side, x.win, least(x.champion, y.champion) AS a, greatest(x.champion, y.champion) AS b, (x.base + y.base) / 2 AS base
  FROM c x JOIN c y ON x.match_id = y.match_id AND x.side = y.side AND x.role < y.role),
s AS (SELECT *, (coalesce(sum(win) OVER p, 0) + 16.0 * base) / (count(*) OVER p + 16.0) AS rate FROM pr WINDOW p AS (PARTITION BY a, b ORDER BY ts {PRIOR_SQL}))
SELECT match_id, side, round(avg(rate), 10) AS synergy, count(*) AS pairs FROM s GROUP BY match_id, side""")
def pit_synergy(spark: SparkSession, sf_dir: str) -> DataFrame:
    pk = picks(spark, sf_dir)
    base = prior_table(pk, ["champion"], {"c_wins": F.col("win"), "c_games": ONE})
    rated = pk.join(base, ["champion", "ts"]).withColumn("base", smoothed(F.col("c_wins"), F.col("c_games"), 0.5, RATE))
    pairs = team_pairs(rated)
    rows = with_prior(pairs, ["a", "b"], WON_AND_PLAYED)
    rate = smoothed(F.col("wins"), F.col("games"), F.col("base"), SYNERGY)
    return rows.groupBy("match_id", "side").agg(F.round(F.avg(rate), 10).alias("synergy"), F.count(F.lit(1)).alias("pairs"))


def team_pairs(rated: DataFrame) -> DataFrame:
    """Unordered pairs of a side's champions, out of the side's own array: at most ten of a full roster, no self-join."""
    sides = rated.groupBy("match_id", "ts", "side", "win").agg(F.array_sort(F.collect_list(F.struct("role", "champion", "base"))).alias("p"))
    one = sides.select("match_id", "ts", "side", "win", "p", F.posexplode("p").alias("i", "x"))
    two = one.select("match_id", "ts", "side", "win", "x", F.explode(F.slice("p", F.col("i") + 2, F.size("p"))).alias("y"))
    return two.select(
        "match_id", "ts", "side", "win", F.least("x.champion", "y.champion").alias("a"), F.greatest("x.champion", "y.champion").alias("b"),
        ((F.col("x.base") + F.col("y.base")) / 2).alias("base"),
    )


@query(f"""WITH {MATCHES_SQL}, {PICKS_SQL}, mu AS (SELECT x.match_id, x.ts, x.side, x.role, x.champion AS a, y.champion AS b, x.win FROM pk x JOIN pk y
  ON x.match_id = y.match_id AND x.role = y.role AND x.side <> y.side)
SELECT match_id, side, role, count(*) OVER p AS games, round((coalesce(sum(win) OVER p, 0) + 6.0) / (count(*) OVER p + 12.0), 10) AS rate
FROM mu WINDOW p AS (PARTITION BY role, a, b ORDER BY ts {PRIOR_SQL})""")
def pit_matchup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_prior(role_matchups(picks(spark, sf_dir)), ["role", "a", "b"], WON_AND_PLAYED)
    return rows.select("match_id", "side", "role", "games", F.round(smoothed(F.col("wins"), F.col("games"), 0.5, MATCHUP), 10).alias("rate"))


def role_matchups(pk: DataFrame) -> DataFrame:
    """Both directions of each role's meeting, from one aggregation per contest and role."""
    slot = {s: F.max(F.when(F.col("side") == s, F.struct("champion", "win"))).alias(n) for s, n in ((0, "blue"), (1, "red"))}
    met = pk.groupBy("match_id", "ts", "role").agg(*slot.values()).filter("blue is not null and red is not null")
    way = [F.struct(F.lit(s).alias("side"), F.col(f"{x}.champion").alias("a"), F.col(f"{y}.champion").alias("b"), F.col(f"{x}.win").alias("win")) for s, x, y in ((0, "blue", "red"), (1, "red", "blue"))]
    return met.select("match_id", "ts", "role", F.explode(F.array(*way)).alias("w")).select("match_id", "ts", "role", "w.*")


@query(f"""WITH {MATCHES_SQL}, {TEAMS_SQL} SELECT match_id, side, count(*) OVER p AS games, round((coalesce(sum(win) OVER p, 0) + 3.0) / (count(*) OVER p + 6.0), 10) AS rate
FROM tf WINDOW p AS (PARTITION BY team, opponent ORDER BY ts {PRIOR_SQL})""")
def pit_head_to_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_prior(team_facts(matches(spark, sf_dir)), ["team", "opponent"], WON_AND_PLAYED)
    return rows.select("match_id", "side", "games", F.round(smoothed(F.col("wins"), F.col("games"), 0.5, RATE), 10).alias("rate"))


@query(f"""WITH {MATCHES_SQL}, {PICKS_SQL} SELECT match_id, side, round(avg(ln(1 + g)), 10) AS experience, min(g) AS min_games FROM
  (SELECT match_id, side, count(*) OVER (PARTITION BY player ORDER BY ts {PRIOR_SQL}) AS g FROM pk) GROUP BY match_id, side""")
def pit_roster_experience(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_prior(picks(spark, sf_dir), ["player"], {"games": ONE})
    return rows.groupBy("match_id", "side").agg(F.round(F.avg(F.log1p("games")), 10).alias("experience"), F.min("games").alias("min_games"))


@query(f"""WITH {MATCHES_SQL}, {PICKS_SQL} SELECT match_id, side, round(avg(ln(1 + g)), 10) AS experience FROM
  (SELECT match_id, side, count(*) OVER (PARTITION BY team, player ORDER BY ts {PRIOR_SQL}) AS g FROM pk) GROUP BY match_id, side""")
def pit_team_roster_experience(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_prior(picks(spark, sf_dir), ["team", "player"], {"games": ONE})
    return rows.groupBy("match_id", "side").agg(F.round(F.avg(F.log1p("games")), 10).alias("experience"))


@query(f"""WITH {MATCHES_SQL}, {PICKS_SQL}, r AS (SELECT match_id, ts, side, team, list_distinct(list(player)) AS roster FROM pk GROUP BY ALL),
l AS (SELECT team, ts, arg_max(roster, (match_id, 1 - side)) AS roster FROM r GROUP BY team, ts),
b AS (SELECT *, lag(roster) OVER (PARTITION BY team ORDER BY ts) AS prev FROM l)
SELECT r.match_id, r.side, round(coalesce(len(list_intersect(r.roster, b.prev)), 0) / 5.0, 10) AS continuity FROM r JOIN b ON r.team = b.team AND r.ts = b.ts""")
def pit_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rosters = picks(spark, sf_dir).groupBy("match_id", "ts", "side", "team").agg(F.collect_set("player").alias("roster"))
    rows = with_prior(rosters, ["team"], {}, last={"previous": F.col("roster")}, order=F.struct("match_id", 1 - F.col("side")))
    shared = F.coalesce(F.size(F.array_intersect("roster", "previous")), F.lit(0))
    return rows.select("match_id", "side", F.round(F.when(F.col("previous").isNull(), 0.0).otherwise(shared / 5.0), 10).alias("continuity"))


@query(f"""WITH {MATCHES_SQL}, {PICKS_SQL} SELECT match_id, side, round(avg(CASE WHEN g > 0 THEN 1.0 ELSE 0.0 END), 10) AS known FROM
  (SELECT match_id, side, count(*) OVER (PARTITION BY champion ORDER BY ts {PRIOR_SQL}) AS g FROM pk) GROUP BY match_id, side""")
def pit_known_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_prior(picks(spark, sf_dir), ["champion"], {"games": ONE})
    return rows.groupBy("match_id", "side").agg(F.round(F.avg((F.col("games") > 0).cast("double")), 10).alias("known"))


#: A contest bans the champion named by its customer and the next one; bans are probes, never facts.
_BAN_SQL = "bans AS (SELECT match_id, ts, 'Brand#' || CAST(1 + (series_id + k) % 5 AS VARCHAR) || CAST(1 + match_id % 5 AS VARCHAR) AS champion FROM m, (SELECT unnest([0, 1]) AS k) WHERE match_id % 7 <> 0)"


@query(f"""WITH {MATCHES_SQL}, {PICKS_SQL}, {_BAN_SQL}, r AS (SELECT b.match_id, b.champion, (count(p.win) FILTER (p.win = 1) + 3.0) / (count(p.win) + 6.0) AS rate
  FROM bans b LEFT JOIN pk p ON p.champion = b.champion AND p.ts < b.ts GROUP BY b.match_id, b.champion)
SELECT m.match_id, round(coalesce(avg(rate), 0.5), 10) AS ban_strength FROM m LEFT JOIN r ON m.match_id = r.match_id GROUP BY m.match_id""")
def pit_ban_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matches(spark, sf_dir)
    number = F.explode(F.array(F.lit(0), F.lit(1)))
    bans = m.filter("match_id % 7 <> 0").withColumn("k", number).select("match_id", "ts", F.concat(F.lit("Brand#"), (1 + (F.col("series_id") + F.col("k")) % 5).cast("string"), (1 + F.col("match_id") % 5).cast("string")).alias("champion"))
    facts = picks(spark, sf_dir).select("champion", "ts", "win", F.lit(1).cast("long").alias("one"))
    rated = as_of(bans, facts, ["champion"], {"wins": F.coalesce("win", F.lit(0)), "games": F.coalesce("one", F.lit(0))})
    mean = rated.groupBy("match_id").agg(F.avg(smoothed(F.col("wins"), F.col("games"), 0.5, RATE)).alias("mean"))
    return m.select("match_id").join(mean, "match_id", "left").select("match_id", F.round(F.coalesce("mean", F.lit(0.5)), 10).alias("ban_strength"))


@query(f"""WITH {MATCHES_SQL}, {PICKS_SQL}, {_BAN_SQL.replace('SELECT match_id, ts,', 'SELECT match_id, ts, k AS side,')}
SELECT b.match_id, b.side, round((count(p.win) FILTER (p.win = 1) + 3.0) / (count(p.win) + 6.0), 10) AS strength
FROM bans b LEFT JOIN pk p ON p.champion = b.champion AND p.ts < b.ts GROUP BY b.match_id, b.side""")
def pit_side_bans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strength of each side's ban; contests without bans have no row."""
    facts = picks(spark, sf_dir).select("champion", "ts", "win", F.lit(1).cast("long").alias("one"))
    rated = as_of(side_bans(matches(spark, sf_dir)), facts, ["champion"], {"wins": F.coalesce("win", F.lit(0)), "games": F.coalesce("one", F.lit(0))})
    return rated.select("match_id", "side", F.round(smoothed(F.col("wins"), F.col("games"), 0.5, RATE), 10).alias("strength"))


def side_bans(m: DataFrame) -> DataFrame:
    """(match_id, ts, side, champion): one ban for a side."""
    return m.filter("match_id % 7 <> 0").withColumn("side", F.explode(F.array(F.lit(0), F.lit(1)))).select("match_id", "ts", "side", ban_of(F.col("side")).alias("champion"))


def ban_of(side: Column | int) -> Column:
    """The champion that a side of a contest bans, if the contest has bans."""
    return F.concat(F.lit("Brand#"), (1 + (F.col("series_id") + side) % 5).cast("string"), (1 + F.col("match_id") % 5).cast("string"))


@query(f"""WITH {MATCHES_SQL} SELECT match_id, CAST(coalesce(sum(blue_win) OVER p, 0) AS BIGINT) AS blue_before, CAST(coalesce(sum(1 - blue_win) OVER p, 0) AS BIGINT) AS red_before
FROM m WINDOW p AS (PARTITION BY series_id ORDER BY ts {PRIOR_SQL})""")
def pit_series_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each side won of the series before."""
    rows = with_prior(matches(spark, sf_dir), ["series_id"], {"blue_before": "blue_win", "red_before": "1 - blue_win"})
    return rows.select("match_id", "blue_before", "red_before")


@query(f"""WITH {MATCHES_SQL}, f AS (SELECT *, CASE WHEN match_id % 3 = 0 THEN NULL ELSE tier END AS own FROM m),
l AS (SELECT league, ts, arg_max(own, match_id) FILTER (own IS NOT NULL) AS v FROM f GROUP BY league, ts),
p AS (SELECT league, ts, last_value(v IGNORE NULLS) OVER (PARTITION BY league ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM l)
SELECT f.match_id, coalesce(f.own, p.prev) AS level, CASE WHEN f.own IS NULL AND p.prev IS NOT NULL THEN 1 ELSE 0 END AS inferred FROM f JOIN p ON f.league = p.league AND f.ts = p.ts""")
def pit_metadata_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = matches(spark, sf_dir).withColumn("own", F.when(F.col("match_id") % 3 != 0, F.col("tier")))
    rows = with_prior(facts, ["league"], {}, last={"previous": F.col("own")}, order=F.struct("match_id"))
    return rows.select("match_id", F.coalesce("own", "previous").alias("level"), (F.col("own").isNull() & F.col("previous").isNotNull()).cast("int").alias("inferred"))


_REGION_SQL = "CASE WHEN league = 'MACHINERY' THEN NULL WHEN match_id % 4 = 0 THEN 'International' ELSE league END"


@query(f"""WITH {MATCHES_SQL}, {TEAMS_SQL}, t AS (SELECT *, {_REGION_SQL} AS region FROM tf),
l AS (SELECT team, ts, arg_max(region, (match_id, 1 - side)) FILTER (region <> 'International') AS v FROM t GROUP BY team, ts),
p AS (SELECT team, ts, last_value(v IGNORE NULLS) OVER (PARTITION BY team ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM l)
SELECT t.match_id, t.side, CASE WHEN t.region IS NOT NULL AND t.region <> 'International' THEN t.region ELSE p.prev END AS home_region FROM t JOIN p ON t.team = p.team AND t.ts = p.ts""")
def pit_home_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = F.when(F.col("league") == "MACHINERY", None).when(F.col("match_id") % 4 == 0, "International").otherwise(F.col("league"))
    facts = team_facts(matches(spark, sf_dir)).withColumn("region", region)
    home = F.when(F.col("region") != "International", F.col("region"))
    rows = with_prior(facts, ["team"], {}, last={"previous": home}, order=F.struct("match_id", 1 - F.col("side")))
    return rows.select("match_id", "side", F.coalesce(home, F.col("previous")).alias("home_region"))


@query(f"""WITH {MATCHES_SQL}, {TEAMS_SQL}, a AS (SELECT *, CAST(team % 10 AS VARCHAR) AS alias FROM tf),
p AS (SELECT *, min(team) OVER w AS lo, max(team) OVER w AS hi FROM a WINDOW w AS (PARTITION BY alias ORDER BY ts {PRIOR_SQL}))
SELECT match_id, side, alias, CASE WHEN lo = hi THEN lo ELSE -1 END AS resolved, CASE WHEN lo < hi THEN 1 ELSE 0 END AS ambiguous FROM p""")
def pit_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = team_facts(matches(spark, sf_dir)).withColumn("alias", (F.col("team") % 10).cast("string"))
    rows = with_prior(facts, ["alias"], {}, maxima={"hi": F.col("team"), "lo_": -F.col("team")}).withColumn("lo", -F.col("lo_"))
    return rows.select("match_id", "side", "alias", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(-1).alias("resolved"), F.coalesce(F.col("lo") < F.col("hi"), F.lit(False)).cast("int").alias("ambiguous"))


@query(f"""WITH {MATCHES_SQL}, {TEAMS_SQL}, t AS (SELECT match_id, max(seen) AS team_ts FROM (SELECT match_id, max(ts) OVER (PARTITION BY team ORDER BY ts {PRIOR_SQL}) AS seen FROM tf) GROUP BY match_id),
l AS (SELECT match_id, ts, max(ts) OVER (PARTITION BY league ORDER BY ts {PRIOR_SQL}) AS league_ts, max(ts) OVER (ORDER BY ts {PRIOR_SQL}) AS global_ts FROM m)
SELECT l.match_id, team_ts, league_ts, greatest(team_ts, league_ts, global_ts) AS history_max, CASE WHEN greatest(team_ts, league_ts, global_ts) >= ts THEN 1 ELSE 0 END AS leaks
FROM l JOIN t ON l.match_id = t.match_id""")
def pit_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matches(spark, sf_dir)
    seen = {"seen": F.col("ts")}
    teams = with_prior(team_facts(m), ["team"], {}, maxima=seen).groupBy("match_id").agg(F.max("seen").alias("team_ts"))
    leagues = with_prior(m, ["league"], {}, maxima={"league_ts": F.col("ts")})
    everything = prior_table(m, [], {}, maxima={"global_ts": F.col("ts")})
    newest = F.greatest("team_ts", "league_ts", "global_ts")
    rows = leagues.join(teams, "match_id").join(everything, "ts")
    return rows.select("match_id", "team_ts", "league_ts", newest.alias("history_max"), F.coalesce(newest >= F.col("ts"), F.lit(False)).cast("int").alias("leaks"))


@query(f"""WITH {MATCHES_SQL}, {PICKS_SQL} SELECT p.match_id, p.side, p.role, coalesce(arg_max(f.win, (f.ts, f.match_id, f.side, f.role)), -1) AS last_win, max(f.ts) AS last_ts
FROM pk p LEFT JOIN pk f ON f.player = p.player AND f.ts < p.ts GROUP BY ALL""")
def asof_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    pk = picks(spark, sf_dir)
    rows = with_prior(pk, ["player"], {}, last={"last_win": F.col("win")}, maxima={"last_ts": F.col("ts")}, order=F.struct("match_id", "side", "role"))
    return rows.select("match_id", "side", "role", F.coalesce("last_win", F.lit(-1)).alias("last_win"), "last_ts")


@query(f"""WITH {MATCHES_SQL}, {PICKS_SQL} SELECT match_id, CAST(sum(CASE WHEN g = 0 THEN 1 ELSE 0 END) AS BIGINT) AS unseen_players FROM
  (SELECT match_id, count(*) OVER (PARTITION BY player ORDER BY ts {PRIOR_SQL}) AS g FROM pk) GROUP BY match_id""")
def unknown_entities_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    pk = picks(spark, sf_dir)
    first = pk.groupBy("player").agg(F.min("ts").alias("first_ts"))
    unseen = pk.join(first, (pk.player == first.player) & (pk.ts > first.first_ts), "left_anti").groupBy("match_id").agg(F.count(F.lit(1)).alias("n"))
    return pk.select("match_id").distinct().join(unseen, "match_id", "left").select("match_id", F.coalesce("n", F.lit(0)).alias("unseen_players"))


@query(f"""WITH {MATCHES_SQL} SELECT match_id, CAST(year(ts) AS INTEGER) AS patch_major, CAST(month(ts) AS INTEGER) AS patch_minor, 1 + match_id % 5 AS game_number,
  round((match_id % 5) / 4.0, 10) AS series_game_progress, coalesce(tier, '<none>') || chr(31) || league AS context FROM m""")
def static_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matches(spark, sf_dir)
    game = 1 + F.col("match_id") % 5
    return m.select("match_id", F.year("ts").alias("patch_major"), F.month("ts").alias("patch_minor"), game.alias("game_number"), F.round((game - 1) / 4.0, 10).alias("series_game_progress"), F.concat_ws("\u001f", F.coalesce("tier", F.lit("<none>")), "league").alias("context"))


@query(f"""WITH {MATCHES_SQL}, {PICKS_SQL}, b AS (SELECT match_id, side, list(champion ORDER BY role) AS c, list(CAST(player AS VARCHAR) ORDER BY role) AS p FROM pk GROUP BY ALL)
SELECT match_id, side, coalesce(c[1], '<none>') AS slot_1, coalesce(c[2], '<none>') AS slot_2, coalesce(c[4], '<none>') AS slot_4, coalesce(p[1], '<none>') || chr(31) || coalesce(c[1], '<none>') AS pair_1 FROM b""")
def model_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = picks(spark, sf_dir).groupBy("match_id", "side").agg(F.transform(F.array_sort(F.collect_list(F.struct("role", "champion", "player"))), lambda x: F.struct(x["champion"].alias("c"), x["player"].cast("string").alias("p"))).alias("s"))

    def slot(n: int, field: str):
        return F.coalesce(F.try_element_at("s", F.lit(n))[field], F.lit("<none>"))

    return rows.select("match_id", "side", slot(1, "c").alias("slot_1"), slot(2, "c").alias("slot_2"), slot(4, "c").alias("slot_4"), F.concat_ws("\u001f", slot(1, "p"), slot(1, "c")).alias("pair_1"))
