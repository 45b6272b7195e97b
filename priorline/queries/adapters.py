"""Boundary operators on the driver's tables: validation, quarantine, reshaping, series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priorline.contest import MATCHES_SQL, PICKS_SQL, matches, picks
from priorline.operators import quarantine as Q
from priorline.operators import series as S
from priorline.registry import query
from priorline.session import table

_REASON = """CASE WHEN l_quantity < 3 THEN 'missing_required_value' WHEN l_discount > 0.09 THEN 'invalid_binary_value' WHEN l_shipdate < o_orderdate THEN 'invalid_timestamp'
  WHEN l_linenumber > 6 THEN 'invalid_game_number' END"""
_LINES = f"WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity, l_partkey, {_REASON} AS reason FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))


def _checks() -> list[Q.Check]:
    return [
        ("missing_required_value", F.col("l_quantity") < 3), ("invalid_binary_value", F.col("l_discount") > 0.09),
        ("invalid_timestamp", F.col("l_shipdate") < F.col("o_orderdate")), ("invalid_game_number", F.col("l_linenumber") > 6),
    ]


@query(f"{_LINES} SELECT l_orderkey, l_linenumber, l_partkey, coalesce(reason, '<accepted>') AS reason FROM x")
def validate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.marked(_lines(spark, sf_dir), _checks()).select("l_orderkey", "l_linenumber", "l_partkey", F.coalesce("reason", F.lit("<accepted>")).alias("reason"))


@query(f"{_LINES} SELECT l_orderkey, reason FROM x WHERE reason IS NOT NULL")
def quarantine_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_shipdate", "o_orderdate")
    return Q.split(rows, _checks(), "l_orderkey")[1].select("l_orderkey", "reason")


@query(f"{_LINES} SELECT reason, count(*) AS n FROM x WHERE reason IS NOT NULL GROUP BY reason ORDER BY reason")
def quarantine_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.marked(_lines(spark, sf_dir), _checks()).filter("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n")).orderBy("reason")


@query("SELECT l_orderkey, l_linenumber, l_partkey, k > 1 AS duplicate FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k FROM lineitem)")
def dedupe_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Q.first_wins(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"])
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "duplicate")


@query(f"WITH {MATCHES_SQL} SELECT match_id, CASE WHEN match_id % 2 = 0 THEN red ELSE blue END AS left_team, CASE WHEN match_id % 2 = 0 THEN blue ELSE red END AS right_team, CASE WHEN match_id % 2 = 0 THEN 1 - blue_win ELSE blue_win END AS left_win FROM m")
def orient_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    flip = F.col("match_id") % 2 == 0

    def side(a, b):
        return F.when(flip, b).otherwise(a)

    return matches(spark, sf_dir).select("match_id", side(F.col("blue"), F.col("red")).alias("left_team"), side(F.col("red"), F.col("blue")).alias("right_team"), side(F.col("blue_win"), 1 - F.col("blue_win")).alias("left_win"))


_SLOTS = [(s, r) for s in (0, 1) for r in (0, 1, 2)]


@query(f"WITH {MATCHES_SQL}, {PICKS_SQL} SELECT match_id, " + ", ".join(f"coalesce(max(CASE WHEN side = {s} AND role = {r} THEN champion END), '<none>') AS s{s}_r{r}" for s, r in _SLOTS) + " FROM pk GROUP BY match_id")
def roster_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    pk = picks(spark, sf_dir)
    slots = [F.coalesce(F.max(F.when((F.col("side") == s) & (F.col("role") == r), F.col("champion"))), F.lit("<none>")).alias(f"s{s}_r{r}") for s, r in _SLOTS]
    return pk.groupBy("match_id").agg(*slots)


@query("SELECT l_orderkey, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN min(l_returnflag) ELSE '<several>' END AS flag, CAST(count(DISTINCT l_returnflag) AS INTEGER) AS n FROM lineitem GROUP BY l_orderkey")
def unique_value_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(Q.unique_value("l_returnflag").alias("u"))
    return rows.select("l_orderkey", F.coalesce("u.value", F.lit("<several>")).alias("flag"), F.col("u.n").alias("n"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'act' WHEN 'view' THEN 'see' ELSE event_type END AS role FROM events")
def alias_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.create_map(F.lit("click"), F.lit("act"), F.lit("view"), F.lit("see"))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.try_element_at(names, F.col("event_type")), F.col("event_type")).alias("role"))


@query("SELECT l_orderkey, CASE WHEN count(*) FILTER (l_returnflag = 'R') = 1 AND count(*) = 2 THEN 'complementary' ELSE 'inconsistent_result' END AS verdict FROM lineitem GROUP BY l_orderkey")
def complement_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits = (F.count_if(F.col("l_returnflag") == "R") == 1) & (F.count(F.lit(1)) == 2)
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.when(fits, "complementary").otherwise("inconsistent_result").alias("verdict"))


@query(f"WITH {MATCHES_SQL} SELECT match_id, league FROM m WHERE match_id % 2 = 1 AND tier IN ('1-URGENT', '2-HIGH')")
def population_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    official = F.when(F.col("match_id") % 2 == 1, True).when(F.col("match_id") % 4 == 0, False)
    return matches(spark, sf_dir).filter(official.eqNullSafe(True) & F.col("tier").isin("1-URGENT", "2-HIGH")).select("match_id", "league")


GROUPS = {"price": ["l_quantity", "l_extendedprice"], "terms": ["l_discount", "l_tax", "l_quantity"]}


@query("SELECT l_orderkey, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem")
def feature_group_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = list(dict.fromkeys(c for g in ("price", "terms") for c in GROUPS[g]))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", *names)


@query("SELECT count(*) AS n, count(*) FILTER (NOT isfinite(l_extendedprice)) AS not_finite, count(*) FILTER (l_shipdate <= o_orderdate) AS leaks FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def leakage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    from priorline.functions.text import finite

    return _lines(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.count_if(~finite(F.col("l_extendedprice"))).alias("not_finite"), F.count_if(F.col("l_shipdate") <= F.col("o_orderdate")).alias("leaks"))


@query("SELECT CAST(NULL AS BIGINT) AS l_orderkey, '' AS side WHERE FALSE")
def completeness_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_shipdate", "o_orderdate")
    accepted, rejected = Q.split(rows, _checks(), "l_orderkey")
    return Q.complete(rows, accepted, rejected, "l_orderkey")


@query("""SELECT o_orderkey, concat_ws(',', CASE WHEN c_custkey IS NULL THEN 'unknown_team' END, CASE WHEN n_name IS NULL THEN 'unknown_region' END, CASE WHEN o_totalprice > 300000 THEN 'rare_price' END) AS warnings
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 3 <> 0 LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey < 20""")
def prediction_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = o.join(c.filter("c_custkey % 3 <> 0"), o.o_custkey == c.c_custkey, "left").join(n.filter("n_nationkey < 20"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    kinds = [F.when(F.col("c_custkey").isNull(), "unknown_team"), F.when(F.col("n_name").isNull(), "unknown_region"), F.when(F.col("o_totalprice") > 300000, "rare_price")]
    return rows.select("o_orderkey", F.array_join(F.array_compact(F.array(*kinds)), ",").alias("warnings"))


@query(f"WITH {MATCHES_SQL}, t AS (SELECT series_id, match_id, ts, blue AS team, blue_win AS win FROM m) SELECT match_id, team, CAST(coalesce(sum(win) OVER (PARTITION BY series_id, team ORDER BY ts, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS wins_before FROM t")
def series_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matches(spark, sf_dir).select("series_id", "match_id", "ts", F.col("blue").alias("team"), F.col("blue_win").alias("win"))
    return S.score_before(rows, ["series_id"], "team", "win", ["ts", "match_id"]).select("match_id", "team", "wins_before")


@query("""WITH n AS (SELECT *, row_number() OVER w AS k, lag(l_shipdate) OVER w AS prev FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_partkey)),
s AS (SELECT l_orderkey, max(CASE WHEN k <> l_linenumber THEN 1 ELSE 0 END) AS bn, max(CASE WHEN prev >= l_shipdate THEN 1 ELSE 0 END) AS bt FROM n GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN bn = 1 THEN 'invalid_series_sequence' WHEN bt = 1 THEN 'invalid_series_timestamps' ELSE 'ok' END AS problem FROM s""")
def series_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.validated(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber", "l_shipdate", ["l_shipdate", "l_partkey"])
    return rows.groupBy("l_orderkey").agg(F.coalesce(F.max("problem"), F.lit("ok")).alias("problem"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CAST(coalesce(sum(CASE WHEN l_linenumber = 1 THEN 1 END) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice ROWS UNBOUNDED PRECEDING), 0) AS BIGINT) AS run FROM lineitem""")
def series_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.runs(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_linenumber", ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"])
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "run")


@query(f"WITH {MATCHES_SQL} SELECT match_id, 'series_' || substr(sha256(concat_ws('|', league, CAST(blue AS VARCHAR), CAST(red AS VARCHAR), strftime(ts, '%Y-%m-%d'))), 1, 24) AS series_hash FROM m")
def series_id_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = (F.col("league"), F.col("blue").cast("string"), F.col("red").cast("string"), F.date_format("ts", "yyyy-MM-dd"))
    return matches(spark, sf_dir).select("match_id", S.series_id("series_", *parts).alias("series_hash"))


@query()
def dataset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of all rows that doesn't depend on their order: rows' hashes added up in 128 bits."""
    rows = matches(spark, sf_dir)
    line = F.to_json(F.struct(*sorted(rows.columns)))
    parts = [F.sum(F.conv(F.substring(F.sha2(line.cast("binary"), 256), 1 + 12 * k, 12), 16, 10).cast("decimal(20,0)")).cast("string").alias(f"part_{k}") for k in range(4)]
    return rows.agg(F.count(F.lit(1)).alias("n"), *parts).select("n", F.sha2(F.concat_ws("|", *[f"part_{k}" for k in range(4)]).cast("binary"), 256).alias("fingerprint"))
