"""Scans, joins, aggregations, order and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from priorline.contest import MATCHES_SQL, PICKS_SQL, matches, picks
from priorline.operators.asof import smoothed
from priorline.queries.pit import role_matchups, team_pairs
from priorline.registry import query
from priorline.session import table

_CUTOFF = "1996-01-01"


@query(f"SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_orderdate < TIMESTAMP '{_CUTOFF}' ORDER BY o_orderdate, o_orderkey")
def scan_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").filter(F.col("o_orderdate") < F.lit(_CUTOFF).cast("timestamp_ntz"))
    return rows.select("o_orderkey", "o_orderdate", "o_totalprice").orderBy("o_orderdate", "o_orderkey")


@query(f"WITH {MATCHES_SQL} SELECT match_id, ts, blue, red FROM m WHERE ts < TIMESTAMP '{_CUTOFF}'")
def scan_features_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark, sf_dir).filter(F.col("ts") < F.lit(_CUTOFF).cast("timestamp_ntz")).select("match_id", "ts", "blue", "red")


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey")
def order_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").orderBy("o_orderdate", "o_orderkey")


@query("SELECT count(*) AS offered, count(*) FILTER (dup) AS clashing, count(*) FILTER (NOT dup) AS fresh FROM (SELECT l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0) AS dup FROM lineitem)")
def append_pk_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    offered = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"))
    stored = table(spark, sf_dir, "orders").filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("k"), F.lit(True).alias("dup"))
    return offered.join(stored, "k", "left").agg(F.count(F.lit(1)).alias("offered"), F.count("dup").alias("clashing"), F.count_if(F.col("dup").isNull()).alias("fresh"))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1995-07-01'")
def interval_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("o_orderdate")
    start, end = (F.lit(x).cast("timestamp_ntz") for x in ("1995-01-01", "1995-07-01"))
    return table(spark, sf_dir, "orders").filter((ts >= start) & (ts < end)).select("o_orderkey", "o_orderdate")


@query("SELECT o_orderkey, c_name, n_name, coalesce(r_name, '<none>') AS r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0 LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def join_left_3way(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, n, r = (table(spark, sf_dir, t) for t in ("orders", "nation", "region"))
    c = table(spark, sf_dir, "customer").filter("c_acctbal > 0")
    # The nation and region tables hold 25 and 5 rows at any scale; Spark broadcasts them by their size.
    places = n.join(r, n.n_regionkey == r.r_regionkey, "left")
    rows = o.join(c, o.o_custkey == c.c_custkey, "left").join(places, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return rows.select("o_orderkey", "c_name", "n_name", F.coalesce("r_name", F.lit("<none>")).alias("r_name"))


@query("SELECT count(*) AS n, min(o_orderdate) AS first_ts, max(o_orderdate) AS last_ts FROM orders")
def db_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderdate").alias("first_ts"), F.max("o_orderdate").alias("last_ts"))


@query("SELECT count(*) AS n, count(DISTINCT o_orderdate) AS n_times, strftime(min(o_orderdate), '%Y-%m-%d') AS first_day, strftime(max(o_orderdate), '%Y-%m-%d') AS last_day FROM orders")
def frame_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(ts).alias("n_times"), F.date_format(F.min(ts), "yyyy-MM-dd").alias("first_day"), F.date_format(F.max(ts), "yyyy-MM-dd").alias("last_day"))


@query(f"WITH {MATCHES_SQL} SELECT league, CAST(sum(blue_win) AS BIGINT) AS wins, count(*) AS games FROM m GROUP BY league")
def entity_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark, sf_dir).groupBy("league").agg(F.sum("blue_win").alias("wins"), F.count(F.lit(1)).alias("games"))


@query(f"WITH {MATCHES_SQL} SELECT blue, round((sum(blue_win) + 0.5 * 6) / (count(*) + 6.0), 10) AS rate FROM m GROUP BY blue")
def smoothed_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matches(spark, sf_dir).groupBy("blue").agg(F.sum("blue_win").alias("w"), F.count(F.lit(1)).alias("n"))
    return rows.select("blue", F.round(smoothed(F.col("w"), F.col("n"), 0.5, 6.0), 10).alias("rate"))


@query(f"WITH {MATCHES_SQL}, {PICKS_SQL} SELECT match_id, side, round(avg(player), 9) AS mean_player, count(*) AS n FROM pk GROUP BY match_id, side")
def roster_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrays = picks(spark, sf_dir).groupBy("match_id", "side").agg(F.collect_list("player").alias("p"))
    total = F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x)
    return arrays.select("match_id", "side", F.round(total / F.size("p"), 9).alias("mean_player"), F.size("p").cast("long").alias("n"))


@query(f"WITH {MATCHES_SQL}, {PICKS_SQL} SELECT match_id, min(player) AS least_player, round(avg(CASE WHEN player > 10 THEN 1.0 ELSE 0.0 END), 9) AS known FROM pk GROUP BY match_id")
def roster_min_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return picks(spark, sf_dir).groupBy("match_id").agg(F.min("player").alias("least_player"), F.round(F.avg((F.col("player") > 10).cast("double")), 9).alias("known"))


@query("SELECT l_orderkey, max(greatest(l_shipdate, CASE WHEN l_returnflag = 'R' THEN o_orderdate + INTERVAL 200 DAY END)) AS newest FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey")
def provenance_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    later = F.when(F.col("l_returnflag") == "R", F.col("o_orderdate") + F.expr("INTERVAL 200 DAYS"))
    return rows.groupBy("l_orderkey").agg(F.max(F.greatest("l_shipdate", later)).alias("newest"))


@query("SELECT count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderdate) AS days FROM orders")
def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").agg(F.countDistinct("o_custkey").alias("customers"), F.countDistinct("o_orderdate").alias("days"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY event_type")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).orderBy("event_type")


@query("""SELECT source, round(count(quality) / count(*), 9) AS covered, round(coalesce(count(*) FILTER (quality = 1) / nullif(count(quality), 0), -1), 9) AS good
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY source""")
def coverage_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    good = F.try_divide(F.count_if(F.col("quality") == 1), F.count("quality"))
    return rows.groupBy("source").agg(F.round(F.count("quality") / F.count(F.lit(1)), 9).alias("covered"), F.round(F.coalesce(good, F.lit(-1.0)), 9).alias("good"))


@query("SELECT l_returnflag, round(median(l_quantity), 9) AS median, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS sd FROM lineitem GROUP BY l_returnflag")
def scaling_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.percentile(q, F.lit(0.5)), 9).alias("median"), F.round(F.avg(q), 6).alias("mean"), F.round(F.stddev_pop(q), 6).alias("sd"))


@query("SELECT l_orderkey, l_suppkey AS key, round(sum(CASE WHEN l_linenumber % 2 = 0 THEN 0.5 ELSE -0.5 END * l_quantity), 9) AS coef FROM lineitem GROUP BY ALL HAVING abs(sum(CASE WHEN l_linenumber % 2 = 0 THEN 0.5 ELSE -0.5 END * l_quantity)) > 1e-15")
def design_accumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    sign = F.when(F.col("l_linenumber") % 2 == 0, 0.5).otherwise(-0.5)
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_suppkey").alias("key")).agg(F.sum(sign * F.col("l_quantity")).alias("coef"))
    return rows.filter(F.abs("coef") > 1e-15).select("l_orderkey", "key", F.round("coef", 9).alias("coef"))


@query("SELECT l_orderkey, l_returnflag AS kind, round(sum(l_quantity * l_discount), 9) AS part FROM lineitem GROUP BY ALL")
def kind_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_returnflag").alias("kind")).agg(F.round(F.sum(F.col("l_quantity") * F.col("l_discount")), 9).alias("part"))


@query(f"WITH {MATCHES_SQL}, {PICKS_SQL} SELECT match_id, side, i - 1 AS slot, p[i] AS player, c[i] AS champion FROM (SELECT match_id, side, p, c, unnest(range(1, len(p) + 1)) AS i FROM (SELECT match_id, side, list(player ORDER BY role) AS p, list(champion ORDER BY role) AS c FROM pk GROUP BY ALL))")
def roster_zip_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = picks(spark, sf_dir).groupBy("match_id", "side").agg(F.array_sort(F.collect_list(F.struct("role", "player", "champion"))).alias("s"))
    zipped = sides.select("match_id", "side", F.posexplode(F.arrays_zip(F.col("s.player").alias("player"), F.col("s.champion").alias("champion"))).alias("slot", "z"))
    return zipped.select("match_id", "side", F.col("slot").cast("long").alias("slot"), "z.player", "z.champion")


@query(f"WITH {MATCHES_SQL}, {PICKS_SQL} SELECT x.match_id, x.side, least(x.champion, y.champion) AS a, greatest(x.champion, y.champion) AS b FROM pk x JOIN pk y ON x.match_id = y.match_id AND x.side = y.side AND x.role < y.role")
def pair_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return team_pairs(picks(spark, sf_dir).withColumn("base", F.lit(0.5))).select("match_id", "side", "a", "b")


@query(f"WITH {MATCHES_SQL}, {PICKS_SQL} SELECT x.match_id, x.side, x.role, x.champion AS a, y.champion AS b, x.win FROM pk x JOIN pk y ON x.match_id = y.match_id AND x.role = y.role AND x.side <> y.side")
def role_matchup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return role_matchups(picks(spark, sf_dir)).select("match_id", "side", "role", "a", "b", "win")


@query("""WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 100 = 0), t AS (SELECT vec_id, label, embedding FROM embeddings),
s AS (SELECT q.vec_id, t.label, max(greatest(0, least(1, 1 - list_sum(list_transform(range(1, 65), lambda i: abs(q.embedding[i]::DOUBLE - t.embedding[i]::DOUBLE))) / 64))) AS score FROM q, t GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS k FROM s)
SELECT vec_id, max(label) FILTER (k = 1) AS label, round(max(score) FILTER (k = 1), 6) AS best, round(max(score) FILTER (k = 1) - max(score) FILTER (k = 2), 6) AS margin FROM r WHERE k <= 2 GROUP BY vec_id""")
def nearest_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    from priorline.operators.similarity import nearest

    e = table(spark, sf_dir, "embeddings")
    found = nearest(e.filter("vec_id % 100 = 0").select("vec_id", "embedding"), e.select("label", "embedding"))
    return found.select("vec_id", "label", F.round("best", 6).alias("best"), F.round("margin", 6).alias("margin"))


@query("SELECT a.vec_id, round(greatest(0, least(1, 1 - list_sum(list_transform(range(1, 65), lambda i: abs(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE))) / 64)), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = 0")
def l1_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from priorline.operators.similarity import l1_similarity as score

    e = table(spark, sf_dir, "embeddings")
    first = e.filter("vec_id = 0").select(F.col("embedding").alias("other"), F.lit(0).alias("one"))
    rows = e.withColumn("one", F.lit(0)).join(first, "one")
    return rows.select("vec_id", F.round(score(F.col("embedding"), F.col("other")), 6).alias("similarity"))


@query("SELECT l_orderkey, round(max(l_extendedprice) FILTER (k = 1), 6) AS first, round(coalesce(max(l_extendedprice) FILTER (k = 1) - max(l_extendedprice) FILTER (k = 2), -1), 6) AS margin FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC) AS k FROM lineitem) WHERE k <= 2 GROUP BY l_orderkey")
def top2_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy(F.col("l_extendedprice").desc())
    ranked = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", F.row_number().over(w).alias("k")).filter("k <= 2")
    first, second = (F.max(F.when(F.col("k") == i, F.col("l_extendedprice"))) for i in (1, 2))
    return ranked.groupBy("l_orderkey").agg(F.round(first, 6).alias("first"), F.round(F.coalesce(first - second, F.lit(-1.0)), 6).alias("margin"))


@query("SELECT s_nationkey, arg_min(s_name, (s_acctbal, s_suppkey)) AS chosen FROM supplier GROUP BY s_nationkey")
def argmin_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.min_by("s_name", F.struct("s_acctbal", "s_suppkey")).alias("chosen"))


@query("SELECT p_brand, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS k FROM part) WHERE k = 1")
def best_per_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = F.min(F.struct("p_retailprice", "p_partkey")).alias("b")
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(best).select("p_brand", "b.p_partkey", "b.p_retailprice")


@query("SELECT o_orderkey, 'early' AS fold FROM orders WHERE o_orderdate < TIMESTAMP '1995-01-01' UNION ALL SELECT o_orderkey, 'late' AS fold FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'")
def union_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    at = {k: F.lit(k).cast("timestamp_ntz") for k in ("1995-01-01", "1997-01-01")}
    early = o.filter(F.col("o_orderdate") < at["1995-01-01"]).select("o_orderkey", F.lit("early").alias("fold"))
    return early.unionByName(o.filter(F.col("o_orderdate") >= at["1997-01-01"]).select("o_orderkey", F.lit("late").alias("fold")))


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey").subtract(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")))


@query("""SELECT l_orderkey, len(list_intersect(a, b)) AS shared, CASE WHEN len(list_intersect(a, b)) > 0 THEN 1 ELSE 0 END AS overlap FROM
  (SELECT l_orderkey, list(DISTINCT l_suppkey) FILTER (l_linenumber <= 3) AS a, list(DISTINCT l_suppkey) FILTER (l_linenumber > 3) AS b FROM lineitem GROUP BY l_orderkey) WHERE a IS NOT NULL AND b IS NOT NULL""")
def array_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.col("l_linenumber") <= 3
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when(low, F.col("l_suppkey"))).alias("a"), F.collect_set(F.when(~low, F.col("l_suppkey"))).alias("b"))
    shared = F.size(F.array_intersect("a", "b"))
    return rows.filter((F.size("a") > 0) & (F.size("b") > 0)).select("l_orderkey", shared.cast("long").alias("shared"), F.arrays_overlap("a", "b").cast("int").alias("overlap"))


@query("SELECT DISTINCT p_partkey AS spec FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def pending_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("spec"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("spec")).distinct().join(done, "spec", "left_anti")


@query("SELECT o_custkey, count(DISTINCT o_orderpriority) AS parts FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) > 1")
def group_leak_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.countDistinct("o_orderpriority").alias("parts")).filter("parts > 1")


@query("SELECT lang, source, count(*) AS n, round(avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END), 9) AS precision, round(avg(CASE WHEN toxic IS NULL THEN 1.0 ELSE 0.0 END), 9) AS abstained FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY lang, source")
def corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    good = F.coalesce(F.col("quality") == 1, F.lit(False)).cast("double")
    return rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(good), 9).alias("precision"), F.round(F.avg(F.col("toxic").isNull().cast("double")), 9).alias("abstained"))


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 5 = 0 THEN 'fixed' END, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END, '<none>') AS value, CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 3 <> 0 THEN 'status' ELSE '' END AS missing FROM orders")
def confirm_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    correction, parsed = F.when(F.col("o_orderkey") % 5 == 0, F.lit("fixed")), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus"))
    value = F.coalesce(correction, parsed)
    missing = F.array_join(F.array_compact(F.array(F.when(value.isNull(), F.lit("status")))), ",")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(value, F.lit("<none>")).alias("value"), missing.alias("missing"))
