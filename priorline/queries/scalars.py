"""Scalar functions of the boundary: cleaning, parsing, identities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priorline.contest import MATCHES_SQL, matches
from priorline.functions import text as T
from priorline.registry import query
from priorline.session import table


@query("SELECT c_custkey, CASE WHEN trim(substr(c_name, 1, c_custkey % 12)) = '' THEN '<null>' ELSE trim(substr(c_name, 1, c_custkey % 12)) END AS cleaned FROM customer")
def str_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = F.expr("substr(c_name, 1, cast(c_custkey % 12 as int))")
    return table(spark, sf_dir, "customer").select("c_custkey", F.coalesce(T.cleaned(cut), F.lit("<null>")).alias("cleaned"))


@query("SELECT p_partkey, lower(regexp_replace(trim('  ' || p_name || '   x '), '\\s+', ' ', 'g')) AS identity FROM part")
def identity_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.identity_text(F.concat(F.lit("  "), "p_name", F.lit("   x "))).alias("identity"))


@query("SELECT p_partkey, regexp_replace(lower(p_name || '-' || p_brand), '[^a-z0-9]', '', 'g') AS alias FROM part")
def identity_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.identity_alias(F.concat_ws("-", "p_name", "p_brand")).alias("alias"))


@query("SELECT c_custkey, 'id_' || substr(sha256(lower(c_name)), 1, 24) AS stable_id FROM customer")
def stable_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", T.stable_id("id_", F.lower("c_name")).alias("stable_id"))


@query(f"""WITH {MATCHES_SQL}, r AS (SELECT match_id, CASE match_id % 3 WHEN 0 THEN 'v' || year(ts) % 100 || '.0' || month(ts) WHEN 1 THEN year(ts) % 100 || '.' || month(ts) || 'b' ELSE year(ts) % 100 || '.S1.0' || month(ts) END AS raw FROM m)
SELECT match_id, raw, CASE match_id % 3 WHEN 2 THEN CAST(regexp_extract(raw, '^(\\d+)', 1) AS INTEGER) || '.S1.' || CAST(regexp_extract(raw, '(\\d+)$', 1) AS INTEGER)
  ELSE CAST(regexp_extract(raw, '(\\d+)\\.', 1) AS INTEGER) || '.' || CAST(regexp_extract(raw, '\\.(\\d+)', 1) AS INTEGER) END AS patch FROM r""")
def patch_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    year, month = (F.year("ts") % 100).cast("string"), F.month("ts").cast("string")
    raw = F.when(F.col("match_id") % 3 == 0, F.concat(F.lit("v"), year, F.lit(".0"), month)).when(F.col("match_id") % 3 == 1, F.concat(year, F.lit("."), month, F.lit("b"))).otherwise(F.concat(year, F.lit(".S1.0"), month))
    return matches(spark, sf_dir).select("match_id", raw.alias("raw"), T.patch(raw).alias("patch"))


@query(f"""WITH {MATCHES_SQL} SELECT match_id, CASE WHEN match_id % 4 = 3 THEN NULL ELSE ts END AS parsed FROM m""")
def parse_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = ["yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd", "dd.MM.yyyy HH:mm"]
    raw = F.when(F.col("match_id") % 4 == 3, F.lit("soon"))
    for k, form in enumerate(forms):
        raw = raw.when(F.col("match_id") % 4 == k, F.date_format("ts", form))
    return matches(spark, sf_dir).select("match_id", T.timestamp(raw, forms).cast("timestamp_ntz").alias("parsed"))


@query("SELECT l_orderkey, l_linenumber, l_returnflag, CASE l_returnflag WHEN 'R' THEN 'true' WHEN 'A' THEN 'false' ELSE 'unknown' END AS flag FROM lineitem")
def parse_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.element_at(F.create_map(F.lit("R"), F.lit(" Yes "), F.lit("A"), F.lit("0"), F.lit("N"), F.lit("maybe")), F.col("l_returnflag"))
    flag = T.tri_state(word)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.when(flag, "true").when(~flag, "false").otherwise("unknown").alias("flag"))


@query("SELECT c_custkey, array_to_string(list_filter([c_name, 'None', c_mktsegment, 'Missing Data', ''], lambda x: x NOT IN ('None', 'Missing Data', 'null', '')), '|') AS kept FROM customer")
def array_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.array("c_name", F.lit("None"), "c_mktsegment", F.lit("Missing Data"), F.lit(""))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(T.without_sentinels(raw), "|").alias("kept"))


@query("""SELECT l_orderkey, l_linenumber, round(ln(1 + l_quantity), 9) AS log1p, round(pow(0.5, l_quantity / 50), 9) AS halved, round(1 / (1 + exp(-(l_quantity - 25) / 10)), 9) AS sigmoid,
  round(greatest(0.000001, least(0.999999, l_discount * 12)), 9) AS clipped, round(sqrt(l_extendedprice), 6) AS root FROM lineitem""")
def math_fns(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(F.log1p(q), 9).alias("log1p"), F.round(F.pow(F.lit(0.5), q / 50), 9).alias("halved"), F.round(T.sigmoid((q - 25) / 10), 9).alias("sigmoid"),
        F.round(T.clip_probability(F.col("l_discount") * 12), 9).alias("clipped"), F.round(F.sqrt("l_extendedprice"), 6).alias("root"),
    )


@query("SELECT l_orderkey, l_linenumber, CAST(round_even(l_extendedprice / 64.0, 0) AS BIGINT) AS pixel FROM lineitem")
def bankers_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.bround(F.col("l_extendedprice") / 64.0, 0).cast("long").alias("pixel"))


@query("""SELECT c_custkey, sha256('{"id":' || c_custkey || ',"nation":' || c_nationkey || ',"segment":"' || c_mktsegment || '"}') AS hash FROM customer""")
def config_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SHA-256 of a row's canonical JSON: keys in order, no spaces."""
    row = F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")))
    return table(spark, sf_dir, "customer").select("c_custkey", F.sha2(row, 256).alias("hash"))


@query("""SELECT CAST(c_nationkey AS VARCHAR) AS k, arg_max(c_name, c_custkey) AS v FROM customer GROUP BY c_nationkey""")
def kv_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key-value table after all upserts in order: each key's last value."""
    from priorline.operators.storage import upserted

    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("k"), F.col("c_name").alias("v"), F.col("c_custkey").alias("at"))
    return upserted(rows, "k", "at").select("k", "v")


@query("SELECT event_id, round(greatest(0.000001, least(0.999999, value / 100)), 9) AS p FROM events WHERE isfinite(value)")
def clip_prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter(T.finite(F.col("value"))).select("event_id", F.round(T.clip_probability(F.col("value") / 100), 9).alias("p"))


@query("SELECT doc_id, substr(regexp_replace(text, '(password|token)\\s*=\\s*\\S+', '\\1=<redacted>', 'g'), 1, 4000) AS redacted FROM documents")
def redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.redacted(F.col("text")).alias("redacted"))


@query(f"WITH {MATCHES_SQL} SELECT match_id, strftime(ts, '%Y-%m') AS month, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS iso FROM m")
def month_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark, sf_dir).select("match_id", F.date_format("ts", "yyyy-MM").alias("month"), T.iso(F.col("ts")).alias("iso"))


@query("SELECT c_custkey, concat_ws(' ', c_mktsegment, CASE WHEN c_custkey % 2 = 0 THEN c_name END, CASE WHEN c_custkey % 3 = 0 THEN 'Playoffs' END) AS tournament FROM customer")
def concat_optional(spark: SparkSession, sf_dir: str) -> DataFrame:
    even, third = F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")), F.when(F.col("c_custkey") % 3 == 0, F.lit("Playoffs"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat_ws(" ", "c_mktsegment", even, third).alias("tournament"))


@query("SELECT l_orderkey, count(*) AS n, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS flags FROM lineitem GROUP BY l_orderkey")
def json_array_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.to_json(F.array_sort(F.collect_set("l_returnflag"))).alias("j"))
    return rows.select("l_orderkey", "n", F.array_join(F.from_json("j", "array<string>"), ",").alias("flags"))
