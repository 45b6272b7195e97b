"""Secret scans with an incremental ledger of blobs.

Every historical version of a text is addressed by the SHA-256 of its bytes. The ledger holds which rule
versions have seen which blob and what they found there. A scan visits each unseen pair of blob and rule
version once, however many paths hold the blob, and findings are joined back to all paths. All of it
is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from priorline.llm.common import durable, whole


@dataclass(frozen=True)
class Rule:
    """One kind of secret. A match counts if the given group has at least so many characters."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: The contract's kinds, in its order. Where a run that is too short is simply dropped, the length stands in the pattern.
BASE_RULES = (
    Rule("assign", 1, "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", 1, "AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, "[0-9a-f]{24,}"),
)
#: What the ledger's rule set adds to them.
MORE_RULES = (
    Rule("key_block", 1, "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("web_token", 1, "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", 1, "[a-z][a-z0-9+.-]{1,20}://[^\\x20\\x09-\\x0D/:@]{1,64}:[^\\x20\\x09-\\x0D/@]{3,128}@"),
)
SPANS = "array<struct<start:int,kind_at:int,stop:int,kind:string,rule:string>>"


def find(text: Column, rule: Rule, at: int) -> Column:
    """The rule's spans in code points: matches and the pieces between them, laid end to end."""
    hits = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    pieces = F.split(text, rule.pattern, -1)
    none = F.lit(None).cast(SPANS)
    empty = F.coalesce(none, F.array().cast(SPANS))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["piece"])
        stop = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        found = F.struct(start.alias("start"), F.lit(at).alias("kind_at"), stop.alias("stop"), F.lit(rule.kind).alias("kind"), F.lit(rule.name).alias("rule"))
        fits = F.length(F.regexp_extract(x["hit"], rule.pattern, rule.group)) >= rule.least if rule.group else F.lit(True)
        more = F.when(x["hit"].isNotNull() & fits, F.concat(acc["found"], F.array(found).cast(SPANS))).otherwise(acc["found"])
        return F.struct(stop.alias("at"), more.alias("found"))

    state = F.struct(F.lit(0).alias("at"), empty.alias("found"))
    walked = F.aggregate(F.arrays_zip(pieces.alias("piece"), hits.alias("hit")), state, step, lambda acc: acc["found"])
    return F.when(text.rlike(rule.pattern), walked).otherwise(empty)


def scan(versions: DataFrame, rules: Sequence[Rule], ledger: DataFrame | None = None, path: str = "doc_id", text: str = "text") -> DataFrame:
    """New ledger rows (blob, rules, spans): the blobs with unseen rule versions, scanned by those rules only.

    `ledger` holds earlier results of this function. Each unseen blob is read once: by the row that stands
    first among those that hold it.
    """
    names = F.array(*[F.lit(r.name) for r in rules])
    blobs = versions.select(F.col(path).alias("path"), F.sha2(whole(text).cast("binary"), 256).alias("blob"))
    first = blobs.groupBy("blob").agg(F.min(F.struct("path")).alias("holder")).select("blob", F.col("holder.path").alias("path"))
    if ledger is None:
        due = first.withColumn("due", names)
    else:
        seen = ledger.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        due = first.join(seen, "blob", "left").withColumn("due", F.array_except(names, F.coalesce("seen", F.array().cast("array<string>")))).drop("seen").filter(F.size("due") > 0)
    bodies = versions.select(F.col(path).alias("_path"), whole(text).alias("body"))
    held = bodies.join(due.hint("shuffle_hash"), F.col("_path").eqNullSafe(F.col("path"))).filter(F.sha2(F.col("body").cast("binary"), 256) == F.col("blob"))
    parts = [F.when(F.array_contains("due", r.name), find(F.col("body"), r, i)).otherwise(F.array().cast(SPANS)) for i, r in enumerate(rules)]
    found = held.select("blob", F.col("due").alias("rules"), F.array_sort(F.concat(*parts)).alias("spans"))
    return found


def append_ledger(fresh: DataFrame, folder: str) -> None:
    """Adds new ledger rows to the stored ones."""
    fresh.write.mode("append").parquet(folder)


def load_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The stored ledger, all runs' rows."""
    return spark.read.schema(f"blob string, rules array<string>, spans {SPANS}").parquet(folder)


def findings(versions: DataFrame, ledger: DataFrame, rules: Sequence[Rule], path: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of versions with what these rules' versions found in its blob by the ledger: (path, blob, spans).

    What earlier versions of a rule found stays in the ledger and out of the result.
    """
    present = [r.name for r in rules]
    ledger = ledger.withColumn("spans", F.filter("spans", lambda s: s["rule"].isin(present)))
    rows = versions.select(F.col(path).alias(path), F.sha2(whole(text).cast("binary"), 256).alias("blob"))
    hits = ledger.filter(F.size("spans") > 0).groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))
    return rows.join(hits, "blob", "left").select(path, "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda span: span["kind"] == kind


def digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def scan_documents(docs: DataFrame, rules: Sequence[Rule] = BASE_RULES + MORE_RULES, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(a row for each document, the ledger with the new rows).

    Defined cases: a null text is the empty blob; a null or repeated doc_id is a path like any other, so
    equal rows give equal rows; other columns are ignored; an empty table gives no rows. The scanned
    ledger rows are cut off durably, so that a lost executor doesn't scan again.
    """
    fresh = durable(scan(docs, rules, ledger))
    known = fresh if ledger is None else ledger.unionByName(fresh)
    rows = findings(docs, known, rules)
    kinds = [r.kind for r in BASE_RULES]
    base = F.filter("spans", lambda s: s["kind"].isin(kinds))
    counted = [F.size(F.filter("spans", _is(k))).cast("long").alias(f"n_{k}") for k in kinds]
    return rows.select("doc_id", *counted, F.sha2(digest(base).cast("binary"), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"), "blob"), known
