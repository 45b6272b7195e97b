"""The corpus pipeline: quality rules, near-duplicates, benchmark leaks, mixing, sharding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from priorline.llm import leaks, mixing, quality, sharding, simhash
from priorline.llm.common import documents, durable, keep, with_body

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep; null texts go, repeated rows are judged alike, an empty table gives no rows."""
    judged = quality.judge(with_body(docs), carry=("doc_id", "body"))
    return keep(docs.select(*COLUMNS), judged.filter("kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: the smallest doc_id's, null last, and of equal ids any one text's.

    Defined cases: null and wordless texts form one group; of equal rows one stays; an empty table gives no rows.
    """
    placed = simhash.near_duplicates(with_body(docs), carry=("doc_id", "body"))
    named = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "body")
    rows = placed.groupBy("component", "doc_id", "body").agg(F.count(F.lit(1)).alias("n"))
    chosen = durable(rows.groupBy("component").agg(F.min(named).alias("r"), F.min_by("n", named).alias("n")).select("r.doc_id", "r.body", "n"))
    docs = docs.select(*COLUMNS)
    if chosen.filter("n > 1").isEmpty():
        return keep(docs, chosen)
    # Rows with one doc_id and one text can only be told apart by dealing them out.
    return keep(docs, chosen.filter("n = 1")).unionByName(keep(docs, chosen.filter("n > 1")).dropDuplicates(["doc_id", "text"]))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no test item; null texts hold none and stay, repeated rows go or stay together."""
    return leaks.without_leaks(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, each as often as it takes it; texts without words are never taken."""
    return mixing.take(mixing.mix(docs), COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row that is left, with its shard and its place there; copies of a row share a shard."""
    return sharding.shard_rows(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Perplexity bands, Hamming links and ranked retrieval have no SQL form over whole tables; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written to the shared checkpoint folder and read again."""
    docs = documents(spark, sf_dir)
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = durable(docs)
    return docs
