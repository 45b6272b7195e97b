"""Rendezvous sharding: every record goes to the shard that scores best for its key.

A shard's score depends on the key and that shard alone, so a new shard only wins records and no
record moves between two old shards. All of it is DataFrame functions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priorline.llm.common import packed, whole, without

#: Rows that one sorted cell of a shard should hold at most, on average.
CELL_ROWS = 20_000


def _best(key: Column, weights: Sequence[float]) -> Column:
    """The shard with the smallest -ln(u)/weight, u being a hash of key and shard in (0, 1)."""
    scores = []
    for shard, weight in enumerate(weights):
        u = (F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{shard}"))), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
        scores.append(F.struct((-F.log(u) / float(weight)).alias("score"), F.lit(shard).alias("shard")))
    return F.array_min(F.array(*scores))["shard"]


def shard_rows(docs: DataFrame, shards: int = 24, weights: Sequence[float] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds size, text_crc32, law, shard, slot and grown_shard to every row.

    Defined cases: a null key is a key of its own; rows with one key share a shard; a null text counts
    as empty; an empty table gives no rows; columns of these names in any case are replaced. Slots run
    from 0 without gaps within a shard, in the order of a hash of the key, and are numbered by cells of that
    hash: only cell counts are summed along a shard, so that no task sorts a whole shard. `weights` holds
    a relative capacity for each shard; the shard added for grown_shard gets the mean capacity.
    """
    weights = list(weights or [1.0] * shards)
    if len(weights) != shards or min(weights) <= 0:
        raise ValueError("one positive weight for each shard is needed")
    taken = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    docs = without(docs, taken)
    rows = docs.count()
    digits = max(1, math.ceil(math.log(max(rows / (shards * CELL_ROWS), 1), 16)) + 1)
    body = whole(F.col(text).cast("string"))
    named = (
        docs.select(packed(docs), F.coalesce(F.col(key).cast("string"), F.lit("\x00")).alias("_key"), body.alias("_text"))
        .withColumn("_hash", F.md5("_key"))
        .withColumn("_cell", F.substring("_hash", 1, digits))
        .withColumn("size", F.octet_length("_text").cast("long") + 8)
        .withColumn("text_crc32", F.crc32(F.col("_text").cast("binary")))
        .drop("_text")
        .withColumn("law", F.lit("key"))
        .withColumn("shard", _best(F.col("_key"), weights))
        .withColumn("grown_shard", _best(F.col("_key"), [*weights, sum(weights) / shards]))
    )
    cells = named.groupBy("shard", "_cell").agg(F.count(F.lit(1)).alias("_rows"))
    along = Window.partitionBy("shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select("shard", "_cell", F.coalesce(F.sum("_rows").over(along), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("shard", "_cell").orderBy("_hash", "_key", "text_crc32", "size")
    placed = named.withColumn("_rank", F.row_number().over(inside)).join(offsets, ["shard", "_cell"])
    return placed.withColumn("slot", F.col("_before") + F.col("_rank") - 1).select("_row.*", *taken)
