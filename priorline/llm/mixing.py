"""Mixing sources to target weights by systematic sampling.

Each document's expected number of copies is its source's target over its source's size. Along a fixed
order of the source, the expected copies are summed, one random offset is added, and a document is taken
once for each whole number that the sum passes while it goes by.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from priorline.llm.common import WORD, packed, whole, without

CELL_ROWS = 20_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, most: float = 3.0) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Sources take the weights in turn, by code point with null last. The level at which targets fill up is
    the largest of what is left for the sources from here on, over their weights, when the ones before
    (in the order of size over weight) stand at their limit.
    """
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    ratio = F.col("source_size") / F.col("w")
    ranked = sizes.withColumn("_n", F.row_number().over(by_name)).withColumn(
        "w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("_n") - 1) % len(weights) + 1).cast("int"))
    )
    by_ratio = Window.partitionBy(F.lit(0)).orderBy(ratio, F.col("_n"))
    whole_table = Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("source_size").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(whole_table) * F.lit(share) - before * F.lit(most)) / rest
    levelled = ranked.withColumn("_level", level)
    return levelled.withColumn("_top", F.max("_level").over(whole_table)).select(
        "source", "source_size", F.least(F.col("source_size") * F.lit(most), F.col("w") * F.col("_top")).alias("target")
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, most: float = 3.0, seed: int = 7, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Adds size, source_size, target, copies and taken to every row; copies says how often the mix takes it.

    Defined cases: a null text has size 0, a null source is the last source, a null key sorts just behind the word
    null, rows with one key sort by size and by a hash of the text, repeated rows are rows of their own, a source without words gets no copies, an empty table
    gives no rows, and columns of these names in any case are replaced. Copies never exceed `most`,
    rounded up. The order within a source is by size class, then by a hash of the key, so that every size class
    is sampled evenly; it is dealt into cells of that order, whose counts are all that is summed along a source.
    Reruns give the same rows.
    """
    taken = ["size", "source_size", "target", "copies", "taken"]
    docs = without(docs, taken)
    rows = docs.count()
    digits = max(1, math.ceil(math.log(max(rows / (40 * CELL_ROWS), 1), 16)) + 1)
    bits = F.bin("size")
    named = (
        docs.select(
            packed(docs),
            F.regexp_count(whole(F.col(text).cast("string")), F.lit(WORD)).cast("long").alias("size"),
            F.col(source).alias("_source"),
            F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("_key"),
            F.col(key).isNull().alias("_no_key"),
            F.xxhash64(whole(F.col(text).cast("string"))).alias("_body"),
        )
        .withColumn("_hash", F.md5("_key"))
        .withColumn("_class", F.concat(F.lpad(F.length(bits).cast("string"), 2, "0"), F.substring(bits, 1, 3)))
        .withColumn("_cell", F.concat(F.col("_class"), F.lit(":"), F.substring("_hash", 1, digits)))
    )
    cells = named.groupBy("_source", "_cell").agg(F.count(F.lit(1)).alias("_rows"), F.sum("size").alias("_words"))
    targets = source_targets(cells.groupBy(F.col("_source").alias("source")).agg(F.sum("_words").alias("source_size")), weights, share, most)
    along = Window.partitionBy("_source").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    placed_cells = cells.withColumn("_before", F.coalesce(F.sum("_rows").over(along), F.lit(0)))
    plan = (
        placed_cells.join(targets, F.col("_source").eqNullSafe(F.col("source")))
        .withColumn("_rate", F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0)))
        .withColumn("_u", F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_source"), F.lit("")))), 1, 5), 16, 10).cast("double") / float(1 << 20))
        .select(F.col("_source").alias("_s"), F.col("_cell").alias("_c"), "source_size", "target", "_before", "_rate", "_u")
    )
    inside = Window.partitionBy("_source", "_cell").orderBy("_hash", "_key", "size", "_no_key", "_body")
    numbered = named.withColumn("_rank", F.row_number().over(inside)).join(plan, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_cell") == F.col("_c")))
    upto = F.col("_before") + F.col("_rank")
    copies = F.floor(F.col("_u") + F.col("_rate") * upto) - F.floor(F.col("_u") + F.col("_rate") * (upto - 1))
    return numbered.withColumn("copies", copies.cast("long")).withColumn("taken", F.col("copies") * F.col("size")).select("_row.*", *taken)


def take(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: every row of mix() as often as its copies say, with the given columns only."""
    return mixed.filter(F.col("copies") > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*columns)
