"""Connected components over a distributed edge list, by alternating large and small stars.

Each round replaces edges by edges to the smallest known neighbour. All steps are joins on a minimum that
is aggregated before the shuffle; no component, and no list of links, ever meets in one task or the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priorline.llm.common import durable


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"]


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Edges (a, b) of longs to (node, root): every node that has an edge, with the smallest node it reaches.

    Loops and repeated edges are harmless; no edges give no rows; edges with a null end are left out.
    """
    edges = durable(edges.select("a", "b").filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(edges)
    for _ in range(most_rounds):
        if not mark[0]:
            break
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.join(low, both.a == low.n).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
        small = large.join(least, large.a == least.n).select("a", "b", "m")
        stars = small.select("a", F.col("m").alias("b")).union(small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        edges = durable(stars.filter("a <> b").distinct())
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
