"""Prior counts over a stream: each micro-batch reads the state before it and then adds to it.

State is a table of versions in a shared folder, one per batch, so a repeated batch reads the same version and writes the
same next one. Rows at or before the state's newest time are an error, never dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priorline.operators.asof import with_prior

STATE = "team long, wins long, games long, newest timestamp_ntz"


def prior_counts(folder: str):
    """A function for foreachBatch over team facts (match_id, side, ts, team, win): writes out/ and state/ below folder."""

    def step(facts: DataFrame, epoch: int) -> None:
        spark = facts.sparkSession
        if facts.isEmpty():
            state = spark.createDataFrame([], STATE) if epoch == 0 else spark.read.parquet(f"{folder}/state/{epoch - 1}")
            state.write.mode("overwrite").parquet(f"{folder}/state/{epoch}")
            return
        state = spark.createDataFrame([], STATE) if epoch == 0 else spark.read.schema(STATE).parquet(f"{folder}/state/{epoch - 1}")
        newest, first = state.agg(F.max("newest")).first()[0], facts.agg(F.min("ts")).first()[0]
        if newest is not None and first <= newest:
            raise ValueError(f"rows at {first} are not after the state at {newest}")
        inside = with_prior(facts, ["team"], {"wins": "win", "games": "1"})
        before = state.select(F.col("team").alias("t"), F.col("wins").alias("w0"), F.col("games").alias("g0"))
        read = inside.join(before, inside.team == before.t, "left").select(
            "match_id", "side", "team", (F.col("wins") + F.coalesce("w0", F.lit(0))).alias("wins"), (F.col("games") + F.coalesce("g0", F.lit(0))).alias("games")
        )
        read.write.mode("overwrite").parquet(f"{folder}/out/batch={epoch}")
        added = facts.groupBy("team").agg(F.sum("win").alias("wins"), F.count(F.lit(1)).alias("games"), F.max("ts").alias("newest"))
        both = state.unionByName(added.withColumn("team", F.col("team").cast("long"))).groupBy("team").agg(F.sum("wins").alias("wins"), F.sum("games").alias("games"), F.max("newest").alias("newest"))
        both.write.mode("overwrite").parquet(f"{folder}/state/{epoch}")

    return step
