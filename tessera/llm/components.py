"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import checkpointed


def connected(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in edges (a, b); component: the smallest id that can be reached.

    Each round hangs neighbours below the smallest one they know. Rounds grow
    with the logarithm of the longest path; each is written to the checkpoint
    folder. Edges are counted and hashed to see when they stand still.
    """
    now, mark = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()), None
    while True:
        now_mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now_mark == mark:
            return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
        mark = now_mark
        # large star: every larger neighbour of u goes below the smallest of u and its neighbours
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        now = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: u and its smaller neighbours go below the smallest of them
        least = now.groupBy("a").agg(F.min("b").alias("m"))
        now = checkpointed(now.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m")).where("a <> b").distinct())
