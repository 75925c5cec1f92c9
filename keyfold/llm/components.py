"""Connected components by alternating large-star and small-star steps.

Every step is joins and partial aggregates over narrow edge rows. The minima are
written before they are joined: the join then broadcasts them if they are small,
or else has a plain shuffle on both sides, which skew handling can split at a hub.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.sources.shared import drop_path, store


def _large_star(edges: DataFrame, paths: list[str]) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = store(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least", paths)
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame, paths: list[str]) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = store(down.groupBy("u").agg(F.min("v").alias("m")), "least", paths)
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): every node of ``edges`` (u, v) with the smallest node that it reaches.

    Null ends and loops are ignored. Raises if ``max_rounds`` do not settle the
    labels (the rounds needed grow with the logarithm of the nodes).
    """
    spark, old = edges.sparkSession, []
    now = store(edges.where("u <> v").select("u", "v").distinct(), "edges", old)
    seen = None
    for _ in range(max_rounds):
        done, old = old, []
        now = store(_small_star(_large_star(now, done), done).distinct(), "edges", old)
        for path in done:  # nothing reads the round before any more
            drop_path(spark, path)
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select("v").distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select(F.col("v").alias("node"), F.col("v").alias("component"))
    )
