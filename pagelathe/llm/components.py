"""Connected components by alternating large-star and small-star, on edge tables.

Each round is two groupings and two joins over the edges, written to the shared
folder; nothing is collected but one row of counts. A node of any degree is
handled by partial aggregation and by joins whose hot keys are dealt over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, spread_join


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m"))
    joined = spread_join(both.where("v > u"), low, "u", "v", 8)
    return joined.select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.union(low.select("u", F.col("m").alias("v"))).distinct()


def fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """Edges (u, v) of longs -> (node, root): root is the smallest node reachable.

    Nulls and loops are ignored; only nodes with an edge are returned.
    """
    edges = materialize(edges.select("u", "v").where("u <> v").distinct())
    before = None
    for _ in range(most_rounds):
        edges = materialize(small_star(large_star(edges)))
        now = fingerprint(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not converge")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
