"""Runs of numbers, list counters, removals, and sums over images of a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import dealt

# Bytes and share of images that make a file heavy.
HEAVY_BYTES, HEAVY_SHARE = 1 << 20, 0.4
#: Bytes of numbers that a task sorts at a time.
NUMBERS_TOGETHER = 16 << 20


def sections(numbers: DataFrame, by: str, number: str) -> DataFrame:
    """by, first, n: the runs of consecutive numbers, repeated ones once."""
    rank = F.dense_rank().over(Window.partitionBy(by).orderBy(number))
    # ranks pass over repeated numbers, and a run is as long as its ends are apart, so no set of numbers is held
    islands = dealt(numbers.select(by, number), NUMBERS_TOGETHER, by).withColumn("island", F.col(number) - rank).groupBy(by, "island")
    return islands.agg(F.min(number).alias("first"), F.coalesce((F.max(number) - F.min(number)).cast("bigint") + 1, F.lit(1).cast("bigint")).alias("n")).drop("island")


def counters(items: DataFrame, by: str, order: str, levels: int) -> DataFrame:
    """items with column level (from 0) -> with the counts of levels 0 to level as a label.

    A level counts on until an item of an upper level comes; an upper level that has
    not come yet counts as begun.
    """
    rows = items
    run = Window.partitionBy(by).orderBy(order)
    for k in range(1, levels):
        rows = rows.withColumn(f"above_{k}", F.count_if(F.col("level") < k).over(run))
    counts = []
    for k in range(levels):
        own = Window.partitionBy(by, *([f"above_{k}"] if k else [])).orderBy(order)
        rows = rows.withColumn(f"count_{k}", F.count_if(F.col("level") == k).over(own))
        counts.append(F.greatest(F.col(f"count_{k}"), F.lit(1)).cast("string"))
    label = F.array_join(F.slice(F.array(*counts), F.lit(1), F.col("level") + 1), ".")
    return rows.withColumn("label", label).drop(*[f"above_{k}" for k in range(1, levels)], *[f"count_{k}" for k in range(levels)])


def not_removed(pages: DataFrame, steps: DataFrame, keys: list[str]) -> DataFrame:
    """Pages whose last step (keys, step, removed) is no removal, and those without steps."""
    last = steps.groupBy(*keys).agg(F.max_by("removed", "step").alias("removed"))
    return pages.join(last.where("removed"), keys, "left_anti")


def compressible(images: DataFrame, masks: DataFrame) -> DataFrame:
    """images (doc_id, num, size, recodable), masks (doc_id, num) -> doc_id, bytes that can be coded again, total."""
    marked = images.join(masks.distinct().withColumn("mask", F.lit(True)), ["doc_id", "num"], "left")
    useful = F.col("recodable") & F.col("mask").isNull()
    return marked.groupBy("doc_id").agg(F.sum(F.when(useful, F.col("size")).otherwise(0)).alias("bytes"), F.sum("size").alias("total"))


def heavy(images: Column, total: Column) -> Column:
    return (images >= HEAVY_BYTES) & (images >= total * HEAVY_SHARE)
