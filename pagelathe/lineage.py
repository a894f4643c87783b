"""Cutting the lineage of iterative plans in the cluster's shared folder."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tasks that the rows which share a key are dealt over.
WAYS = 8

#: Tasks beyond which an estimate of a size is not believed.
MOST_TASKS = 100_000


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint of df in spark.checkpoint.dir. Where none is set a local master gets a folder of its own, a cluster an error."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="lineage-"))
    return df.checkpoint()


def dealt(rows: DataFrame, bytes_each: int, *keys: str, joined: bool = False) -> DataFrame:
    """rows dealt by keys over as many tasks as bytes_each of their estimated size make, one a core at least.

    The count is fixed, so few bytes with much work stay spread and no task gets more than its share.
    Rows of unknown size, which Spark takes for endless, make spark.sql.shuffle.partitions tasks.
    joined: that many at least, since a join deals the side of fewer tasks anew.
    """
    session = rows.sparkSession
    tasks = -(-int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // bytes_each)
    usual = int(session.conf.get("spark.sql.shuffle.partitions"))
    known = tasks if tasks <= MOST_TASKS else usual
    return rows.repartition(max(session.sparkContext.defaultParallelism, known, usual if joined else 1), *keys)


def dealt_join(left: DataFrame, right: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """left outer join of rows of which very many may share a key: they are dealt over WAYS tasks by their own columns, the other side goes to all.

    Both sides are shuffled: the size of files says little about rows copied WAYS times,
    and a broadcast chosen by it has to fit the driver.
    """
    own = F.xxhash64(*by)
    # rows without a key meet nothing, so they may go anywhere
    dealt = left.withColumn("_way", F.when(F.col(keys[-1]).isNull(), F.lit(WAYS) + F.pmod(own, F.lit(1 << 20))).otherwise(F.pmod(own, F.lit(WAYS))))
    copied = right.withColumn("_way", F.explode(F.sequence(F.lit(0), F.lit(WAYS - 1)).cast("array<bigint>")))
    return dealt.join(copied.hint("merge"), [*keys, "_way"], "left").drop("_way")
