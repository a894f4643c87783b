"""Values typed into forms: what overrides the file, and when a series of changes is told.

Both functions take a table or a stream of changes (form_id, field, ts, seq, value,
original). Over a stream they are Spark's own keyed state: the last value of a field is
an aggregate, so rows that come in any order, in any batch, give the same store; a
series of changes is a session that ends when the watermark has passed its gap, and
rows older than the watermark of the batch before are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overrides(changes: DataFrame) -> DataFrame:
    """form_id, field, value, overridden, n_changes: the newest value of each field that was ever changed.

    Newest by ts, then seq. A value equal to the file's own is no override any more.
    Over a stream: output mode update or complete, a row for each field that changed.
    """
    at = F.struct("ts", "seq")
    last = changes.groupBy("form_id", "field").agg(F.max_by(F.struct("value", "original"), at).alias("last"), F.count("*").alias("n_changes"))
    return last.select("form_id", "field", "last.value", (~F.col("last.value").eqNullSafe(F.col("last.original"))).alias("overridden"), "n_changes")


def notifications(changes: DataFrame, gap: str = "10 minutes", late: str | None = None) -> DataFrame:
    """form_id, first_ts, last_ts, fields, n_changes: one row for changes that follow each other within the gap.

    late: how far rows may come behind the newest one; over a stream needed, as its watermark.
    """
    rows = changes.withWatermark("ts", late) if late else changes
    series = rows.groupBy("form_id", F.session_window("ts", gap)).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.array_sort(F.collect_set("field")).alias("fields"), F.count("*").alias("n_changes"))
    return series.select("form_id", "first_ts", "last_ts", "fields", "n_changes")
