"""Announcements of a paper detector: debounce, quiet time, hysteresis, tolerated misses.

The batch twins run over finished tables; `announce_stream` is the same step with
Spark's keyed state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Fixed values, in milliseconds and grey levels.
SETTLE_MS, GAP_MS = 1000, 2500
DARK_BELOW, LIGHT_FROM, MISSES = 60, 80, 3

STATE = "announced boolean, pending boolean, since bigint, last_at bigint"
OUT = "device string, ts_ms bigint, announced boolean"
START = (None, None, 0, -(1 << 60))


def step(state: tuple, found: bool, now: int, busy_until: int | None) -> tuple[tuple, bool]:
    """The next state, and whether it is announced now."""
    announced, pending, since, last_at = state
    if found != pending:
        pending, since = found, now
    quiet = pending == announced or now - since < SETTLE_MS or now - last_at < GAP_MS or (busy_until is not None and now < busy_until)
    return (announced, pending, since, last_at) if quiet else (pending, pending, since, now), not quiet


def fold(frames: pd.DataFrame, state: tuple = START) -> tuple[tuple, list]:
    said = []
    for r in frames.sort_values("ts_ms", kind="stable").itertuples():
        busy = None if pd.isna(r.busy_until) else int(r.busy_until)
        state, now = step(state, bool(r.found), int(r.ts_ms), busy)
        if now:
            said.append((int(r.ts_ms), state[0]))
    return state, said


def _announced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by device and time -> announcements; of a device only its state is held."""
    device, state = None, START
    for batch in batches:
        said = []
        for key, *frame in zip(*(batch.column(c).to_pylist() for c in ("device", "found", "ts_ms", "busy_until")), strict=True):
            if key != device:
                device, state = key, START
            state, now = step(state, *frame)
            if now:
                said.append((device, frame[1], state[0]))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in said], t) for k, t in enumerate((pa.string(), pa.int64(), pa.bool_()))], names=["device", "ts_ms", "announced"])


def announce(frames: DataFrame) -> DataFrame:
    """frames (device, ts_ms, found, busy_until) -> device, ts_ms, announced."""
    rows = frames.select("device", F.col("ts_ms").cast("bigint").alias("ts_ms"), "found", F.col("busy_until").cast("bigint").alias("busy_until"))
    return rows.repartition("device").sortWithinPartitions("device", "ts_ms", "found").mapInArrow(_announced, OUT)


def announce_stream(frames: DataFrame) -> DataFrame:
    """The same over a stream of frames."""

    def of_device(key: tuple, parts: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        state, said = (kept.get if kept.exists else START), []
        state, said = fold(pd.concat(list(parts)), tuple(state))
        kept.update(state)
        yield pd.DataFrame({"device": [key[0]] * len(said), "ts_ms": [t for t, _ in said], "announced": [a for _, a in said]})

    return frames.groupBy("device").applyInPandasWithState(of_device, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def light_warning(frames: DataFrame) -> DataFrame:
    """Adds dark: on below one brightness, off from a higher one, else as before."""
    order = Window.partitionBy("device").orderBy("ts_ms").rowsBetween(Window.unboundedPreceding, 0)
    switch = F.when(F.col("brightness") < DARK_BELOW, True).when(F.col("brightness") >= LIGHT_FROM, False)
    return frames.withColumn("dark", F.coalesce(F.last(switch, ignorenulls=True).over(order), F.lit(False)))


def tolerant_found(frames: DataFrame) -> DataFrame:
    """Adds steady: found in this or one of the two frames before."""
    order = Window.partitionBy("device").orderBy("ts_ms").rowsBetween(1 - MISSES, 0)
    return frames.withColumn("steady", F.max(F.col("found").cast("int")).over(order) == 1)
