"""Hand-drawn strokes: near points dropped, smoothed, simplified; many strokes an Arrow batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def simplified(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Indexes of the points that stay so that no other is farther than tolerance from their line."""
    stays = np.zeros(len(points), bool)
    stays[[0, -1]] = True
    open_ = [(0, len(points) - 1)] if len(points) > 2 else []
    while open_:
        a, b = open_.pop()
        if b - a < 2:
            continue
        line, rel = points[b] - points[a], points[a + 1 : b] - points[a]
        length = line @ line
        t = np.clip(rel @ line / length, 0, 1) if length else np.zeros(len(rel))
        away = np.hypot(*(rel - t[:, None] * line).T)
        k = int(away.argmax())
        if away[k] > tolerance:
            stays[a + 1 + k] = True
            open_ += [(a, a + 1 + k), (a + 1 + k, b)]
    return np.flatnonzero(stays)


def apart(points: np.ndarray, least: float) -> np.ndarray:
    """Without points nearer than least to the last that stayed; the end replaces the last instead."""
    stays = [0]
    for i in range(1, len(points)):
        if np.hypot(*(points[i] - points[stays[-1]])) >= least:
            stays.append(i)
        elif i == len(points) - 1 and len(stays) > 1:
            stays[-1] = i
    return points[stays]


def smooth(points: np.ndarray, passes: int) -> np.ndarray:
    for _ in range(passes if len(points) > 2 else 0):
        points = np.concatenate([points[:1], (points[:-2] + 2 * points[1:-1] + points[2:]) / 4, points[-1:]])
    return points


def _each(strokes: DataFrame, work, result: str) -> DataFrame:
    """work on the points (n, 2) of each stroke; a null or empty stroke gives null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [work(np.array(p, float)) if p else None for p in batch.column("points").to_pylist()]
            kind = pa.list_(pa.int32()) if result == "array<int>" else pa.list_(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("stroke_id"), pa.array(out, kind)], names=["stroke_id", "points"])

    return strokes.select("stroke_id", "points").mapInArrow(run, f"stroke_id bigint, points {result}")


def simplify(strokes: DataFrame, tolerance: float) -> DataFrame:
    """stroke_id, points (array of x, y) -> stroke_id and the indexes of the points that stay."""
    return _each(strokes, lambda p: simplified(p, tolerance).tolist(), "array<int>")


def prepare(strokes: DataFrame, width: float, height: float, tolerance: float = 0.35) -> DataFrame:
    """Points from 0 to 1 of a page -> near ones dropped, smoothed twice, simplified, again from 0 to 1."""
    size = np.array([width, height])

    def work(points: np.ndarray) -> list:
        kept = smooth(apart(points * size, tolerance / 2), 2)
        return np.clip(kept[simplified(kept, tolerance)] / size, 0, 1).tolist()

    return _each(strokes, work, "array<array<double>>")
