"""Exact k-means assignments with Hamerly bounds.

Every vector keeps one upper bound of the distance to its own centroid and one
lower bound of the distance to any other. When centroids move, the upper bound grows
by the drift of the own centroid and the lower one shrinks by the largest drift of
the others. A vector whose upper bound stays below the lower one, or below half the
distance from its centroid to the nearest other centroid, keeps its cluster unseen. The
others first get their exact distance to the own centroid, and where that does not
settle it a full scan in exact integers, ties to the smaller number.

The state (vector, cluster, bounds) is written to the shared folder once a round, so a
lost executor costs a reread. Centroids travel with the tasks: k * size numbers. Sums
are kept on the driver from round to round; a task sends the change that its vectors
made, one row for each cluster and component, and Spark adds them up.

Integers are exact at any size: int64 arithmetic where distances are sure to fit,
Python integers otherwise. Sums travel as limbs of 31 bits.

Defined cases: vectors that are null, of another length, or hold null or non-finite
components take no part, nor do those whose scaled components leave the range of a
double; a null vec_id takes part but never starts a centroid; equal rows each count;
fewer vectors than k give fewer centroids, none give no rows; distances and inertias
above 2^63 - 1 are given as 2^63 - 1; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, table

#: Components below this have squared distances that int64 holds for up to 2^13 components.
SAFE = 1 << 24
#: Bounds are floats; they are loosened by this share, far above their rounding.
SLACK = 1e-9
LIMB = 31
MOST = (1 << 63) - 1
STATE = "vec_id bigint, v binary, cluster int, was int, upper double, lower double"


def usable(vectors: DataFrame, scale: int, size: int) -> DataFrame:
    """vec_id, v: floor(scale * x), as whole doubles, of the vectors that take part."""
    x = F.col("embedding").cast("array<double>")
    v = F.transform(x, lambda c: F.expr("double(1)") * c * scale)
    good = F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return vectors.where((F.size(x) == size) & good).select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v"))


def whole(x: np.ndarray) -> np.ndarray:
    """Floors of doubles as int64, or as Python integers where one is SAFE or more."""
    x = np.floor(x)
    if not x.size or np.abs(x).max() < SAFE:
        return x.astype(np.int64)
    return np.array([int(c) for c in x.ravel()], dtype=object).reshape(x.shape)


def packed(v: np.ndarray) -> pa.Array:
    """Rows of integers as binary: 16 bits each where they fit, else 64-bit doubles (whole numbers stay exact)."""
    small = v.dtype != object and (not v.size or np.abs(v).max() < 1 << 15)
    rows = np.ascontiguousarray(v.astype(np.int16 if small else np.float64))
    width = rows.shape[1] * rows.itemsize
    ends = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(rows.tobytes())])


def unpacked(column: pa.Array, size: int) -> np.ndarray:
    rows = [x.as_buffer() for x in column]
    if all(len(r) == 2 * size for r in rows):
        return np.frombuffer(b"".join(rows), np.int16).reshape(-1, size).astype(np.int64)
    return whole(np.array([np.frombuffer(r, np.int16 if len(r) == 2 * size else np.float64) for r in rows], dtype=np.float64))


def squared(v: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to centre (one row, or one for each)."""
    gap = v - centre
    return (gap * gap).sum(axis=1)


def roots(square: np.ndarray) -> np.ndarray:
    return np.sqrt(square.astype(np.float64))


class Centroids:
    """k centroids of whole numbers and how far they have moved."""

    def __init__(self, points: list[list[int]], drift: list[float]):
        big = any(abs(c) >= SAFE for p in points for c in p)
        self.points = np.array(points, dtype=object if big else np.int64)
        self.drift = np.array(drift)
        n = len(points)
        apart = np.array([[float(sum((a - b) ** 2 for a, b in zip(points[i], points[j], strict=True))) if i != j else np.inf for j in range(n)] for i in range(n)])
        self.half = np.sqrt(apart.min(axis=1)) / 2 * (1 - SLACK)
        others = np.array([[d for j, d in enumerate(drift) if j != i] or [0.0] for i in range(n)])
        self.other_drift = others.max(axis=1)

    def scan(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest centroid, its squared distance and the second one's, of each row; exact."""
        far = np.stack([squared(v, p) for p in self.points], axis=1)
        near = np.zeros(len(v), np.int64)
        least = far[:, 0].copy()
        for c in range(1, far.shape[1]):
            closer = (far[:, c] < least).astype(bool)
            near[closer], least[closer] = c, far[closer, c]
        rest = far.astype(np.float64)
        rest[np.arange(len(v)), near] = np.inf
        return near, least, rest.min(axis=1)


def assign(batches: Iterator[pa.RecordBatch], centres: Centroids, size: int) -> Iterator[pa.RecordBatch]:
    """The state after centroids have moved; was: the cluster before."""
    for batch in batches:
        v = unpacked(batch.column("v"), size)
        was = batch.column("cluster").to_numpy().astype(np.int64)
        upper, lower = (batch.column(c).to_numpy().copy() for c in ("upper", "lower"))
        cluster = was.copy()
        own = np.maximum(was, 0)
        upper += centres.drift[own]
        lower -= centres.other_drift[own]
        sure = np.maximum(lower * (1 - SLACK), centres.half[own])
        open_ = np.flatnonzero((was < 0) | ~(upper * (1 + SLACK) < sure))
        known = open_[was[open_] >= 0]
        if len(known):
            upper[known] = roots(squared(v[known], centres.points[own[known]])) * (1 + SLACK)
            open_ = np.concatenate([open_[was[open_] < 0], known[~(upper[known] * (1 + SLACK) < sure[known])]])
        if len(open_):
            near, least, second = centres.scan(v[open_])
            cluster[open_], upper[open_], lower[open_] = near, roots(least) * (1 + SLACK), np.sqrt(second) * (1 - SLACK)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(cluster, pa.int32()), pa.array(was, pa.int32()), pa.array(upper), pa.array(lower)], names=["vec_id", "v", "cluster", "was", "upper", "lower"])


def unassigned(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows (vec_id, v: doubles) as a state without clusters."""
    for batch in batches:
        n = len(batch)
        v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(n, size)
        none, nil = pa.array(np.full(n, -1, np.int32)), pa.array(np.zeros(n))
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), packed(whole(v)), none, none, nil, nil], names=["vec_id", "v", "cluster", "was", "upper", "lower"])


CHANGES = "cluster int, item int, limb int, value bigint"


def changes(batches: Iterator[pa.RecordBatch], k: int, size: int) -> Iterator[pa.RecordBatch]:
    """What a task's vectors add to the sums of clusters that they join and leave; item `size` is the count."""
    total = np.zeros((k, size + 1), dtype=object)
    for batch in batches:
        v = unpacked(batch.column("v"), size)
        for column, sign in (("cluster", 1), ("was", -1)):
            at = batch.column(column).to_numpy()
            for c in np.unique(at[at >= 0]).tolist():
                mine = v[at == c]
                total[c, :size] += sign * mine.sum(axis=0).astype(object)
                total[c, size] += sign * len(mine)
    rows = []
    for c, item in zip(*(x.tolist() for x in np.nonzero(total)), strict=True):
        value, limb = int(total[c, item]), 0
        sign, value = (-1, -value) if value < 0 else (1, value)
        while value:
            rows.append((c, item, limb, sign * (value & ((1 << LIMB) - 1))))
            value, limb = value >> LIMB, limb + 1
    cluster, item, limb, value = map(list, zip(*rows, strict=True)) if rows else ([], [], [], [])
    yield pa.RecordBatch.from_arrays([pa.array(cluster, pa.int32()), pa.array(item, pa.int32()), pa.array(limb, pa.int32()), pa.array(value, pa.int64())], names=["cluster", "item", "limb", "value"])


def measured(batches: Iterator[pa.RecordBatch], centres: Centroids, size: int) -> Iterator[pa.RecordBatch]:
    """vec_id, cluster, distance: exact squared distances to the assigned centroids."""
    for batch in batches:
        at = batch.column("cluster").to_numpy()
        far = squared(unpacked(batch.column("v"), size), centres.points[at])
        far = np.minimum(far, MOST).astype(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("cluster"), pa.array(far)], names=["vec_id", "cluster", "distance"])


def first_centroids(kept: DataFrame, k: int) -> list[list[int]]:
    """The vectors with the smallest hashes of their ids, in that order; equal ids by their components."""
    key = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    found = kept.where("vec_id IS NOT NULL").select(key.alias("key"), "v").orderBy("key", F.transform("v", lambda c: F.floor(c))).limit(k).collect()
    return [whole(np.array(r["v"], dtype=np.float64)).tolist() for r in found]


def drifts(before: list[list[int]], after: list[list[int]]) -> list[float]:
    return [float(sum((a - b) ** 2 for a, b in zip(p, q, strict=True))) ** 0.5 * (1 + SLACK) for p, q in zip(before, after, strict=True)]


def centroid_clusters(vectors: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, size: int = 64) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: one row for each usable vector.

    rounds times every vector goes to the nearest of k centroids and each non-empty
    centroid becomes the floor of its vectors' mean; then vectors are assigned once more.
    """
    kept = usable(vectors, scale, size)
    points = first_centroids(kept, k)
    if not points:
        nothing = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
        return vectors.sparkSession.createDataFrame([], nothing)
    state = kept.mapInArrow(lambda it: unassigned(it, size), STATE)
    moved = [0.0] * len(points)
    sums = [[0] * (size + 1) for _ in points]
    for turn in range(rounds + 1):
        centres = Centroids(points, moved)
        state = materialize(state.mapInArrow(lambda it, c=centres: assign(it, c, size), STATE))
        if turn == rounds:
            break
        told = state.where("cluster <> was").mapInArrow(lambda it: changes(it, len(points), size), CHANGES)
        for c, item, limb, value in told.groupBy("cluster", "item", "limb").agg(F.sum("value")).collect():
            sums[c][item] += value << (LIMB * limb)
        after = [[x // s[-1] for x in s[:-1]] if s[-1] else p for s, p in zip(sums, points, strict=True)]
        points, moved = after, drifts(points, after)
    found = materialize(state.mapInArrow(lambda it: measured(it, centres, size), "vec_id bigint, cluster int, distance bigint"))
    held = {c: int(n) for c, n in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
    rows = [(c, min(held.get(c, 0), MOST), min(sum(held.values()), MOST), hashlib.sha256(",".join(map(str, p)).encode()).hexdigest()) for c, p in enumerate(points)]
    told = vectors.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_centroid_clusters(spark, sf_dir: str) -> DataFrame:
    return centroid_clusters(table(spark, sf_dir, "embeddings"))


def _round(n: int) -> str:
    """Assignment a<n> to the centroids c<n>, and the centroids c<n+1> that follow."""
    return f"""
a{n} AS (SELECT vec_id, r, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.vec_id, v.r, k.c, list_sum(list_transform(range(1, 65), lambda i: (v.e[i] - k.e[i]) * (v.e[i] - k.e[i])))::BIGINT AS d FROM v CROSS JOIN c{n} k) GROUP BY vec_id, r),
c{n + 1} AS (SELECT k.c, coalesce(m.e, k.e) AS e FROM c{n} k LEFT JOIN (SELECT c, list((s - ((s % m) + m) % m) // m ORDER BY i) AS e FROM
  (SELECT c, i, sum(x)::BIGINT AS s, count(*)::BIGINT AS m FROM (SELECT a.c, unnest(v.e) AS x, unnest(range(64)) AS i FROM a{n} a JOIN v USING (r)) GROUP BY c, i) GROUP BY c) m USING (c))"""


def oracle() -> str:
    return f"""
WITH v AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY h, e) - 1 AS c, e FROM (SELECT sha256('1:' || vec_id) AS h, e FROM v WHERE vec_id IS NOT NULL ORDER BY h, e LIMIT 16)),
{','.join(_round(n) for n in range(4))}
SELECT a.vec_id, a.c::INTEGER AS cluster, a.d AS distance, sum(a.d) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia, sum(a.d) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(list_transform(k.e, lambda x: x::VARCHAR), ',')) AS centroid_sha256 FROM a3 a JOIN c3 k USING (c)"""
