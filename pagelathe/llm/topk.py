"""Exact top-k inner-product search by columnar branch and bound.

Vectors are kept dimension by dimension (vertical layout) in blocks of rows. For a
query, scores are accumulated one block of dimensions at a time; what the
remaining dimensions can still add is at most the product of the remaining norms,
so candidates that cannot reach the query's k-th best score any more are compacted
away before the next block of dimensions.

Queries and candidates are dealt over a grid of groups: a task reads one group of
queries and one group of candidates block by block and carries the thresholds on;
the best of each group are merged by query. Group sizes are bounded, so a task's
memory is, too. Both sides of a cell have about as many bytes, components travel as
16-bit numbers where they fit, and a group of candidates goes to one task for every
GROUP_QUERIES queries only. A block whose largest norm cannot reach a query's
threshold is skipped.

Scores are exact at any size: floats hold them where norms keep every sum below 2^53,
else floats only choose, with a margin, and Python integers score what is left. The
order of results is that of the exact scores; a score outside of a long is given as the
nearest long.

Defined cases: vectors whose scaled components leave the range of a double, and vectors that are null, empty, or hold null or non-finite components
take no part; vectors of another length than the query's are no candidates; a null
vec_id takes no part; a row is no candidate of queries with its own vec_id; ties go
to the smaller vec_id; equal rows each count; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table

#: Whole numbers up to this are exact as floats; a margin that covers the rounding of norms.
EXACT, SLACK = 2.0**53, 1e-9
MOST = (1 << 63) - 1

#: Rows of a block of candidates, most blocks of a group, queries of a group, queries scored together, dimensions of a step.
BLOCK_ROWS, GROUP_BLOCKS, GROUP_QUERIES, TOGETHER, STEP = 4096, 4, 8192, 256, 16
#: Cells that a grid has at least, if there are so many blocks.
LEAST_CELLS = 32


def whole_vectors(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, v: the usable vectors with components scale * x; blocks take the floor."""
    x = F.col("embedding").cast("array<double>")
    v = F.transform(x, lambda c: c * scale)
    good = F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.when(good & (F.size(x) > 0), v).alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")


def to_block(rows: pa.Table) -> pa.Table:
    """The rows of a block as one value: ids and the vectors, dimension by dimension, by vec_id."""
    rows = rows.sort_by("vec_id").combine_chunks()
    ids = rows.column("vec_id").to_numpy().astype(np.int64)
    flat = rows.column("v").combine_chunks()
    flat = flat.flatten() if not isinstance(flat, pa.ChunkedArray) else pa.concat_arrays(flat.chunks).flatten()
    planes = np.floor(np.ascontiguousarray(flat.to_numpy(zero_copy_only=False).reshape(len(ids), -1).T))
    if np.abs(planes).max() < 1 << 15:
        planes = planes.astype(np.int16)
    first = {k: rows.column(k)[0].as_py() for k in ("dim", "part")}
    return pa.table({"dim": pa.array([first["dim"]], pa.int32()), "part": pa.array([first["part"]], pa.int32()), "n": pa.array([len(ids)], pa.int32()), "ids": pa.array([ids.tobytes()], pa.binary()), "planes": pa.array([planes.tobytes()], pa.binary())})


BLOCK = "dim int, part int, n int, ids binary, planes binary"


def read_block(row: dict) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], np.int64)
    kind = np.int16 if len(row["planes"]) == 2 * row["dim"] * row["n"] else np.float64
    return ids, np.frombuffer(row["planes"], kind).reshape(row["dim"], row["n"]).astype(np.float64)


def tails(planes: np.ndarray, step: int) -> np.ndarray:
    """Norms of what is left of each vector after 0, 1, 2... steps of dimensions."""
    with np.errstate(over="ignore"):
        square = np.add.reduceat(planes**2, np.arange(0, len(planes), step), axis=0)
    left = np.cumsum(square[::-1], axis=0)[::-1]
    return np.sqrt(np.concatenate([left, np.zeros((1, planes.shape[1]))]))


class Best:
    """The k best (score, vec_id) so far of each query of a group."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.ids = k, [np.zeros(0)] * n, [np.zeros(0, np.int64)] * n
        self.least = np.full(n, -np.inf)

    def add(self, q: int, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.score[q], score]), np.concatenate([self.ids[q], ids])
        if score.dtype == object:
            order = np.array(sorted(range(len(score)), key=lambda i: (-int(score[i]), ids[i]))[: self.k], np.int64)
        else:
            if len(score) > self.k:
                near = np.flatnonzero(score >= np.partition(score, len(score) - self.k)[len(score) - self.k])
                score, ids = score[near], ids[near]
            order = np.lexsort((ids, -score))[: self.k]
        self.score[q], self.ids[q] = score[order], ids[order]
        if len(order) == self.k:
            self.least[q] = float(score[order[-1]])


def whole_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of one vector and each column, as Python integers."""
    mine = [int(c) for c in q.tolist()]
    return np.array([sum(a * int(c) for a, c in zip(mine, column, strict=True)) for column in x.T.tolist()], dtype=object)


def scan_block(best: Best, q_ids: np.ndarray, q: np.ndarray, q_left: np.ndarray, ids: np.ndarray, x: np.ndarray, step: int) -> None:
    """One block of candidates against a group of queries."""
    left = tails(x, step)
    dims = np.arange(0, len(x), step)
    longest = left[0].max(initial=0)
    # a margin covers rounding: of the norms, and of sums that floats do not hold
    able = np.flatnonzero(~(q_left[0] * longest * (1 + SLACK) + 1e-6 < best.least))
    for k, i in enumerate(able.tolist()):
        if k % TOGETHER == 0:
            with np.errstate(over="ignore", invalid="ignore"):
                head = q[:step, able[k : k + TOGETHER]].T @ x[:step]
        part, alive = head[k % TOGETHER], None
        exact = q_left[0, i] * longest < EXACT
        margin = 1e-6 if exact else 1e-6 + SLACK * q_left[0, i] * longest
        for s in range(1, len(dims) + 1):
            room = left[s] if alive is None else left[s][alive]
            with np.errstate(over="ignore", invalid="ignore"):
                stay = np.flatnonzero(~(part + q_left[s, i] * room * (1 + SLACK) + margin < best.least[i]))
            alive = stay if alive is None else alive[stay]
            part = part[stay]
            if s == len(dims) or not len(alive):
                break
            with np.errstate(over="ignore", invalid="ignore"):
                part = part + q[dims[s] : dims[s] + step, i] @ x[dims[s] : dims[s] + step, alive]
        if len(alive):
            own = ids[alive] != q_ids[i]
            alive, part = alive[own], part[own]
            best.add(i, part if exact else whole_scores(q[:, i], x[:, alive]), ids[alive])


def order_keys(score: np.ndarray) -> list[bytes]:
    """Bytes that sort like the scores, of any size: 8 bytes for most, length and digits beyond."""
    out = []
    for s in score.tolist():
        s = int(s)
        if -(1 << 62) <= s < 1 << 62:
            out.append(b"\x01" + (s + (1 << 63)).to_bytes(8))
        else:
            size = -(-abs(s).bit_length() // 8)
            digits = size.to_bytes(4) + abs(s).to_bytes(size)
            out.append(b"\x02" + digits if s > 0 else b"\x00" + bytes(255 - c for c in digits))
    return out


def scan_groups(batches: Iterator[pa.RecordBatch], k: int, step: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell: a cell's query blocks (side 0), then its candidate blocks."""
    cell, best, queries = None, None, []

    def results() -> Iterator[pa.RecordBatch]:
        if best is not None:
            n = [len(s) for s in best.score]
            score = np.concatenate(best.score)
            given = np.array([max(-MOST - 1, min(MOST, int(x))) for x in score], np.int64) if score.dtype == object else score.astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(queries[0], n)), pa.array(np.concatenate(best.ids)), pa.array(given), pa.array(order_keys(score), pa.binary())], names=["query_id", "vec_id", "score", "key"])

    for batch in batches:
        for row in batch.to_pylist():
            if (at := (row["dim"], row["qgroup"], row["cgroup"])) != cell:
                yield from results()
                cell, best = at, None
            if row["side"] == 0:
                ids, q = read_block(row)
                queries = [ids, q, tails(q, step)]
                best = Best(len(ids), k)
            elif best is not None:
                ids, x = read_block(row)
                scan_block(best, *queries, ids, x, step)
    yield from results()


def top_k(vectors: DataFrame, k: int = 20, scale: int = 64, every: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k best for each row whose vec_id every divides."""
    whole = whole_vectors(vectors, scale).withColumn("dim", F.size("v"))
    n = max(1, whole.count())
    parts = -(-n // BLOCK_ROWS)
    q_parts = -(-n // (every * GROUP_QUERIES))
    groups = min(parts, max(-(-parts // GROUP_BLOCKS), -(-LEAST_CELLS // q_parts)))
    slot = lambda m: F.pmod(F.xxhash64("vec_id"), F.lit(m)).cast("int").alias("part")
    blocks = whole.select("vec_id", "v", "dim", slot(parts)).groupBy("dim", "part").applyInArrow(to_block, BLOCK)
    asked = whole.where(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", "v", "dim", slot(q_parts)).groupBy("dim", "part").applyInArrow(to_block, BLOCK)
    asked = asked.select("*", F.col("part").alias("qgroup"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("cgroup"), F.lit(0).alias("side"))
    blocks = blocks.select("*", F.explode(F.sequence(F.lit(0), F.lit(q_parts - 1))).alias("qgroup"), F.pmod("part", F.lit(groups)).cast("int").alias("cgroup"), F.lit(1).alias("side"))
    cells = min(groups * q_parts, 4096)
    dealt = asked.union(blocks).repartition(cells, "dim", "qgroup", "cgroup").sortWithinPartitions("dim", "qgroup", "cgroup", "side", "part")
    local = dealt.mapInArrow(lambda it: scan_groups(it, k, STEP), "query_id bigint, vec_id bigint, score bigint, key binary")
    order = Window.partitionBy("query_id").orderBy(F.desc("key"), "vec_id")
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_exact_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def oracle() -> str:
    return """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""
