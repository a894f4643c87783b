"""MinHash near-duplicates: many universal minima, banding, verification, components.

1. Every text gives its set of word shingles, a 128-bit digest of the set, HASHES
   universal minima folded into BANDS band keys.
2. Texts with equal sets are one class with a number of its own, so copies never
   meet in a band, whatever their doc_ids are.
3. In each band bucket every class is paired with the bucket's smallest class
   only. Pairs are confirmed on the full sets, streamed past their pivot; the
   partners of a pivot are dealt over SALTS groups.
4. Confirmed links make components by alternating large-star and small-star.
5. Classes that meet in buckets of one pivot but in several components are
   compared with each other on full sets, in blocks: sets of sizes that allow a link
   meet only (zones of sizes a factor apart), a sparse product gives all
   intersections of two blocks, and only links that join two components leave it. So
   no link is lost to the star of step 3, and no pairs are written.

With 32 bands of 4 a pair at similarity 0.8 shares no bucket with probability
(1 - 0.8**4)**32 < 5e-8.

Defined cases: a null, empty or wordless text has an empty set and is linked with
nothing; fewer words than a shingle make one shingle; repeated rows are equal
sets; rows of one doc_id with several texts are linked by each text alone; a row
with a null doc_id is kept, unlinked, with component_id null; extra columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, grams, materialize, mix64, seeds, signed, slices, spread_join, table, text_bytes, words
from .components import components

BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
#: Groups that the partners of a pivot are dealt over, and the most classes of a block in step 5.
SALTS, BLOCK = 64, 2048
#: Shingles that a product of a block takes at a time.
COLUMNS = 4096


def shingle_sets(raw: np.ndarray, off: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for a, b in slices(off):
        word, _, _, at = words(LOWER[raw[off[a] : off[b]]], off[a : b + 1] - off[a])
        gram = grams(word, n)
        for i in range(b - a):
            lo, hi = at[i], at[i + 1]
            if hi - lo >= n:
                yield np.unique(gram[lo : hi - n + 1])
            elif hi > lo:
                yield mix64(np.array([(word[lo:hi] * seeds(n, 5)[: hi - lo]).sum(dtype=np.uint64) + np.uint64(hi - lo)], dtype=np.uint64))
            else:
                yield np.zeros(0, np.uint64)


_A, _B = seeds(HASHES, 101)[:, None], mix64(seeds(HASHES, 202))[:, None]
_FOLD = seeds(ROWS, 303)
_BAND = mix64(seeds(BANDS, 404))


def minima(items: np.ndarray) -> np.ndarray:
    """HASHES universal minima (multiply-add, upper 32 bits) of a non-empty set."""
    low = None
    for k in range(0, len(items), 2048):
        part = ((items[None, k : k + 2048] * _A + _B).min(axis=1)) >> np.uint64(32)
        low = part if low is None else np.minimum(low, part)
    return low


def digest_of(items: np.ndarray) -> bytes:
    """128 bits of a set."""
    return mix64(items ^ np.uint64(7)).sum(dtype=np.uint64).tobytes() + mix64(items ^ np.uint64(77)).sum(dtype=np.uint64).tobytes()


def sketch(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """The rows with n_shingles, digest and bands in place of their text."""
    for batch in batches:
        raw, off = text_bytes(batch.column("text"))
        size, digest, bands = [], [], []
        for s in shingle_sets(raw, off, n):
            size.append(len(s))
            if len(s):
                low = minima(s)
                digest.append(digest_of(s))
                bands.append(signed(mix64((low.reshape(BANDS, ROWS) * _FOLD).sum(axis=1, dtype=np.uint64) + _BAND)))
            else:
                digest.append(None)
                bands.append(np.zeros(0, np.int64))
        ends = np.cumsum([0, *map(len, bands)]).astype(np.int32)
        flat = np.concatenate(bands) if bands else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("row"), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
            names=["doc_id", "row", "n_shingles", "digest", "bands"],
        )


def whole_sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """(cls, digest, text) -> (cls, items: sorted 64-bit shingles) where the text has the class's set, each class once a task."""
    told: set[int] = set()
    for batch in batches:
        cls, items = [], []
        for c, d, s in zip(batch.column("cls").to_pylist(), batch.column("digest").to_pylist(), shingle_sets(*text_bytes(batch.column("text")), n), strict=True):
            if len(s) and c not in told and digest_of(s) == d:
                told.add(c)
                cls.append(c)
                items.append(s.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(items, pa.binary())], names=["cls", "items"])


def unpacked(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in column]


def confirm(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by pivot, salt and role (0: the pivot itself) -> confirmed (u, v)."""
    group, pivot = None, None
    for batch in batches:
        keys = zip(*(batch.column(c).to_pylist() for c in ("pivot", "salt", "role", "cls")), strict=True)
        u, v = [], []
        for (p, salt, role, cls), s in zip(keys, unpacked(batch.column("items")), strict=True):
            if role == 0:
                group, pivot = (p, salt), s.copy()
            elif group == (p, salt) and 100 * min(len(pivot), len(s)) >= percent * max(len(pivot), len(s)):
                common = np.intersect1d(pivot, s, assume_unique=True).size
                if 100 * common >= percent * (len(pivot) + len(s) - common) > 0:
                    u.append(cls)
                    v.append(p)
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (cls, pivot) whose full sets are similar enough, as (u, v)."""
    members = pairs.select("pivot", F.pmod(F.xxhash64("cls"), F.lit(SALTS)).cast("int").alias("salt"), F.lit(1).alias("role"), "cls")
    pivots = members.select("pivot", "salt").distinct().select("pivot", "salt", F.lit(0).alias("role"), F.col("pivot").alias("cls"))
    dealt = members.union(pivots).join(sets, "cls").repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", "role", "cls")
    return dealt.select("pivot", "salt", "role", "cls", "items").mapInArrow(lambda it: confirm(it, percent), "u bigint, v bigint")


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each left with each right set."""
    both = [*left, *right]
    size = np.array([len(s) for s in both])
    if not size.sum():
        return np.zeros((len(left), len(right)), np.int64)
    value, column, count = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(both)), size)
    use = (count > 1)[column]
    row, column = row[use], column[use]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((len(left), len(right)), np.float32)
    cuts = np.searchsorted(column, np.arange(0, len(value) + COLUMNS, COLUMNS))
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if a < b:
            used, at = np.unique(column[a:b], return_inverse=True)
            plane = np.zeros((len(both), len(used)), np.float32)
            plane[row[a:b], at] = 1
            total += plane[: len(left)] @ plane[len(left) :].T
    return total.astype(np.int64)


CELL = ["pivot", "zone", "i", "next", "j"]


def joining_links(data: pa.Table, percent: int) -> pa.Table:
    """A cell: two blocks of a pivot's classes -> links between different components, one that suffices for each pair of them."""
    data = data.sort_by([("side", "ascending"), ("cls", "ascending")]).combine_chunks()
    cls, root, side = (data.column(c).to_numpy() for c in ("cls", "root", "side"))
    if len(np.unique(root)) < 2:
        return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
    sets = unpacked(data.column("items"))
    same = data.column("next")[0].as_py() == 0 and data.column("i")[0].as_py() == data.column("j")[0].as_py()
    left = np.flatnonzero(side == 0)
    right = left if same else np.flatnonzero(side == 1)
    size = np.array([len(s) for s in sets])
    common = intersections([sets[k] for k in left], [sets[k] for k in right])
    linked = (100 * common >= percent * (size[left][:, None] + size[right][None, :] - common)) & (root[left][:, None] != root[right][None, :])
    x, y = np.nonzero(linked)
    pair = np.stack([np.minimum(root[left][x], root[right][y]), np.maximum(root[left][x], root[right][y])], axis=1)
    _, first = np.unique(pair, axis=0, return_index=True) if len(pair) else (None, np.zeros(0, np.int64))
    return pa.table({"u": pa.array(cls[left][x[first]], pa.int64()), "v": pa.array(cls[right][y[first]], pa.int64())})


def cells(placed: DataFrame, percent: int) -> DataFrame:
    """(pivot, cls, root, n_shingles) of pivots with several components -> rows of cells.

    A zone holds sizes within a factor of percent / 100, so a link never skips a zone.
    A zone of n classes has blocks of 16 * sqrt(n), from 512 to BLOCK. Every two blocks of
    a zone (next 0), and of a zone and the next (next 1), are one cell.
    """
    zoned = placed.withColumn("zone", F.floor(F.log("n_shingles") / math.log(100 / percent) + 1e-9).cast("int"))
    block = F.least(F.lit(float(BLOCK)), F.greatest(F.lit(512.0), 16 * F.sqrt("n")))
    counts = zoned.groupBy("pivot", "zone").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("n"))
    mixed = counts.groupBy("pivot").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.map_from_entries(F.collect_list(F.struct("zone", F.ceil(F.col("n") / block).cast("int").alias("k")))).alias("blocks"))
    rest = spread_join(zoned, mixed.where("a <> b").select("pivot", "blocks"), "pivot", "cls").where("cls <> pivot")
    of = lambda z: F.sequence(F.lit(1), F.coalesce(F.try_element_at("blocks", z), F.lit(0)))
    some = lambda z, f: F.when(F.map_contains_key("blocks", z), F.transform(of(z), lambda o: f(o - 1))).otherwise(F.array().cast("array<struct<zone:int,i:int,next:int,j:int,side:int>>"))
    rest = rest.withColumn("own", F.pmod(F.xxhash64("cls"), F.element_at("blocks", F.col("zone"))).cast("int"))
    cell = lambda zone, i, n, j, side: F.struct(zone.alias("zone"), i.alias("i"), F.lit(n).alias("next"), j.alias("j"), side.cast("int").alias("side"))
    zone, own = F.col("zone"), F.col("own")
    listed = F.concat(
        some(zone, lambda o: cell(zone, F.least(own, o), 0, F.greatest(own, o), own > o)),
        some(zone + 1, lambda o: cell(zone, own, 1, o, F.lit(0))),
        some(zone - 1, lambda o: cell(zone - 1, o, 1, own, F.lit(1))),
    )
    return rest.select("pivot", "cls", "root", F.explode(listed).alias("c")).select("pivot", "cls", "root", "c.*")


def rows_of_classes(sketched: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """doc_id, row, n_shingles, component_id, cluster: each row with what its class belongs to.

    A class of very many copies, and a component of very many classes, are dealt over
    tasks; rows without a set or a doc_id meet no join.
    """
    joined = classes.select("digest", "rep", "cls").join(roots, F.col("cls") == F.col("node"), "left").withColumn("cluster", F.coalesce("root", "cls"))
    several = joined.where("root IS NOT NULL").groupBy("cluster").agg(F.min("rep").alias("component"))
    placed = spread_join(joined.where("root IS NOT NULL"), several, "cluster", "cls").select("digest", "cluster", "component")
    placed = placed.union(joined.where("root IS NULL").select("digest", "cluster", F.col("rep").alias("component")))
    rows = sketched.select("doc_id", "row", "n_shingles", "digest")
    alone = F.col("digest").isNull() | F.col("doc_id").isNull()
    told = ["doc_id", "row", "n_shingles", F.col("component").alias("component_id"), "cluster"]
    found = spread_join(rows.where(~alone), placed, "digest", "row").select(*told)
    return found.union(rows.where(alone).select("doc_id", "row", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("bigint")))


def clusters(docs: DataFrame, shingle: int = 5, percent: int = 80, row: str = "doc_id") -> DataFrame:
    """doc_id, row, n_shingles, component_id, cluster: one row per row of docs.

    Links texts whose shingle sets have 100 * intersection >= percent * union. row is a
    long column that is carried along; cluster numbers the components (null: no set).
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(row).cast("bigint").alias("row"), F.col("text").cast("string").alias("text"))
    sketched = materialize(docs.mapInArrow(lambda it: sketch(it, shingle), "doc_id bigint, row bigint, n_shingles bigint, digest binary, bands array<bigint>"))
    linked = sketched.where("doc_id IS NOT NULL AND digest IS NOT NULL")
    classes = linked.groupBy("n_shingles", "digest").agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands"))
    classes = materialize(classes.withColumn("cls", F.monotonically_increasing_id()))
    band = classes.select("cls", "n_shingles", F.posexplode("bands").alias("band", "key"))
    buckets = band.groupBy("band", "key").agg(F.min("cls").alias("pivot"), F.count("*").alias("size")).where("size > 1")
    member = materialize(band.join(buckets, ["band", "key"]))
    met = member.select("cls").distinct()
    wanted = classes.join(met, "cls").select("cls", "digest", F.col("rep").alias("doc_id"))
    texts = docs.where("doc_id IS NOT NULL").select("doc_id", "text").join(wanted, "doc_id")
    sets = materialize(texts.select("cls", "digest", "text").mapInArrow(lambda it: whole_sets(it, shingle), "cls bigint, items binary").dropDuplicates(["cls"]))
    links = materialize(confirmed(member.where("cls <> pivot").select("cls", "pivot").distinct(), sets, percent))
    roots = components(links)

    pairs = member.where("size > 2").select("pivot", "cls", "n_shingles").distinct()
    placed = pairs.join(roots, F.col("cls") == F.col("node"), "left").select("pivot", "cls", "n_shingles", F.coalesce("root", "cls").alias("root"))
    grid = materialize(cells(placed, percent))
    if not grid.isEmpty():
        with_sets = grid.join(sets, "cls")
        late = materialize(with_sets.groupBy(*CELL).applyInArrow(lambda t: joining_links(t, percent), "u bigint, v bigint"))
        if not late.isEmpty():
            roots = components(links.union(late))

    return rows_of_classes(sketched, classes, roots)


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, cluster: one row per row of docs; kept: doc_id is component_id, or null."""
    found = clusters(docs, shingle, percent)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "cluster")


def op5_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80).drop("cluster")
