"""Exact Jaccard join of word n-gram sets by rare-first prefix filtering.

Two sets of similarity t share a gram among the first n - ceil(t * n) + 1 of each, in
any order that all sets follow. Here grams come in the order: those of the counted
share of the hash space by their document frequency, rarest first; of these last the
very frequent ones; then all others by hash.

1. Texts with equal sets are one class. A class keeps its grams of the counted share,
   and as many more of the lowest hashes as its prefix may need.
2. Spark counts these grams over all classes. One that occurs once can link nothing:
   it takes a place in its prefix but no row. Frequent grams are found beforehand in a
   sample of classes; they are only put at the end of the order, where they would come
   anyway, so they never meet in one task to be counted.
3. Classes whose prefixes share a gram make a bucket, and are compared with the
   smallest class of the bucket (its pivot) if they pass
   - the length filter: the smaller set has t times the size of the larger one,
   - the positional filter: grams before and behind the shared one leave enough room,
   - the suffix filter: the sets, cut at fixed points of the hash space, have enough in
     common piece by piece.
   What passes is confirmed on full sets, each pair once, partners of a pivot dealt over
   tasks. Components of the links come from alternating stars.
4. Buckets of one pivot whose classes lie in several components are compared in
   blocks: the same filters as matrices, then pairs of different components on full
   sets. A pair that shares several pivots is looked at for the smallest one only, and
   not at all if step 3 did. Only links that join components leave a block.

No pairs are written, and no link between different components is lost.

Defined cases: a null, empty or wordless text has an empty set and is linked with
nothing; fewer words than a gram make one gram; repeated rows are equal sets; rows of
one doc_id with several texts are linked by each text alone; a row with a null doc_id
is kept, unlinked, with component_id null; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, maybe_in, spread_join, table, text_bytes
from .components import components
from .minhash import CELL, cells, confirmed, digest_of, intersections, rows_of_classes, shingle_sets, unpacked, whole_sets

#: Share of the hash space whose grams are counted; all would need five times the input on disk.
COUNTED = 0.35
#: Pieces of the hash space for the suffix filter.
PIECES = 16
#: Of every so many classes one is looked at for frequent grams; frequent: in that share of them, and in FEW at least.
EVERY, FREQUENT, FEW = 64, 1 / 500, 8
#: Frequent grams that are broadcast; more are joined.
MOST_HELD = 1 << 20
#: Classes beyond which a bucket is large: its pivot goes to its classes, wherever they are.
LARGE = 1024


def prefix_size(n, percent: int):
    """Grams of a set of n (a number or a column) of which a similar set shares one."""
    return n - F.ceil(n * percent / 100).cast("bigint") + 1 if hasattr(n, "cast") else n - -(-n * percent // 100) + 1


def needed(a, b, percent: int):
    """Least intersection of similar sets of sizes a and b (arrays)."""
    return -(-percent * (a + b) // (100 + percent))


def sketch(batches: Iterator[pa.RecordBatch], n: int, percent: int, below: np.uint64) -> Iterator[pa.RecordBatch]:
    """doc_id, row, text -> n_shingles, digest, counted, grams (63-bit, ascending), pieces."""
    for batch in batches:
        size, digest, counted, held, pieces = [], [], [], [], []
        for s in shingle_sets(*text_bytes(batch.column("text")), n):
            m = int(np.searchsorted(s, below))
            size.append(len(s))
            digest.append(digest_of(s) if len(s) else None)
            counted.append(m)
            held.append((s[: max(m, prefix_size(len(s), percent) if len(s) else 0)] >> np.uint64(1)).astype(np.int64))
            pieces.append(np.bincount((s >> np.uint64(60)).astype(np.int64), minlength=PIECES).astype(np.int32))
        ends = np.cumsum([0, *map(len, held)]).astype(np.int32)
        flat = np.concatenate(held) if held else np.zeros(0, np.int64)
        per = np.arange(len(size) + 1, dtype=np.int32) * np.int32(PIECES)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("row"), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(counted, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.ListArray.from_arrays(pa.array(per), pa.array(np.concatenate(pieces) if pieces else np.zeros(0, np.int32)))],
            names=["doc_id", "row", "n_shingles", "digest", "counted", "grams", "pieces"],
        )


SKETCH = "doc_id bigint, row bigint, n_shingles bigint, digest binary, counted int, grams array<bigint>, pieces array<int>"


def prefixes(classes: DataFrame, grams: DataFrame, percent: int, below: np.uint64) -> DataFrame:
    """(key, cls, n, pos) of the prefix grams that several classes have; pos: their place in the order, from 0.

    classes: cls, n_shingles, counted; grams: cls, grams.
    """
    rows = grams.select("cls", F.explode("grams").alias("key"))
    some = grams.where(F.pmod(F.xxhash64("cls"), F.lit(EVERY)) == 0)
    least = max(FEW, int(classes.count() / EVERY * FREQUENT))
    often = materialize(some.select(F.explode("grams").alias("key")).groupBy("key").count().where(F.col("count") >= least).select("key"))
    limit = int(below >> np.uint64(1))
    if n := often.count():
        often = F.broadcast(often) if n <= MOST_HELD else often
        rare, frequent = rows.join(often, "key", "left_anti"), rows.join(often, "key", "left_semi")
    else:
        rare, frequent = rows, rows.limit(0)
    shared = rare.withColumn("df", F.count("*").over(Window.partitionBy("key"))).where("df > 1").unionByName(frequent.withColumn("df", F.lit((1 << 62))))
    order = Window.partitionBy("cls").orderBy("late", "df", "key")
    placed = shared.join(classes.select("cls", F.col("n_shingles").alias("n"), "counted"), "cls").withColumn("late", F.col("key") >= limit)
    placed = placed.withColumn("nth", F.row_number().over(order)).withColumn("known", F.count_if(~F.col("late")).over(Window.partitionBy("cls")))
    # grams that occur once come first; those that are not counted follow the counted ones and all belong to the prefix
    pos = F.when(F.col("late"), F.col("counted") + F.col("nth") - F.col("known") - 1).otherwise(F.col("counted") - F.col("known") + F.col("nth") - 1)
    return placed.select("key", "cls", "n", pos.cast("bigint").alias("pos")).where(F.col("pos") < prefix_size(F.col("n"), percent))


def met_pairs(prefix: DataFrame, percent: int) -> DataFrame:
    """(pivot, cls, n, passes): classes and the pivots of their buckets; passes: length and positions allow a link in every bucket."""
    buckets = prefix.groupBy("key").agg(F.min(F.struct("cls", "n", "pos")).alias("p"), F.count("*").alias("size")).where("size > 1")
    buckets = materialize(buckets.select("key", "size", F.col("p.cls").alias("pivot"), F.col("p.n").alias("pn"), F.col("p.pos").alias("pp")))
    # at most one of LARGE rows of the prefixes is a large bucket
    large, small = (buckets.where(c).drop("size") for c in (F.col("size") > LARGE, F.col("size") <= LARGE))
    told = prefix.join(F.broadcast(large), "key", "left")
    both = told.where("pivot IS NOT NULL").unionByName(told.where("pivot IS NULL").select(prefix.columns).join(small, "key"))
    need = F.ceil((F.col("n") + F.col("pn")) * percent / (100 + percent))
    long = 100 * F.least("n", "pn") >= percent * F.greatest("n", "pn")
    room = F.least("pos", "pp") + 1 + F.least(F.col("n") - F.col("pos") - 1, F.col("pn") - F.col("pp") - 1) >= need
    return both.where("cls <> pivot").groupBy("pivot", "cls", "n").agg(F.min(long & room).alias("passes"))


def alike_by_pieces(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (cls, pivot) that pass the suffix filter."""
    one = pairs.join(classes.select("cls", "n_shingles", "pieces"), "cls")
    two = classes.select(F.col("cls").alias("pivot"), F.col("n_shingles").alias("pn"), F.col("pieces").alias("other"))
    two = two.join(pairs.select("pivot").distinct(), "pivot", "left_semi")
    both = spread_join(one, two, "pivot", "cls")
    common = F.aggregate(F.zip_with("pieces", "other", lambda a, b: F.least(a, b)), F.lit(0), lambda a, x: a + x)
    return both.where(common >= F.ceil((F.col("n_shingles") + F.col("pn")) * percent / (100 + percent))).select("cls", "pivot")


def root_of(parent: dict, x: int) -> int:
    while parent.get(x, x) != x:
        parent[x] = parent.get(parent[x], parent[x])
        x = parent[x]
    return x


def joining_pairs(data: pa.Table, percent: int) -> pa.Table:
    """A cell: two blocks of a pivot's classes -> confirmed links that join components."""
    data = data.sort_by([("side", "ascending"), ("cls", "ascending")]).combine_chunks()
    cls, root, side, n = (data.column(c).to_numpy() for c in ("cls", "root", "side", "n_shingles"))
    u, v = [], []
    if len(np.unique(root)) > 1:
        pivot = data.column("pivot")[0].as_py()
        same = data.column("next")[0].as_py() == 0 and data.column("i")[0].as_py() == data.column("j")[0].as_py()
        left = np.flatnonzero(side == 0)
        right = left if same else np.flatnonzero(side == 1)
        lists = {c: [np.asarray(x, np.int64).view(np.uint64) for x in data.column(c).to_pylist()] for c in ("keys", "pivots")}
        pieces = np.array(data.column("pieces").to_pylist(), dtype=np.int32)
        need = needed(n[left][:, None], n[right][None, :], percent)
        open_ = (root[left][:, None] != root[right][None, :]) & (100 * np.minimum(n[left][:, None], n[right][None, :]) >= percent * np.maximum(n[left][:, None], n[right][None, :]))
        if same:
            open_ &= np.arange(len(left))[:, None] < np.arange(len(right))[None, :]
        # pairs that a smaller pivot has, or of which one is the other's pivot
        lower = [x[x < pivot] for x in lists["pivots"]]
        open_ &= intersections([lower[k] for k in left], [lower[k] for k in right]) == 0
        own = [np.array([c], np.uint64) for c in cls]
        open_ &= intersections([own[k] for k in left], [lists["pivots"][k] for k in right]) == 0
        open_ &= intersections([lists["pivots"][k] for k in left], [own[k] for k in right]) == 0
        # prefix and positional filter: shared prefix grams and the longer rest
        rest = -(-n * percent // 100) - 1
        shared = intersections([lists["keys"][k] for k in left], [lists["keys"][k] for k in right])
        open_ &= (shared > 0) & (shared + np.maximum(rest[left][:, None], rest[right][None, :]) >= need)
        common = np.zeros(open_.shape, np.int32)
        for k in range(PIECES):
            common += np.minimum(pieces[left, k][:, None], pieces[right, k][None, :])
        open_ &= common >= need
        sets, parent = unpacked(data.column("items")), {}
        for i, j in zip(*np.nonzero(open_), strict=True):
            x, y = left[i], right[j]
            a, b = root_of(parent, int(root[x])), root_of(parent, int(root[y]))
            if a != b and np.intersect1d(sets[x], sets[y], assume_unique=True).size >= need[i, j]:
                parent[a] = b
                u.append(int(cls[x]))
                v.append(int(cls[y]))
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def jaccard_classes(docs: DataFrame, shingle: int = 5, percent: int = 80, counted: float = COUNTED) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row of docs, linked by 100 * intersection >= percent * union."""
    below = np.uint64(int(counted * 2.0**64) if counted < 1 else (1 << 64) - 1)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    numbered = docs.withColumn("row", F.monotonically_increasing_id())
    sketched = materialize(numbered.mapInArrow(lambda it: sketch(it, shingle, percent, below), SKETCH))
    linked = sketched.where("doc_id IS NOT NULL AND digest IS NOT NULL")
    first = linked.groupBy("n_shingles", "digest").agg(F.min(F.struct("doc_id", "row")).alias("f")).select("digest", F.col("f.doc_id").alias("rep"), F.col("f.row").alias("row"))
    chosen = linked.select("row", "n_shingles", "counted", "pieces").join(first, "row")
    classes = materialize(chosen.select(F.col("row").alias("cls"), "n_shingles", "digest", "rep", "counted", "pieces"))
    # grams of copies are left out; what is no copy for certain is not shuffled for that
    copies = materialize(linked.select(F.col("row").alias("cls")).join(classes.select("cls"), "cls", "left_anti"))
    told = maybe_in(linked.select(F.col("row").alias("cls"), "grams"), copies, "cls")
    grams = told.where("NOT maybe").union(told.where("maybe").join(classes.select("cls"), "cls", "left_semi")).drop("maybe")

    prefix = materialize(prefixes(classes, grams, percent, below))
    member = materialize(met_pairs(prefix, percent))
    met = member.select("cls").union(member.select("pivot")).distinct()
    wanted = materialize(classes.join(met, "cls", "left_semi").select("cls", "digest", F.col("rep").alias("doc_id")))
    texts = maybe_in(docs.where("doc_id IS NOT NULL"), wanted, "doc_id").where("maybe").join(wanted, "doc_id")
    # a class that comes from several tasks is there several times, which only repeats its links
    sets = materialize(texts.select("cls", "digest", "text").mapInArrow(lambda it: whole_sets(it, shingle), "cls bigint, items binary"))
    passed = alike_by_pieces(member.where("passes").select("cls", "pivot"), classes, percent)
    links = materialize(confirmed(passed, sets, percent))
    roots = components(links)

    placed = member.select("pivot", "cls", F.col("n").alias("n_shingles")).join(roots, F.col("cls") == F.col("node"), "left")
    grid = materialize(cells(placed.select("pivot", "cls", "n_shingles", F.coalesce("root", "cls").alias("root")), percent))
    if not grid.isEmpty():
        used = grid.select("cls").distinct()
        keys = prefix.join(used, "cls", "left_semi").groupBy("cls").agg(F.collect_list("key").alias("keys"))
        pivots = member.join(used, "cls", "left_semi").groupBy("cls").agg(F.collect_list("pivot").alias("pivots"))
        facts = classes.select("cls", "n_shingles", "pieces").join(keys, "cls").join(pivots, "cls").join(sets, "cls")
        tried = grid.join(facts, "cls").groupBy(*CELL)
        late = materialize(tried.applyInArrow(lambda t: joining_pairs(t, percent), "u bigint, v bigint"))
        if not late.isEmpty():
            roots = components(links.union(late))
    return rows_of_classes(sketched, classes, roots).select("doc_id", "n_shingles", "component_id")


def op12_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"), shingle=5, percent=80)
