"""Periodic runs, the n-gram join and centroid clusters against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagelathe.llm import centroids, common, minhash, periods, prefixes

from .helpers import WORD, corpus, edited, mixed, prose
from .test_dedup import classes, near_group


def brute_runs(words, least=12):
    """(start, length, period) of all runs, by every period."""
    n, best = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j - i >= p and j - i + p >= least:
                best.setdefault((i, j + p), p)
            i = j + 1
    return sorted((a, b - a, p) for (a, b), p in best.items())


def brute_row(doc_id, text, rewrite, least=12):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if rewrite and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words, least)
    gone = {i for a, size, p in runs for i in range(a + p, a + size)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    told = "".join(f"{a},{size},{p}\n" for a, size, p in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *((*top, 1000 * top[1] // top[2]) if top else (None,) * 4), hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def periodic(seed):
    """Texts of few letters, of repeated phrases that overlap, and of phrases inside phrases."""
    rng = random.Random(seed)
    texts = ["a " * 50, "a b " * 9 + "a", "a b c " * 4, "a b c " * 3, " ".join("ab" if k % 2 else "a b" for k in range(40)), "x y " * 6 + "z " + "x y " * 6]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randrange(80))) for _ in range(25)]
    texts += [" ".join(rng.choice("abc") for _ in range(7)) * rng.randrange(1, 6) + " " + prose(rng, 20, 9) for _ in range(10)]
    inner = " ".join(["p q"] * 7)
    texts += [" ".join([inner + " r"] * 4), prose(rng, 40, 10**6) + " " + " ".join([prose(rng, 30, 10**6)] * 3)]
    word = ["a", "b"]
    for _ in range(6):
        word.append(word[-1] + " " + word[-2])
    return [*texts, word[-1]]


@pytest.mark.parametrize("rewrite", [False, True])
def test_periodic_runs(spark, monkeypatch, rewrite):
    texts = [(100 + i, t) for i, t in enumerate(periodic(3))] + [(i, None if t and len(t) > 20_000 else t) for i, t in mixed(4)] + [(None, "a b " * 20), (7, "a b " * 20), (7, "a b " * 20)]
    monkeypatch.setattr(periods, "PAIRS", 50)
    got = periods.periodic_runs(corpus(spark, texts), rewrite=rewrite)
    told = [(r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in got.collect()]
    order = lambda rows: sorted(rows, key=str)
    assert order(told) == order([brute_row(i, t, rewrite) for i, t in texts])
    for r in got.where("n_runs > 0").collect():
        assert len(r.runs) == r.n_runs
        assert hashlib.sha256(r.collapsed.encode()).hexdigest() == r.collapsed_sha256


def test_shorter_runs_and_small_arrays(monkeypatch):
    """Other least lengths; texts cut over several arrays; pairs a few at a time."""
    texts = periodic(8)
    monkeypatch.setattr(periods, "TOGETHER", 200)
    monkeypatch.setattr(periods, "PAIRS", 7)
    for least in (2, 5, 13):
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
        rows = [tuple(r.values())[:8] for b in periods.scan(iter([batch]), least, False, False) for r in b.to_pylist()]
        assert rows == [brute_row(i, t, False, least) for i, t in enumerate(texts)]


def test_one_word_very_often():
    batch = pa.RecordBatch.from_arrays([pa.array([1], pa.int64()), pa.array(["ab " * 300_000])], names=["doc_id", "text"])
    (row,) = next(periods.scan(iter([batch]), 12, False, True)).to_pylist()
    assert (row["n_runs"], row["start"], row["length"], row["period"], row["collapsed"]) == (1, 0, 300_000, 1, "ab")


def test_periodic_runs_of_empty_table(spark):
    assert periods.periodic_runs(corpus(spark, [])).count() == 0


# --- n-gram join ----------------------------------------------------------------


def band_group(seed=6, n=90):
    """Texts of one family that are similar at 0.7 to 0.9: many buckets, few links."""
    rng = random.Random(seed)
    text = prose(rng, 150, 10**6)
    return [(i, edited(rng, text, rng.choice([0.01, 0.02, 0.03]))) for i in range(n)]


@pytest.mark.parametrize("texts", [mixed(2), near_group(7), band_group()])
@pytest.mark.parametrize("counted", [0.0, prefixes.COUNTED, 1.0])
def test_jaccard_join(spark, texts, counted):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in prefixes.jaccard_classes(corpus(spark, texts), counted=counted).collect()}
    assert got == classes(texts, 5)


def test_frequent_grams(spark, monkeypatch):
    """All grams of a family are frequent: none is counted, all links stay."""
    monkeypatch.setattr(prefixes, "EVERY", 1)
    monkeypatch.setattr(prefixes, "MOST_HELD", 10)
    texts = near_group(9) + [(1000 + i, t) for i, t in band_group(10)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in prefixes.jaccard_classes(corpus(spark, texts)).collect()}
    assert got == classes(texts, 5)


def test_blocks_join_what_pivots_miss():
    """A cell of pairs that no pivot has confirmed: only links that join components leave it."""
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(1, 1 << 60, 200).astype(np.uint64))
    sets = [np.unique(np.concatenate([np.delete(base, rng.integers(0, len(base), k)), rng.integers(1, 1 << 60, k).astype(np.uint64)])) for k in (2, 3, 4, 5, 60, 70)]
    rows = [
        {"pivot": 99, "zone": 0, "i": 0, "next": 0, "j": 0, "side": 0, "cls": c, "root": c if c != 1 else 0, "n_shingles": len(s), "keys": (s >> np.uint64(1)).astype(np.int64).tolist()[: len(s) - -(-len(s) * 80 // 100) + 1], "pivots": [99], "pieces": np.bincount((s >> np.uint64(60)).astype(int), minlength=16).tolist(), "items": s.tobytes()}
        for c, s in enumerate(sets)
    ]
    table = pa.Table.from_pylist(rows)
    found = prefixes.joining_pairs(table, 80).to_pylist()
    alike = {(a, b) for a in range(6) for b in range(a + 1, 6) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))}
    assert {(r["u"], r["v"]) for r in found} <= alike
    assert len(found) == 2  # 0 and 1 are one already; 2 and 3 join them
    for skipped in ({"pivots": [99, 7]}, {"pivots": [99, *range(6)]}):
        again = pa.Table.from_pylist([r | skipped for r in rows])
        assert prefixes.joining_pairs(again, 80).num_rows == 0


def test_jaccard_join_of_odd_tables(spark):
    assert prefixes.jaccard_classes(corpus(spark, [])).count() == 0
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (2, "A b c d e F"), (1, None), (5, "  ")]
    got = prefixes.jaccard_classes(corpus(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == sorted([(None, 2, None), (3, 2, 2), (3, 2, 2), (2, 2, 2), (1, 0, 1), (5, 0, 5)], key=str)


def met_by_hand(rows):
    """(pivot, cls): the smallest class of each key with all others of it."""
    keys = {}
    for key, cls, _, _ in rows:
        keys.setdefault(key, []).append(cls)
    return {(min(c), x) for c in keys.values() for x in c if x != min(c)}


@pytest.mark.parametrize("large", [1024, 3])
def test_buckets_meet_without_copies_of_them(spark, monkeypatch, large):
    """A bucket's pivot is told once, not once for each task that may ask; large buckets are not brought together."""
    monkeypatch.setattr(prefixes, "LARGE", large)
    rng = random.Random(12)
    rows = [(k, c, 100, rng.randrange(20)) for k in range(40) for c in rng.sample(range(200), 1 + k % 6)] + [(99, c, 100, 0) for c in range(150)]
    found = prefixes.met_pairs(spark.createDataFrame(rows, "key bigint, cls bigint, n bigint, pos bigint"), 80)
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    got = found.collect()
    assert {(r.pivot, r.cls) for r in got} == met_by_hand(rows) and len(got) == len(met_by_hand(rows))


@pytest.mark.parametrize("most", [common.MOST_FILTERED, 10])
def test_filter_passes_all_that_meet(spark, monkeypatch, most):
    monkeypatch.setattr(common, "MOST_FILTERED", most)
    rows, keys = spark.range(5000).select(F.col("id").alias("k")), spark.range(0, 5000, 50).select(F.col("id").alias("k"))
    got = {r.k: r.maybe for r in common.maybe_in(rows, keys, "k").collect()}
    assert len(got) == 5000 and all(got[k] for k in range(0, 5000, 50))
    assert sum(got.values()) < 800 or most == 10
    assert common.maybe_in(rows, keys.limit(0), "k").where("maybe").count() == 0 or most == 0


def test_sets_are_made_once_a_class():
    """Rows of one class give one set, so that no shuffle has to drop the others."""
    items = next(minhash.shingle_sets(*common.text_bytes(pa.array(["a b c d e f"])), 5))
    batch = pa.RecordBatch.from_pydict({"cls": [7, 7, 8], "digest": [minhash.digest_of(items)] * 3, "text": ["a b c d e f"] * 3})
    assert [x for b in minhash.whole_sets(iter([batch, batch]), 5) for x in b.column("cls").to_pylist()] == [7, 8]


# --- centroid clusters ------------------------------------------------------------


def brute_clusters(rows, k, rounds, scale=64, size=4):
    kept = [(i, [int(np.floor(float(x) * scale)) if abs(x) < 1e300 else int(x) * scale for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centres = [v for _, v in named[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for turn in range(rounds + 1):
        own = [min(range(len(centres)), key=lambda c: (far(v, centres[c]), c)) for _, v in kept]
        if turn < rounds:
            groups = [[v for (_, v), c in zip(kept, own, strict=True) if c == k_] for k_ in range(len(centres))]
            centres = [[sum(x) // len(g) for x in zip(*g, strict=True)] if g else c for g, c in zip(groups, centres, strict=True)]
    apart = [far(v, centres[c]) for (_, v), c in zip(kept, own, strict=True)]
    most = (1 << 63) - 1
    within = [sum(d for d, o in zip(apart, own, strict=True) if o == c) for c in range(len(centres))]
    return sorted(((i, c, min(d, most), min(within[c], most), min(sum(apart), most), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for (i, _), c, d in zip(kept, own, apart, strict=True)), key=str)


def cluster_rows(spark, rows, k, rounds, parts=3):
    vectors = spark.createDataFrame([(i, v, 1, 2.0, "x") for i, v in rows], "vec_id bigint, embedding array<double>, cluster int, distance double, v string").repartition(parts)
    got = centroids.centroid_clusters(vectors, k, rounds, size=4)
    return sorted(map(tuple, got.collect()), key=str)


def some_vectors(seed, n=300):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([0.0, 0.5, rng.gauss(0, 1)]) for _ in range(4)]) for i in range(n)]
    nan, inf = float("nan"), float("inf")
    return rows + [(n, None), (n + 1, [1.0]), (n + 2, [nan, 0.0, 0.0, 0.0]), (n + 3, [None, 0.0, 0.0, 0.0]), (n + 4, [inf, 0.0, 0.0, 0.0]), (3, [9.0, 9.0, 9.0, 9.0]), (3, [9.0, 9.0, 9.0, 9.0]), (None, [0.1, 0.2, 0.3, 0.4])]


@pytest.mark.parametrize(("k", "rounds"), [(5, 3), (16, 6), (1, 2)])
def test_clusters(spark, k, rounds):
    rows = some_vectors(k)
    assert cluster_rows(spark, rows, k, rounds) == brute_clusters(rows, k, rounds)


def test_clusters_with_ties_and_few_vectors(spark):
    rows = [(i, [float(i % 2), 0.0, 0.0, 0.0]) for i in range(20)]
    assert cluster_rows(spark, rows, 6, 3) == brute_clusters(rows, 6, 3)
    assert cluster_rows(spark, rows[:3], 16, 3) == brute_clusters(rows[:3], 16, 3)
    assert cluster_rows(spark, [(1, None)], 4, 2) == []


def test_clusters_of_large_numbers(spark):
    """Components far beyond 64 bits stay exact; distances beyond a long are given as the largest one."""
    rng = random.Random(2)
    rows = [(i, [rng.choice([1.0, 2.0**21, 2.0**40, -(2.0**75)]) * rng.randrange(1, 9) + rng.randrange(5) for _ in range(4)]) for i in range(60)]
    assert cluster_rows(spark, rows, 5, 3) == brute_clusters(rows, 5, 3)
    rows = [(i, [2.0**19 * rng.randrange(1, 9) + rng.random() for _ in range(4)]) for i in range(60)]
    assert cluster_rows(spark, rows, 5, 3) == brute_clusters(rows, 5, 3)


def test_bounds_spare_scans(spark):
    """Vectors near their centroids are settled by the bounds alone, and nothing changes by it."""
    rng = np.random.default_rng(5)
    centre = rng.integers(-50, 50, (4, 4))
    points = (centre * 64).tolist()
    v = np.repeat(np.array(points), 50, axis=0) + rng.integers(-3, 4, (200, 4))
    none = pa.array(np.full(200, -1, np.int32))
    batch = pa.RecordBatch.from_arrays([pa.array(range(200), pa.int64()), centroids.packed(v), none, none, pa.array(np.zeros(200)), pa.array(np.zeros(200))], names=["vec_id", "v", "cluster", "was", "upper", "lower"])
    first = next(centroids.assign(iter([batch]), centroids.Centroids(points, [0.0] * 4), 4))
    moved = centroids.Centroids([[x + 1 for x in p] for p in points], [2.0] * 4)
    moved.scan = None  # no full scan is needed
    second = next(centroids.assign(iter([first]), moved, 4))
    assert second.column("cluster").equals(first.column("cluster"))
