"""Near-duplicates, passages and substrings against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from pagelathe.llm import components, minhash, passages, shards, suffixes

from .helpers import WORD, corpus, edited, mixed, prose


def shingles(text, n=4):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)] if words else [])


def classes(texts, n=4, percent=80):
    sets = {i: shingles(t, n) for i, t in texts}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in sets.items():
        for j, b in sets.items():
            if j < i and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), top(i)) for i, s in sets.items()}


def near_group(seed=5):
    """Copies of one text with so many edits that most are linked with some others only."""
    rng = random.Random(seed)
    text = prose(rng, 300, 10**6)
    return [(i, edited(rng, text, rng.choice([0.005, 0.02, 0.03, 0.04]))) for i in range(60)]


@pytest.mark.parametrize("texts", [mixed(), near_group()])
def test_near_duplicates(spark, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(corpus(spark, texts), 4).collect()}
    assert got == classes(texts)


def test_near_duplicates_of_odd_tables(spark):
    assert minhash.near_duplicates(corpus(spark, [])).count() == 0
    got = minhash.near_duplicates(corpus(spark, [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (2, "A b c d e F"), (1, None)])).collect()
    assert len(got) == 5
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(None, None, True), (3, 2, False), (2, 2, True), (1, 1, True)}


def test_one_doc_id_with_several_texts(spark):
    rng = random.Random(3)
    a, b = prose(rng, 100, 10**6), prose(rng, 100, 10**6)
    rows = [(7, a), (7, b), (9, a + " x"), (11, b + " y"), (13, b + " z")]
    got = minhash.near_duplicates(corpus(spark, rows)).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(7, 7, True), (7, 7, True), (9, 7, False), (11, 7, False), (13, 7, False)]
    assert len({r.cluster for r in got}) == 2


def test_sizes_apart(spark):
    """Links across zones of sizes, with blocks of a few classes."""
    rng = random.Random(15)
    base = [f"v{rng.randrange(10**6)}" for _ in range(400)]
    texts = [(i, " ".join(base[: 400 - 9 * (i % 23)] + [f"u{i}x{k}" for k in range(rng.randrange(40))])) for i in range(70)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(corpus(spark, texts), 4).collect()}
    assert got == classes(texts)


def test_block_products():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 400, rng.integers(0, 90))).astype(np.uint64) for _ in range(30)]
    got = minhash.intersections(sets[:10], sets[10:])
    assert (got == [[len(np.intersect1d(a, b)) for b in sets[10:]] for a in sets[:10]]).all()


def test_components(spark):
    pairs = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (5, 5)]
    got = components.components(spark.createDataFrame(pairs, "u bigint, v bigint"))
    assert {(r.node, r.root) for r in got.collect()} == {(x, 1) for x in (1, 2, 3, 7, 8, 9)} | {(20, 20), (21, 20)}


def without_passages(texts, n=50):
    words = {i: WORD.findall(t or "") for i, t in texts}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - n + 1):
            first.setdefault(tuple(words[i][k : k + n]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < i:
                gone[k : k + n] = [True] * n
        out[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
    return out


def test_passages(spark):
    texts = mixed(2)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in passages.drop_repeated_passages(corpus(spark, texts)).collect()}
    assert got == without_passages(texts)
    assert sum(x[1] for x in got.values()) > 400
    assert passages.drop_repeated_passages(corpus(spark, [])).count() == 0


def test_cover_meets_every_shift():
    held = np.flatnonzero(passages.COVER)
    assert {(a - b) % passages.PERIOD for a in held for b in held} == set(range(passages.PERIOD))


def without_bytes(texts, n=100):
    seen, out = set(), {}
    for i, t in sorted(texts):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - n + 1):
            key = b[k : k + n]
            if key in seen:
                gone[k : k + n] = True
            seen.add(key)
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out[i] = (len(b), int(gone.sum()), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize(("array_bytes", "unsplit"), [(suffixes.ARRAY_BYTES, suffixes.UNSPLIT), (400, suffixes.UNSPLIT), (400, -2), (5000, -30)])
def test_substrings(spark, array_bytes, unsplit):
    texts = mixed(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.drop_repeated_bytes(corpus(spark, texts), array_bytes=array_bytes, unsplit=unsplit).collect()}
    assert got == without_bytes(texts)


def test_equal_and_null_doc_ids(spark, monkeypatch):
    monkeypatch.setattr(shards, "parts_for", lambda *_: 7)
    rng = random.Random(11)
    shared = prose(rng, 70, 5000)
    texts = [(2, shared), (2, shared + " " + prose(rng, 10)), (1, prose(rng, 60) + " " + shared), (5, shared), (5, shared)]
    texts += [(None, prose(rng, 5 + k) + " " + shared) for k in range(4)] + [(None, None), (None, ""), (3, prose(rng, 60))]
    words = {}
    for r in passages.drop_repeated_passages(corpus(spark, texts)).collect():
        words.setdefault(r.doc_id, []).append((r.n_words, r.n_removed))
    assert words[1] == [(130, 0)] and words[3] == [(60, 0)]
    assert sorted(words[2]) == [(70, 70), (80, 70)] and words[5] == [(70, 70)] * 2
    assert sorted(words[None]) == [(0, 0), (0, 0)] + [(75 + k, 70) for k in range(4)]
    # a repeated row, in the order of texts, is an earlier document here; of the null ones each but none before the numbered
    raw = suffixes.drop_repeated_bytes(corpus(spark, texts)).collect()
    size = len(shared.encode())
    assert {r.doc_id: r.n_removed for r in raw if r.doc_id in (1, 3)} == {1: 0, 3: 0}
    assert all(r.n_removed >= size for r in raw if r.doc_id in (2, 5)) and sorted(r.n_removed >= size for r in raw if r.doc_id is None) == [False] * 2 + [True] * 4
    twice = [(None, prose(rng, 40, 10**6))] * 3
    assert sorted(r.n_removed > 0 for r in suffixes.drop_repeated_bytes(corpus(spark, twice)).collect()) == [False, True, True]
    assert sum(r.n_removed for r in passages.drop_repeated_passages(corpus(spark, twice)).collect()) == 0


def test_exchange_grows_in_proportion(spark, monkeypatch):
    """Keys sent by many shards: one row a key and shard, however many shards there are."""
    rng = random.Random(12)
    texts = [(i, prose(rng, 120, 10**6)) for i in range(80)]
    sent = []
    for n, rows in ((4, texts[:20]), (16, texts)):
        monkeypatch.setattr(shards, "parts_for", lambda *_, n=n: n)
        held = shards.sharded(corpus(spark, rows)).groupBy("shard")
        sent.append((held.applyInArrow(lambda t: passages.send_anchors(t, 50), shards.KEYS).count(), held.applyInArrow(lambda t: suffixes.send_anchors(t, 100), shards.KEYS).count()))
    assert all(3.8 < b / a < 4.2 for a, b in zip(*sent, strict=True))


def test_substrings_of_empty_table(spark):
    assert suffixes.drop_repeated_bytes(corpus(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_suffix_array_and_common_prefixes(seed):
    rng = np.random.default_rng(seed)
    size = rng.integers(1, 60, 12)
    flat = rng.integers(97, 97 + 1 + seed, size.sum()).astype(np.uint8)
    begin = np.cumsum(size) - size
    end = np.repeat(begin + size, size)
    sa, inverse = suffixes.suffix_array(flat, end)
    text = [flat[i : end[i]].tobytes() for i in range(len(flat))]
    assert sa.tolist() == sorted(range(len(flat)), key=lambda i: (text[i], i))
    common = suffixes.kasai(flat, begin, size, sa, inverse)
    for k in range(1, len(sa)):
        a, b = text[sa[k - 1]], text[sa[k]]
        assert common[k] == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def test_many_arrays_of_one_anchor():
    """Windows of one anchor spread over many suffix arrays are merged by binary search."""
    rng = random.Random(4)
    core = prose(rng, 30)[:60]
    texts = [(i, prose(rng, 3)[: rng.randrange(10, 60)] + core + prose(rng, 12)[:50] + rng.choice(["", core * 3])) for i in range(40)]
    table = pa.table({"doc_id": [i for i, _ in texts], "text": [t for _, t in texts], "shard": pa.array([0] * len(texts), pa.int32())})
    sent = suffixes.send_anchors(table, 100)
    again = sent.filter(pc.greater(sent.column("n"), 1))
    replies = pa.table({"shard": again.column("shard"), "key": again.column("key"), "total": again.column("n").cast(pa.int64())})
    for array_bytes, unsplit in ((150, 13), (1 << 20, 13), (150, -9)):
        tried = suffixes.send_contexts(table, replies, 100, unsplit).sort_by([(c, "ascending") for c in ("key", "context", "owner", "shard", "start")])
        found = pa.Table.from_batches(list(suffixes.find_repeats(iter(tried.to_batches(max_chunksize=7)), 100, array_bytes)))
        got = suffixes.drop_bytes(table, found, False).to_pylist()
        assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == without_bytes(texts)
