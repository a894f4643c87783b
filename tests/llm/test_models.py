"""Top-k search, pieces, quality and the pipeline."""

import math
import random
import re
from collections import Counter
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagelathe.llm import pieces, quality, topk
from pagelathe.llm.common import LOWER, words

from .helpers import EDGES, WORD, corpus, mixed, prose


def test_words_of_bytes():
    texts = [t or "" for t in EDGES]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.cumsum([0, *(len(t.encode()) for t in texts)])
    hashed, start, end, at = words(LOWER[raw], off)
    listed = [raw[a:b].tobytes().decode() for a, b in zip(start, end, strict=True)]
    assert [listed[a:b] for a, b in zip(at[:-1], at[1:], strict=True)] == [WORD.findall(t) for t in texts]
    same = {}
    assert all(same.setdefault(w.lower() if w.isascii() else w, h) == h for w, h in zip(listed, hashed.tolist(), strict=True))


def test_top_k(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(40)]) for i in range(300)]
    rows += [(300 + i, rows[20][1]) for i in range(40)]
    rows += [(400, None), (420, []), (440, [1.0, None] + [0.0] * 38), (460, [math.nan] * 40), (480, [0.5] * 7), (500, [math.inf] * 40), (None, [0.1] * 40)]
    got = topk.top_k(spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<double>, dim int")).collect()
    want = []
    for q, a in rows[:340]:
        if q % 20 == 0:
            score = sorted((-sum(math.floor(64 * x) * math.floor(64 * y) for x, y in zip(a, b, strict=True)), i) for i, b in rows[:340] if i != q)
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(score[:20])]
    assert sorted(map(tuple, got)) == sorted(want)
    assert topk.top_k(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


LISTED = [("<unk>", 0.0), ("<s>", 0.0), *[(f"<0x{b:02X}>", 0.0) for b in range(256)], *[(p, -float(k)) for k, p in enumerate(["▁", "a", "b", "ab", "▁a", "ba", "aba", "▁ab", "bb", "▁▁", "c"])]]


def every_path(vocabulary, chunk):
    """All segmentations of a chunk with their scores."""
    if not chunk:
        return [(0.0, ())]
    out = []
    for k in range(1, len(chunk) + 1):
        if hit := vocabulary.id.get(chunk[:k]):
            out += [(hit[1] + s, (hit[0], *ids)) for s, ids in every_path(vocabulary, chunk[k:])]
        elif k == 1:
            out += [(vocabulary.unknown + s, (*vocabulary.spell(chunk[0]), *ids)) for s, ids in every_path(vocabulary, chunk[1:])]
    return out


@pytest.mark.parametrize("seed", range(6))
def test_n_best(seed):
    rng = random.Random(seed)
    v = pieces.Pieces(LISTED, 2, 2)
    text = "".join(rng.choice("aab cñ") for _ in range(9))
    paths = sorted((-s for s, _ in every_path(v, " " + text)))
    for n in (1, 2, 5, 12):
        found = v.encode(text, n)
        assert [-s for s, _ in found] == paths[:n]
        assert all(v.decode(ids.tolist()) == text for _, ids in found)
        assert len({ids.tobytes() for _, ids in found}) == len(found)
        scores = dict((ids, s) for s, ids in every_path(v, " " + text))
        assert all(scores[tuple(ids.tolist())] == s for s, ids in found)


@pytest.mark.parametrize("listed", [LISTED, None])
def test_lattice_equals_pieces(listed):
    v = pieces.Pieces(listed, 2, 2) if listed else pieces.Pieces.load(pieces.MODEL)
    rng = random.Random(8)
    texts = [t or "" for t in EDGES] + ["".join(rng.choice("aaabbc  ñ漢▁\n😀") for _ in range(rng.randrange(60))) for _ in range(300)] + [t or "" for _, t in mixed(9)]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.cumsum([0, *(len(t.encode()) for t in texts)])
    for a, b, ids, n_ids, best, second, right in pieces.Lattice(v).encode_texts(raw, off):
        ends = np.cumsum(n_ids)
        for i in range(a, b):
            want = v.encode(texts[i], 2)
            got = ids[ends[i - a] - n_ids[i - a] : ends[i - a]]
            assert want[0][1].tolist() == got.tolist() and want[0][0] == best[i - a] and right[i - a], texts[i]
            assert (want[1][0] if len(want) > 1 else -np.inf) == second[i - a], texts[i]


def test_round_trip(spark):
    texts = [*EDGES, "a▁b ▁ ▁▁", "  two  blanks ", "tab\tand\r\nline", "  \x00 x"]
    docs = corpus(spark, list(enumerate(texts)))
    encoded = pieces.encode(docs).cache()
    assert {r.doc_id: r.text for r in pieces.decode(encoded).collect()} == dict(enumerate(texts))
    rows = {r.doc_id: r for r in encoded.collect()}
    assert all(r.round_trip is (None if texts[i] is None else True) for i, r in rows.items())
    assert rows[0].pieces is None and rows[1].pieces == []


@pytest.mark.parametrize("listed", [LISTED, None])
def test_all_segmentations(listed):
    v = pieces.Pieces(listed, 2, 2) if listed else pieces.Pieces.load(pieces.MODEL)
    rng = random.Random(4)
    texts = ["", "a", "▁"] + ["".join(rng.choice("aaabbc  ñ漢▁\n😀") for _ in range(rng.randrange(12))) for _ in range(60)] + ["the same words and others"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.cumsum([0, *(len(t.encode()) for t in texts)])
    for n in (1, 2, 3, 7):
        for a, b, ranks, right in pieces.Lattice(v).encode_n(raw, off, n):
            assert right.all()
            ends = [np.cumsum(k) for _, k, _ in ranks]
            for i in range(a, b):
                got = [(s[i - a], x[e[i - a] - k[i - a] : e[i - a]].tolist()) for (x, k, s), e in zip(ranks, ends, strict=True) if s[i - a] > -np.inf]
                want = v.encode(texts[i], n)
                assert [s for s, _ in got] == [s for s, _ in want], texts[i]
                assert len({tuple(x) for _, x in got}) == len(got)
                assert all(v.decode(x) == texts[i] for _, x in got)
                if n <= 2:
                    assert [x for _, x in got] == [x.tolist() for _, x in want], texts[i]


def test_other_segmentations(spark):
    texts = [*EDGES[:6], "two words", "a▁b ▁ ▁▁"]
    for n in (2, 4):
        rows = pieces.encode(corpus(spark, list(enumerate(texts))), n=n).cache()
        assert all(r.others is None if texts[r.doc_id] is None else len(r.others) == len(r.scores) - 1 for r in rows.collect())
        more = pieces.decode(rows.select("doc_id", F.explode("others").alias("pieces"))).collect()
        assert len(more) > 4 and all(r.text == texts[r.doc_id] for r in more)


def labelled(spark, seed=2, n=900):
    rng = random.Random(seed)
    texts, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        t = prose(rng, 60, 500)
        if bad:
            t = " ".join(rng.choice([w, w, w, w, rng.choice(["vile", "nasty", "rotten"])]) for w in t.split())
        texts.append((i, t))
        if i % 3:
            labels.append((i, 1, int(bad)))
    return texts, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_quality(spark):
    texts, labels = labelled(spark)
    got = {r.doc_id: r for r in quality.resample(corpus(spark, texts), labels).collect()}
    held_out = [i for i in range(900) if i % 3 == 0]
    wrong = sum(got[i].kept == (i % 5 == 0) for i in held_out)
    assert wrong <= 0.03 * len(held_out)
    assert len(got) == len(texts)


def test_quality_of_odd_tables(spark):
    docs = corpus(spark, [*enumerate(EDGES), (None, "x y"), (3, "one")])
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert [r.kept for r in quality.resample(docs, none).collect()] == [True] * (len(EDGES) + 2)
    assert quality.resample(corpus(spark, []), none).count() == 0


def test_kth_largest(spark):
    rng = random.Random(3)
    keys = [rng.randrange(-(1 << 50), 1 << 50) for _ in range(500)] + [7] * 50 + [-1, 0]
    df = spark.createDataFrame([(k,) for k in keys], "key bigint")
    for k in (1, 2, 250, 552):
        assert quality.kth_largest(df, k) == sorted(keys, reverse=True)[k - 1]
    assert quality.kth_largest(df, 0) is None


ODD = ["_row", "_weight", "_mark", "_spans", "_done", "key", "whole", "row", "cluster", "a.b", "n`c", "two words"]


def written(spark, folder, texts, labels, items):
    """Tables for the pipeline; documents with columns of odd names."""
    docs = corpus(spark, texts).drop("row", "key")
    for c in ODD:
        docs = docs.withColumn(c, F.lit(1))
    docs.write.parquet(str(folder / "documents.parquet"))
    labels.write.parquet(str(folder / "labels.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(folder / "benchmark.parquet"))
    return spark.read.parquet(str(folder / "documents.parquet"))


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as p

    rng = random.Random(6)
    texts, labels = labelled(spark, 6, 300)
    item = prose(rng, 30, 10**6)
    mail = "mail me at a.b@c.org or +1 (386) 555-3733 now " + prose(rng, 40, 500)
    texts += [(300, texts[1][1]), (301, prose(rng, 40, 500) + " " + item), (302, mail), (303, None), (304, ""), (305, prose(rng, 60_000, 500))]
    texts += [(2, texts[2][1])] * 3 + [(None, prose(rng, 40, 500) + " " + item), (None, prose(rng, 40, 500))]
    docs = written(spark, tmp_path, texts, labels, [(1, item)])
    left = docs
    for name, stage in p.STAGES[:-1]:
        left = stage(spark, left, str(tmp_path))
        assert left.columns == docs.columns, name
    rows = left.collect()
    kept = {r.doc_id: r for r in rows}
    assert not {300, 301} & set(kept) and 1 in kept
    assert [r.doc_id for r in rows].count(2) == 1 and [r.doc_id for r in rows].count(None) == 1
    assert kept[302].text.startswith("mail me at <EMAIL> or <PHONE> now ") and kept[302].n_chars == len(kept[302].text)
    assert {303, 304, 305} <= set(kept) and kept[305].text == texts[305][1]
    assert sorted(map(str, p.mask_by_join(docs).collect())) == sorted(map(str, p.mask_personal_data(spark, docs, str(tmp_path)).collect()))
    out = p.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.select("doc_id").collect()} == set(kept)
    assert out.where(~F.col("round_trip")).count() == 0 and out.where("doc_id = 1 AND size(others) = 3").count() == 1


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline as p

    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    docs = written(spark, tmp_path, [], none, [])
    for name, stage in p.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0 and (name == p.STAGES[-1][0] or out.columns == docs.columns), name


def spelt_features(text):
    """The n-grams of a text, written out: tokens, pairs of tokens and runs of repeats."""
    found = re.findall("[0-9A-Za-z\x80-\U0010ffff]+|[^0-9A-Za-z\x80-\U0010ffff \t\n\x0b\x0c\r]+", text)
    parts = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in found]
    said = ["<again>" if i and parts[i] == parts[i - 1] else t for i, t in enumerate(parts)]
    longest = max((len(x) for x in re.findall("a+", "".join("a" if t == "<again>" else "-" for t in said))), default=1)
    return {(t,) for t in said} | set(pairwise(said)) | {("run", k, k) for k in range(1, longest.bit_length())}


def brute_weights(texts, labels):
    """Weights by plain dictionaries over spelt n-grams."""
    found = [spelt_features(t) for t in texts]
    good = {i for i, q, bad in labels if q == 1 and not bad}
    every, target = Counter(b for f in found for b in f), Counter(b for i, f in enumerate(found) if i in good for b in f)
    median = lambda x: sorted(x)[(len(x) - 1) // 2]
    scale = median([target[b] / n for b, n in every.items() if n >= median(every.values())])
    out = []
    for f in found:
        total = 0.0
        for b in f:
            expected = every[b] * scale
            ratio = math.log((target[b] + quality.SMOOTH) / (expected + quality.SMOOTH))
            total += math.copysign(max(0.0, abs(ratio) - quality.NOISE / math.sqrt(expected + 1)), ratio)
        out.append(total)
    return out


def test_quality_against_brute_force(spark, monkeypatch):
    """N-grams spelt out; so many buckets that none holds two of them."""
    monkeypatch.setattr(quality, "LOAD", 1 << 36)
    texts, labels = labelled(spark, 7, 400)
    texts = [(i, t + (" lucid and clear" if i % 3 and i % 5 else "")) for i, t in texts]
    texts[5] = (5, "No, no no NO no no no; x--y ñ1 ñ1! " + texts[5][1])
    rows = [tuple(r) for r in labels.collect()]
    docs = corpus(spark, texts)
    got = {r.doc_id: r for r in quality.resample(docs, labels).collect()}
    want = brute_weights([t for _, t in texts], rows)
    assert max(abs(got[i].weight - w) for i, w in enumerate(want)) < 0.01
    assert max(want) > 1 and sum(w == 0 for w in want) < len(want) / 2
    k = round(sum(not bad for _, _, bad in rows) / len(rows) * len(texts))
    keys = sorted((r.gumbel_key for r in got.values()), reverse=True)
    assert {i for i, r in got.items() if r.kept} == {i for i, r in got.items() if round(r.gumbel_key * 1e6) >= round(keys[k - 1] * 1e6)}


def test_storage_and_joined_ratios_change_nothing(spark, tmp_path, monkeypatch):
    """Two codecs, and ratios that are joined instead of held, give the same weights."""
    texts, labels = labelled(spark, 8, 300)
    rows = [*texts, (300, None), (301, "  "), (None, texts[1][1])]
    for codec in ("uncompressed", "zstd"):
        corpus(spark, rows).write.option("compression", codec).parquet(str(tmp_path / codec))
    run = lambda codec: sorted(map(str, quality.resample(spark.read.parquet(str(tmp_path / codec)), labels).collect()))
    want = run("zstd")
    assert run("uncompressed") == want
    monkeypatch.setattr(quality, "MOST_HELD", 10)
    assert run("zstd") == want
    kept = quality.kept_rows(corpus(spark, rows), labels)
    assert kept.columns == corpus(spark, rows).columns and kept.where("doc_id = 300").count() == 1


def test_gumbel_noise_decides(spark):
    """At temperature 1 the noise, at 0.001 the weights decide; equal rows stay or go together."""
    rng = random.Random(5)
    texts, labels = labelled(spark, 3, 300)
    docs = corpus(spark, texts + [texts[1]] * 3)
    hot = {r.doc_id: r.kept for r in quality.resample(docs, labels, temperature=1000.0, fraction=0.5).collect()}
    cold = quality.resample(docs, labels, temperature=0.001, fraction=0.5).collect()
    assert sum(hot[i] for i in hot if i % 5 == 0) > 15 and sum(r.kept for r in cold if r.doc_id % 5 == 0) <= 2
    assert len({r.kept for r in cold if r.doc_id == 1}) == 1 and rng


def test_top_k_of_large_components(spark):
    """Scores beyond 2^53, and beyond a long, keep their exact order; small ones stand beside them."""
    rng = random.Random(4)
    rows = [(0, [float(2**27 + 1), 1.0]), (1, [float(2**27 + 1), 1.0]), (2, [float(2**27 + 1), 2.0])]
    got = [tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), scale=1).orderBy("rank").collect()]
    assert got == [(0, 1, 2, (2**27 + 1) ** 2 + 2), (0, 2, 1, (2**27 + 1) ** 2 + 1)]
    rows = [(i, [float(rng.choice([1, 2**26, 2**40, -(2**70)]) * rng.randrange(1, 9) + rng.randrange(3)) for _ in range(20)]) for i in range(80)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), k=10).collect()
    want = []
    for q, a in rows[::20]:
        score = sorted((-sum(64 * int(x) * 64 * int(y) for x, y in zip(a, b, strict=True)), i) for i, b in rows if i != q)
        want += [(q, k + 1, i, max(-(2**63), min(2**63 - 1, -s))) for k, (s, i) in enumerate(score[:10])]
    assert sorted(map(tuple, got)) == sorted(want)


def test_order_keys():
    scores = sorted([0, 1, -1, 2**62, -(2**62) - 1, 2**62 - 1, 2**200, -(2**200), 2**63, -(2**70), 5, 2**64 + 1, 2**64])
    keys = topk.order_keys(np.array(scores, dtype=object))
    assert keys == sorted(keys) and len(set(keys)) == len(keys)
