"""Runs of repeating words, by longest common extensions on a harmonic grid.

A run with period p holds two neighbouring points jp and (j + 1)p of the grid of
step p. How far both go on alike, forwards and backwards, gives the run's ends; a
text of n words has n/1 + n/2 + n/3 + ... such pairs, n log n. Extensions forwards
come from the suffix array of the words, the common prefixes of its neighbours and a
table of range minima, those backwards from the same of the reversed words. Of runs
with the same ends the smallest period counts. Texts of a slice share one array.

A run of `least` words or more repeats at least half as many words in a row; only
texts with such a repeat are looked at on the grid, all others hold no run.

Nothing is shuffled; a text is the largest unit a task holds, with about 400 bytes of
tables for each of its words.

Defined cases: a null, empty or wordless text has no runs, nulls for the longest run
and the hash of nothing; a null doc_id is not rewritten; repeated rows are equal
results; ties for the longest run go to the smallest start, then period; words are
told apart by 64-bit hashes (two different words of one text of 10^4 are taken for
equal with probability below 10^-11); extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import column_like, grams, mix64, slices, table, text_bytes, words

#: Pairs of grid points that are looked at together.
PAIRS = 1 << 20
#: Text bytes that share a suffix array.
TOGETHER = 1 << 20


def rewritten(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which original word stands at each place of the rewritten texts; None where a text stays."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([np.arange(a), a + np.arange(n - a) % p])


def suffix_order(code: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of codes (1 or more), each `left` long, in order: inverse array, common prefixes with the predecessor.

    Prefix doubling with refinement of unsorted groups only; the ranks of each level
    then give all common prefixes at once, from the longest steps to the shortest.
    """
    n = len(code)
    sa = np.argsort(code, kind="stable")
    new = np.ones(n, bool)
    new[1:] = code[sa][1:] != code[sa][:-1]
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0)) + 1
    levels, h, longest = [rank.astype(np.int32)], 1, int(left.max())
    open_ = np.flatnonzero(~(new & np.append(new[1:], True)))
    while len(open_) and h < longest:
        item = sa[open_]
        ahead = np.where(left[item] > h, rank[np.minimum(item + h, n - 1)], 0)
        pair = (rank[item] << 32) | ahead
        order = np.argsort(pair, kind="stable")
        pair, item = pair[order], item[order]
        sa[open_] = item
        new = np.ones(len(open_), bool)
        new[1:] = pair[1:] != pair[:-1]
        rank[item] = open_[np.maximum.accumulate(np.where(new, np.arange(len(open_)), 0))] + 1
        levels.append(rank.astype(np.int32))
        open_ = open_[~(new & np.append(new[1:], True))]
        h *= 2
    inverse = np.empty(n, np.int32)
    inverse[sa] = np.arange(n, dtype=np.int32)
    one, two = sa[1:], sa[:-1]
    most = np.minimum(left[one], left[two])
    same = np.zeros(n - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        some = np.flatnonzero(same < most)
        equal = levels[k][one[some] + same[some]] == levels[k][two[some] + same[some]]
        same[some[equal]] += 1 << k
    return inverse, np.concatenate([[0], np.minimum(same, most)]).astype(np.int32)


class Extensions:
    """Longest common extensions of pairs of places, by range minima over a suffix array."""

    def __init__(self, code: np.ndarray, left: np.ndarray):
        self.inverse, prefixes = suffix_order(code, left)
        self.least = [prefixes]
        while 2 << (len(self.least) - 1) <= len(prefixes):
            half = 1 << (len(self.least) - 1)
            self.least.append(np.minimum(self.least[-1][:-half], self.least[-1][half:]))

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Words alike from x and y on, x and y different places."""
        a, b = self.inverse[x], self.inverse[y]
        a, b = np.minimum(a, b) + 1, np.maximum(a, b)  # minima of a..b
        level = np.frexp((b - a + 1).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.least[k][a[at]], self.least[k][b[at] - (1 << k) + 1])
        return out


def grid(size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, period, place jp) of all pairs of grid points of texts of these sizes, some at a time."""
    half = size // 2
    text = np.repeat(np.arange(len(size)), half)
    period = np.arange(half.sum()) - np.repeat(np.cumsum(half) - half, half) + 1
    pairs = (size[text] - 1) // period
    total = np.cumsum(pairs)
    a = 0
    while a < len(pairs):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + PAIRS, side="right")))
        n, p = pairs[a:b], np.repeat(period[a:b], pairs[a:b])
        yield np.repeat(text[a:b], n), p, (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * p
        a = b


def runs(code: np.ndarray, at: np.ndarray, least: int) -> np.ndarray:
    """Runs of texts code[at[i]:at[i + 1]]: rows (text, start, end, period) by text, start and period."""
    size = np.diff(at)
    n = len(code)
    owner = np.repeat(np.arange(len(size)), size)
    place = np.arange(n) - at[owner]
    ahead = Extensions(code, size[owner] - place)
    back = Extensions(code[::-1].copy(), (place + 1)[::-1].copy())
    found = []
    for text, p, x in grid(size):
        x = x + at[text]
        alike = np.flatnonzero(code[x] == code[x + p])
        text, p, x = text[alike], p[alike], x[alike]
        after = ahead(x, x + p)
        before = np.zeros(len(x), np.int64)
        inner = np.flatnonzero(x > at[text])
        before[inner] = back(n - x[inner], n - (x + p)[inner])
        long = np.flatnonzero((before + after >= p) & (before + after + p >= least))
        begin = (x - before - at[text])[long]
        found.append(np.unique(np.stack([text[long], begin, begin + (before + after + p)[long], p[long]], axis=1), axis=0))
    every = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 4), np.int64)
    shortest = np.ones(len(every), bool)  # of one text, start and end
    shortest[1:] = (every[1:, :3] != every[:-1, :3]).any(axis=1)
    every = every[shortest]
    return every[np.lexsort((every[:, 3], every[:, 1], every[:, 0]))]


def with_repeats(word: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Texts in which some n words in a row come up twice."""
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    gram = grams(word, n)
    inside = np.flatnonzero(np.arange(len(gram)) + n <= at[owner[: len(gram)] + 1])
    key = mix64(gram[inside] + mix64(owner[inside].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key)
    twice = np.flatnonzero(key[order][1:] == key[order][:-1])
    return np.unique(owner[inside[order[twice]]])


RESULT = "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def one_row(mine: np.ndarray, kept: list[bytes], outputs: bool) -> tuple:
    """The result's columns after doc_id; mine: (start, end, period) of a text's runs."""
    told = [(s, e - s, p) for s, e, p in mine.tolist()]
    text = b" ".join(kept)
    best = min(told, key=lambda r: (-r[1], r[0], r[2]), default=None)
    head = (len(told), *best, 1000 * best[1] // best[2]) if best else (0, None, None, None, None)
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in told)
    hashes = (hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text).hexdigest())
    whole = ([{"start": s, "length": n, "period": p} for s, n, p in told], text.decode("utf-8", "replace")) if outputs else (None, None)
    return *head, *hashes, *whole


def scan(batches: Iterator[pa.RecordBatch], least: int, rewrite: bool, outputs: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, off = text_bytes(batch.column("text"))
        ids, rows = batch.column("doc_id").to_pylist(), []
        for a, b in slices(off, TOGETHER):
            part = raw[off[a] : off[b]]
            word, begin, end, at = words(part, off[a : b + 1] - off[a])
            if rewrite:
                taken = [rewritten(d, n) for d, n in zip(ids[a:b], np.diff(at).tolist(), strict=True)]
                some = [k for k, t in enumerate(taken) if t is not None]
                source = np.arange(len(word))
                for k in some:
                    source[at[k] : at[k + 1]] = at[k] + taken[k]
                word, begin, end = word[source], begin[source], end[source]
            held = with_repeats(word, at, least // 2)
            found = np.zeros((0, 4), np.int64)
            if len(held):
                size = np.diff(at)[held]
                inner = np.concatenate([[0], np.cumsum(size)])
                source = np.arange(inner[-1]) + np.repeat(at[held] - inner[:-1], size)
                _, code = np.unique(word[source], return_inverse=True)
                found = runs(code + 1, inner, least)
                found[:, 0] = held[found[:, 0]]
            cuts = np.searchsorted(found[:, 0], np.arange(b - a + 1))
            plain = part.tobytes()
            for k in range(b - a):
                mine = found[cuts[k] : cuts[k + 1], 1:]
                size = int(at[k + 1] - at[k])
                change = np.zeros(size + 1, np.int64)
                np.add.at(change, mine[:, 0] + mine[:, 2], 1)
                np.add.at(change, mine[:, 1], -1)
                left = np.flatnonzero(np.cumsum(change[:-1]) == 0) + at[k]
                kept = [plain[x:y] for x, y in zip(begin[left].tolist(), end[left].tolist(), strict=True)]
                rows.append((ids[a + k], *one_row(mine, kept, outputs)))
        columns = list(zip(*rows, strict=True)) or [[]] * 10
        kinds = [pa.int64()] * 6 + [pa.string()] * 2 + [RUN, pa.string()]
        names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs", "collapsed"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


def periodic_runs(docs: DataFrame, least: int = 12, rewrite: bool = False, outputs: bool = True) -> DataFrame:
    """One row per row of docs: its runs, the longest one, the text without repeats, hashes of both.

    A run is a longest stretch of words with smallest period q, 2 * q words and `least`
    at least; after its first q words it repeats. rewrite makes the planted repeats of
    the contract first; outputs adds the columns runs and collapsed (else null).
    """
    if least < 2:
        raise ValueError("least must be 2 or more")
    docs = column_like(docs, doc_id="bigint", text="string")
    return docs.mapInArrow(lambda it: scan(it, least, rewrite, outputs), RESULT)


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), rewrite=True, outputs=False).drop("runs", "collapsed")


def oracle() -> str:
    """All equal pairs of words at each distance, and their islands."""
    return r"""
WITH t AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, [1::BIGINT, 2, 3, 4, 5, 6, 7, 8]), lambda c, u: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS l FROM documents),
h AS (SELECT r, doc_id, l, len(l) AS n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, x: xor(a >> 8, t[xor(a & 255, x) + 1])), 4294967295::BIGINT) AS h FROM d, t),
g AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a FROM h),
k AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM g),
m AS (SELECT r, doc_id, n, CASE WHEN a IS NULL THEN l ELSE list_transform(range(n), lambda i: l[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END]) END AS l FROM k),
w AS (SELECT r, unnest(l) AS word, unnest(range(len(l))) AS i FROM m),
e AS (SELECT a.r, b.i - a.i AS p, a.i FROM w a JOIN w b ON a.r = b.r AND a.word = b.word AND a.i < b.i),
s AS (SELECT r, p, i, i - row_number() OVER (PARTITION BY r, p ORDER BY i) AS o FROM e),
u AS (SELECT r, min(i) AS a, max(i) + 1 + p AS b, p FROM s GROUP BY r, p, o HAVING count(*) >= p AND count(*) + p >= 12),
q AS (SELECT r, a, b, min(p) AS p FROM u GROUP BY r, a, b),
x AS (SELECT r, count(*) AS n_runs, min_by(struct_pack(a := a, n := b - a, p := p), struct_pack(x := a - b, y := a, z := p)) AS top, string_agg(a || ',' || (b - a) || ',' || p || chr(10), '' ORDER BY a, p) AS lines FROM q GROUP BY r),
y AS (SELECT DISTINCT r, unnest(range(a + p, b)) AS i FROM q),
z AS (SELECT w.r, string_agg(word, ' ' ORDER BY w.i) AS kept FROM w ANTI JOIN y ON w.r = y.r AND w.i = y.i GROUP BY w.r)
SELECT m.doc_id, coalesce(n_runs, 0) AS n_runs, top.a AS start, top.n AS length, top.p AS period, 1000 * top.n // top.p AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256 FROM m LEFT JOIN x USING (r) LEFT JOIN z USING (r)"""
