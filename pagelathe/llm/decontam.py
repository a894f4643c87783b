"""Benchmark decontamination by template windows.

Words are canonicalised: numbers, names (capitals inside a sentence) and units
after a number become typed placeholders, other words lose case and edge
punctuation. Items with one template, slots equal in the same places, are one class
(its smallest item_id stands for it), so thousands of items that differ in their
numbers cost a text one match. Windows of WINDOW canonical words (a shorter item: all
of it) of texts and classes are joined by hash. Windows of a text that match a class
at the same shift are one alignment; its slots must be filled consistently: of the
fillings of a value only the most frequent counts, and windows that hold another are
left out, those without it stay. Of equally frequent ones none counts for a name, all
for a number, since equal numbers of an item need not mean the same. So a question
with other numbers or names is caught, a chance mix of templates is not.

A capital that opens a sentence may or may not begin a name: windows with such words
are made both ways, as words and as names.

A window of almost only placeholders matches by chance, so it is hashed with its own
words. Items of mostly such windows are found where they stand verbatim; with other
numbers nothing tells them from chance.

The benchmark's window hashes are held by each worker if there are at most
MOST_HELD of them (8 bytes each); beyond that, all windows of the texts go to the
join. Both ways give the same rows.

Defined cases: a null or empty text or item matches nothing; rows with equal
doc_id count as one document, a null doc_id is never reported; repeated items
are one class; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE, IS_SPACE, LOWER, grams, materialize, mix64, powers, seeds, signed, slices, spread_join, table, text_bytes, words

WINDOW = 8
#: Window hashes of the benchmark that each worker may hold: 32 MB.
MOST_HELD = 1 << 22
#: A template window needs so many words that are no placeholders, a shorter item half of its words.
LITERAL = 4

# Fixed values.
UNITS = [
    "mm", "cm", "m", "km", "in", "ft", "yd", "mi", "mg", "g", "kg", "t", "lb", "oz", "ml", "l", "gal", "s", "sec", "min", "h", "hr", "hrs", "day",
    "days", "week", "weeks", "month", "months", "year", "years", "%", "usd", "eur", "dollars", "euros", "dollar", "euro", "cents", "c", "f", "k", "w",
    "kw", "v", "a", "hz", "mph", "km/h", "m/s", "meters", "metres", "miles", "feet", "inches", "grams", "kilograms", "liters", "litres", "hours",
    "minutes", "seconds",
]
_IS_PUNCT = np.zeros(256, bool)
_IS_PUNCT[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in "%$"]] = True
_IS_DIGIT = np.zeros(256, bool)
_IS_DIGIT[48:58] = True
_IS_UPPER = np.zeros(256, bool)
_IS_UPPER[65:91] = True
_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?:")] = True
NUMBER, NAME, UNIT = seeds(3, 909)
#: Kinds of slots: numbers and units, names, capitals that open a sentence.
VALUE, NAMED, OPENING, WORD = range(4)
_INVERSE = np.uint64(pow(int(powers(2)[1]), -1, 1 << 64))
_inverses = np.ones(1, np.uint64)


def inverses(n: int) -> np.ndarray:
    global _inverses
    if len(_inverses) < n:
        grown = np.full(2 * n, _INVERSE, np.uint64)
        grown[0] = 1
        _inverses = np.multiply.accumulate(grown)
    return _inverses[:n]


def spans_hash(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of raw[start:end] of each row, from one running sum."""
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTE[raw] * powers(len(raw)), out=total[1:])
    return mix64((total[end] - total[start]) * inverses(len(raw) + 1)[start] + (end - start).astype(np.uint64))


def canonical(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word: canonical hash, own hash, its kind of slot (WORD: none); and the word offsets of the texts."""
    _, start, end, at = words(raw, off)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), at
    ends_sentence = _ENDS[raw[end - 1]]
    newline = np.concatenate([[0], np.cumsum(raw == 10)])
    opens = np.ones(len(start), bool)
    opens[1:] = ends_sentence[:-1] | (newline[start[1:]] > newline[end[:-1]])
    opens[at[:-1][at[:-1] < len(start)]] = True
    a, b = start.copy(), end.copy()
    live = np.arange(len(a))
    while len(live := live[(a[live] < b[live]) & _IS_PUNCT[raw[np.minimum(a[live], len(raw) - 1)]]]):
        a[live] += 1
    live = np.arange(len(a))
    while len(live := live[(a[live] < b[live]) & _IS_PUNCT[raw[b[live] - 1]]]):
        b[live] -= 1
    empty = a >= b
    a[empty], b[empty] = start[empty], end[empty]
    own = spans_hash(LOWER[raw], a, b)
    head = raw[a]
    number = _IS_DIGIT[head] | ((head == 36) & (b - a > 1) & _IS_DIGIT[raw[np.minimum(a + 1, len(raw) - 1)]])
    name = _IS_UPPER[head] & ~opens
    unit = np.zeros(len(a), bool)
    unit[1:] = number[:-1] & np.isin(own[1:], _UNIT_HASHES)
    unit[at[:-1][at[:-1] < len(start)]] = False
    canon = np.where(number, NUMBER, np.where(name, NAME, np.where(unit, UNIT, own)))
    kind = np.where(number | unit, VALUE, np.where(name, NAMED, np.where(_IS_UPPER[head], OPENING, WORD)))
    kind[name & unit] = NAMED
    return canon, own, kind, at


_joined = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
_e = np.append(np.flatnonzero(IS_SPACE[_joined]), len(_joined))
_UNIT_HASHES = np.sort(spans_hash(LOWER[_joined], np.concatenate([[0], _e[:-1] + 1]), _e))


def templates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) -> with cls: 64 bits of the canonical words and of which slots are filled alike."""
    for batch in batches:
        raw, off = text_bytes(batch.column("text"))
        canon, own, kind, at = canonical(raw, off)
        cls = np.zeros(len(batch), np.uint64)
        for i in range(len(batch)):
            lo, hi = at[i], at[i + 1]
            slot = kind[lo:hi] < OPENING
            alike = np.zeros(hi - lo, np.uint64)
            _, first, which = np.unique(own[lo:hi][slot], return_index=True, return_inverse=True)
            alike[slot] = first[which] + 1
            cls[i] = (mix64(canon[lo:hi] ^ mix64(alike)) * powers(hi - lo + 1)[1:]).sum(dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text"), pa.array(signed(mix64(cls)))], names=["id", "text", "cls"])


def windows(raw: np.ndarray, off: np.ndarray, size: int, whole: bool) -> Iterator[tuple]:
    """Template windows of each text: (text, size, positions, hashes, slots from, slots to, slot values, slot places, windows of the text).

    whole: an item; one of fewer words is one window. Windows with words that open a
    sentence with a capital come again with them as names. A slot's place is
    8 * word + kind, 4 more in those. Windows of almost only placeholders come with
    their own words and no slots; of an item only if most of its windows are such.
    """
    canon, own, kind, at = canonical(raw, off)
    opens = np.concatenate([[0], np.cumsum(kind == OPENING)])
    ways = []
    for slot, way in ((kind < OPENING, canon), (kind < WORD, np.where(kind == OPENING, NAME, canon))):
        ways.append((way, np.concatenate([[0], np.cumsum(slot)]), own[slot], np.flatnonzero(slot), kind[slot], grams(way, size, 31)))
    verbatim = grams(own, size, 32)
    none = np.zeros(0, np.int64)
    for i in range(len(off) - 1):
        lo, hi = at[i], at[i + 1]
        if hi - lo < size and not whole or hi == lo:
            continue
        n = min(size, hi - lo)
        told = lambda pos, fill, n=n: n - (fill[pos + n] - fill[pos]) >= min(LITERAL, (n + 1) // 2)
        every = np.arange(lo, hi - n + 1)
        plain = every[~told(every, ways[0][1])]
        own_words = len(plain) > 0 and (not whole or 2 * len(plain) > len(every))
        n_all = len(every) if own_words and whole else len(every) - len(plain)
        for k, (way, fill, filled, where, kinds, gram) in enumerate(ways):
            pos = every if k == 0 else every[opens[every + n] > opens[every]]
            pos = pos[told(pos, fill)]
            if len(pos):
                key = gram[pos] if n == size else grams(way[lo:hi], n, 31)
                a, b = fill[lo], fill[hi]
                yield i, n, pos - lo, key, fill[pos] - a, fill[pos + n] - a, filled[a:b], 8 * (where[a:b] - lo) + 4 * k + kinds[a:b], n_all
        if own_words:
            key = verbatim[plain] if n == size else grams(own[lo:hi], n, 32)
            yield i, n, plain - lo, key, np.zeros(len(plain), np.int64), np.zeros(len(plain), np.int64), none.astype(np.uint64), none, n_all


FOUND = "id bigint, size int, key bigint, pos int, slots array<bigint>, places array<int>, of int"


def found_rows(ids: list, rows: list[tuple]) -> pa.RecordBatch:
    """rows: what windows() gives."""
    cat = lambda k, t: np.concatenate([r[k] for r in rows]).astype(t) if rows else np.zeros(0, t)
    count = [len(r[2]) for r in rows]
    spread = lambda values, t: np.repeat(np.array(values, dtype=t), count)
    slots, places, ends = [], [], [0]
    for r in rows:
        for a, b in zip(r[4].tolist(), r[5].tolist(), strict=True):
            slots.append(r[6][a:b])
            places.append(r[7][a:b])
            ends.append(ends[-1] + b - a)
    flat = np.concatenate(slots) if slots else np.zeros(0, np.uint64)
    flat_places = np.concatenate(places).astype(np.int32) if places else np.zeros(0, np.int32)
    who = [ids[r[0]] for r, c in zip(rows, count, strict=True) for _ in range(c)]
    return pa.RecordBatch.from_arrays(
        [pa.array(who, pa.int64()), pa.array(spread([r[1] for r in rows], np.int32)), pa.array(signed(cat(3, np.uint64))), pa.array(cat(2, np.int32)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(signed(flat))), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat_places)), pa.array(spread([r[8] for r in rows], np.int32))],
        names=["id", "size", "key", "pos", "slots", "places", "of"],
    )


def find_windows(batches: Iterator[pa.RecordBatch], sizes: list[int], held: dict[int, np.ndarray] | None, whole: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("id").to_pylist()
        raw, off = text_bytes(batch.column("text"))
        for a, b in slices(off):
            rows = []
            for size in sizes:
                for i, n, pos, key, lo, hi, filled, where, n_all in windows(raw[off[a] : off[b]], off[a : b + 1] - off[a], size, whole):
                    if held is not None and len(key):
                        known = held.get(n, np.zeros(0, np.uint64))
                        hit = known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key if len(known) else np.zeros(len(key), bool)
                        pos, key, lo, hi = pos[hit], key[hit], lo[hit], hi[hit]
                    if len(key):
                        rows.append((i, n, pos, key, lo, hi, filled, where, n_all))
            yield found_rows(ids[a:b], rows)


def benchmark_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = 0.6, most_held: int = MOST_HELD) -> DataFrame:
    """doc_id, item_id, n_items, n_windows, n_matched, n_slots, n_changed: the leaked items of each document.

    A class of n_items items leaks into a document if at least share of its windows
    match in consistent alignments; windows without slots need no alignment. item_id is
    its smallest; of the alignments with matching slots n_slots is the most values one
    fills, n_changed the most that it fills with another value than that item's.
    """
    items = benchmark.select(F.col("item_id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    by_class = items.mapInArrow(templates, "id bigint, text string, cls bigint").groupBy("cls")
    classes = materialize(by_class.agg(F.min("id").alias("id"), F.min_by("text", "id").alias("text"), F.count_distinct("id").alias("n_items")))
    bench = materialize(classes.select("id", "text").mapInArrow(lambda it: find_windows(it, [window], None, True), FOUND))
    keys = bench.select("size", "key").distinct()
    by_size = {r["size"]: r["n"] for r in keys.groupBy("size").agg(F.count("*").alias("n")).collect()}  # at most window rows
    held = None
    if sum(by_size.values()) <= most_held:
        got = keys.toPandas()
        held = {n: np.sort(got.loc[got["size"] == n, "key"].to_numpy(np.int64).view(np.uint64)) for n in by_size}
    sizes = sorted(by_size)
    hits = texts.mapInArrow(lambda it: find_windows(it, sizes, held, False), FOUND)
    # a window without slots counts wherever it stands: once a text, however often it comes
    placed = F.when(F.size("slots") > 0, F.col("pos"))
    left = hits.select("size", "key", F.col("id").alias("doc_id"), placed.alias("d_pos"), F.col("slots").alias("d")).distinct()
    right = bench.select("size", "key", F.col("id").alias("item_id"), "of", "pos", F.col("slots").alias("b"), F.col("places").alias("at"))
    both = spread_join(left, right, ["size", "key"], "doc_id", 8)
    aligned = both.select("doc_id", "item_id", "of", "pos", (F.col("d_pos") - F.col("pos")).alias("shift"), F.arrays_zip("b", "d", "at").alias("slots"))
    aligned = materialize(aligned)
    key = ["doc_id", "item_id", "shift"]
    filled = aligned.select(*key, F.explode("slots").alias("s")).select(*key, F.col("s.b").alias("b"), F.col("s.d").alias("d"), F.col("s.at").alias("at"))
    # windows made with openings as names are judged by all votes, the others by their own
    filled = filled.withColumn("at", F.explode(F.when(F.col("at") % 8 < 4, F.array(F.col("at"), F.col("at") + 4)).otherwise(F.array("at")))).distinct()
    votes = filled.groupBy(*key, (F.col("at") % 8).alias("kind"), "b", "d").agg(F.count("*").alias("n"))
    per_value = votes.groupBy(*key, "kind", "b").agg(F.collect_list(F.struct("kind", "b", "d", "n")).alias("f"), F.max("n").alias("top"), F.max(F.col("b") != F.col("d")).alias("changed"))
    tied = (F.col("kind") % 4 != VALUE) & (F.size(F.filter("f", lambda x: x["n"] == F.col("top"))) > 1)
    per_value = per_value.withColumn("bad", F.filter("f", lambda x: tied | (x["n"] < F.col("top"))))
    told = (F.col("kind") % 4 < OPENING) | F.col("changed")
    slots = per_value.groupBy(*key).agg(F.flatten(F.collect_list("bad")).alias("bad"), F.count_distinct(F.when(told, F.col("b"))).alias("n_filled"), F.count_distinct(F.when(F.col("changed"), F.col("b"))).alias("changed"))
    conflict = F.exists("slots", lambda s: F.exists("bad", lambda x: (x["kind"] == s["at"] % 8) & (x["b"] == s["b"]) & (x["d"] == s["d"])))
    checked = aligned.join(slots, key, "left").where(~F.coalesce(conflict, F.lit(False)))
    matched = checked.groupBy("doc_id", "item_id").agg(F.max("of").cast("bigint").alias("n_windows"), F.count_distinct("pos").alias("n_matched"), F.max(F.coalesce("n_filled", F.lit(0))).cast("bigint").alias("n_slots"), F.max(F.coalesce("changed", F.lit(0))).cast("bigint").alias("n_changed"))
    found = matched.where(F.col("n_matched") >= share * F.col("n_windows"))
    return found.join(classes.select(F.col("id").alias("item_id"), "n_items"), "item_id").select("doc_id", "item_id", "n_items", "n_windows", "n_matched", "n_slots", "n_changed")


def op8_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return benchmark_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
