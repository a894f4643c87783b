"""Exact substring dedup with suffix arrays of shards.

Any repeat of WINDOW bytes holds the same anchor: the leftmost GRAM-byte run with
the smallest hash among its runs. Windows that share one anchor occurrence form a
context, the bytes they span together. Equal windows have equal anchors, so it is
enough to compare the contexts of one anchor.

1. Shards send their distinct anchors, one row each; a window over equal keys
   answers with those that occur again. Contexts of other anchors cannot repeat.
2. Shards send the contexts of such anchors, each distinct one once, with its
   first place; later equal ones are repeats already. An anchor with very many
   occurrences is split by the bytes around it (`split`), so that no task gets all.
3. Spark sorts contexts by anchor and deals anchors over tasks. A task cuts its
   stream into suffix-array shards. Each gets its suffix array by Larsson-Sadakane
   refinement and the common prefixes of neighbours by Kasai, in numpy: windows with
   a common prefix of WINDOW bytes are equal, all but the first place are repeats.
   An anchor that continues in the next shard is merged by binary search of sorted
   windows (`Sorted`).
4. Shards drop the bytes that repeats cover.

Defined cases: a null or empty text has no bytes; texts under WINDOW bytes lose
nothing; rows with equal doc_id are separate documents in the order of their
texts; those without doc_id come after all others, by shard and text; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE, mix64, powers, seeds, signed, table, text_bytes
from .shards import KEYS, key_rows, member, ordered, replied_keys, shared_keys, sharded

GRAM = 24
#: Window starts that numpy works on at a time.
PIECE = 1 << 18
#: Bytes of contexts in one suffix array.
ARRAY_BYTES = 1 << 20
#: log2 of the occurrences that an anchor may have unsplit, and of what each split allows more.
UNSPLIT, EACH_SPLIT = 13, 3
_LOW = np.uint64((1 << 24) - 1)


def gram_hashes(raw: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n bytes, n a sum of two powers of two at most (24 = 16 + 8)."""
    have, step = {1: BYTE[raw]}, 1
    while 2 * step <= n:
        h = have[step]
        have[2 * step] = h[: len(h) - step] * powers(step + 1)[step] + h[step:]
        step *= 2
    if step == n:
        return mix64(have[n])
    size = len(raw) - n + 1
    return mix64(have[step][:size] * powers(n - step + 1)[n - step] + have[n - step][step : step + size])


def runs(raw: np.ndarray, off: np.ndarray, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first window, number of windows, anchor, its place) of the runs of windows with one anchor."""
    wide = window - GRAM + 1
    for p in range(0, len(raw) - window + 1, PIECE):
        part = raw[p : p + PIECE + window - 1]
        n = len(part) - window + 1
        full = gram_hashes(part, GRAM)
        low = (full & ~_LOW) | np.arange(len(full), dtype=np.uint64)
        have = 1
        while 2 * have <= wide:
            low = np.minimum(low[:-have], low[have:])
            have *= 2
        if have < wide:
            low = np.minimum(low[: len(low) - (wide - have)], low[wide - have :])
        spot = (low & _LOW).astype(np.int64)
        text = np.searchsorted(off, np.arange(p, p + n), side="right")
        inside = np.arange(p, p + n) + window <= off[text]
        first = np.ones(n, bool)
        first[1:] = (spot[1:] != spot[:-1]) | ~inside[:-1]
        first[1:] |= text[1:] != text[:-1]
        starts = np.flatnonzero(first & inside)
        marks = np.flatnonzero(first | ~inside)
        ends = np.append(marks, n)[np.searchsorted(marks, starts, side="right")]
        yield starts + p, ends - starts, full[spot[starts]], spot[starts] + p


def all_runs(raw: np.ndarray, off: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    found = list(runs(raw, off, window))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def send_anchors(shard: pa.Table, window: int) -> pa.Table:
    """The shard's anchors and how often each occurs."""
    number = shard.column("shard")[0].as_py()
    _, _, raw, off = ordered(shard)
    key, count = np.unique(all_runs(raw, off, window)[2], return_counts=True)
    return key_rows(number, key, count)


def gather(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes raw[start:start + size] of all rows, concatenated."""
    ends = np.cumsum(size)
    if not len(ends):
        return np.zeros(0, raw.dtype)
    return raw[np.arange(ends[-1]) + np.repeat(start - (ends - size), size)]


def digests(flat: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of consecutive pieces of flat, none empty: an (n, 2) array."""
    begin = np.cumsum(size) - size
    at = np.arange(len(flat)) - np.repeat(begin, size)
    power = powers(int(size.max()) + 1)[at]
    one = np.add.reduceat(BYTE[flat] * power, begin)
    two = np.add.reduceat(mix64(BYTE[flat] ^ power), begin)
    return np.stack([mix64(one + size.astype(np.uint64)), mix64(two)], axis=1)


def first_of_equal(keys: list[np.ndarray], order_by: list[np.ndarray]) -> np.ndarray:
    """True where a row is the first, by order_by, of the rows with equal keys."""
    order = np.lexsort([*order_by[::-1], *keys[::-1]])
    first = np.ones(len(order), bool)
    same = np.ones(max(len(order) - 1, 0), bool)
    for k in keys:
        same &= k[order][1:] == k[order][:-1]
    first[1:] = ~same
    out = np.zeros(len(order), bool)
    out[order[first]] = True
    return out


_EXTEND = seeds(256, 31)


def split(raw: np.ndarray, start: np.ndarray, n: np.ndarray, key: np.ndarray, spot: np.ndarray, width: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that share width bytes at spot -> runs that share half of the other bytes more.

    A window has room for `half` more shared bytes behind spot + width or, failing
    that, before spot. Equal windows have spot at one offset, so they go the same way
    and extend it by equal bytes, which join the key.
    """
    half = (window - width) // 2
    turn = spot - (window - width - half)  # windows from here on have the room behind
    out = []
    for lo, hi, at, new_spot, salt in ((np.maximum(start, turn), start + n, spot + width, spot, 1), (start, np.minimum(start + n, turn), spot - half, spot - half, 2)):
        some = np.flatnonzero(hi > lo)
        more = _EXTEND[raw[at[some][:, None] + np.arange(half)]] * powers(half + 1)[1:]
        out.append((lo[some], (hi - lo)[some], mix64(key[some] * np.uint64(2 * salt + 1) + more.sum(axis=1, dtype=np.uint64)), new_spot[some]))
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def split_hot(raw: np.ndarray, start: np.ndarray, n: np.ndarray, key: np.ndarray, spot: np.ndarray, total: np.ndarray, window: int, unsplit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs with their keys, those of anchors that occur often split by the bytes around them."""
    depth = np.maximum(0, np.ceil((np.log2(np.maximum(total, 1)) - unsplit) / EACH_SPLIT)).astype(np.int64)
    done, width = [], GRAM
    while len(start):
        hot = depth > 0 if window - width > 1 else np.zeros(len(start), bool)
        done.append((start[~hot], n[~hot], key[~hot]))
        where = np.flatnonzero(hot)
        parts = [split(raw, start[x], n[x], key[x], spot[x], width, window) for d in np.unique(depth[where]) for x in [where[depth[where] == d]]]
        depth = np.repeat(np.unique(depth[where]) - 1, [len(p[0]) for p in parts])
        start, n, key, spot = map(np.concatenate, zip(*parts, strict=True)) if parts else (start[:0],) * 4
        width += (window - width) // 2
    return tuple(map(np.concatenate, zip(*done, strict=True))) if done else (start, n, key)


CONTEXTS = "key bigint, owner bigint, shard int, start int, n int, context binary"


def send_contexts(shard: pa.Table, replies: pa.Table, window: int, unsplit: int) -> pa.Table:
    """Distinct contexts of repeated anchors with their first place; n below 0: -n bytes that repeat within the shard."""
    number, key, owner = 0, np.zeros(0, np.uint64), np.zeros(0, np.int64)
    start, n, context = np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], pa.binary())
    if len(shard) and len(replies):
        number = shard.column("shard")[0].as_py()
        _, ids, raw, off = ordered(shard)
        start, n, key, spot = all_runs(raw, off, window)
        again, total = replied_keys(replies)
        hit = member(key, again)
        start, n, key, spot = start[hit], n[hit], key[hit], spot[hit]
        start, n, key = split_hot(raw, start, n, key, spot, total[np.searchsorted(again, key)], window, unsplit)
    if len(start):
        size = n + window - 1
        digest = digests(gather(raw, start, size), size)
        new = first_of_equal([digest[:, 0], digest[:, 1], key], [start])
        order = np.argsort(start[~new])
        lost, end = covered(start[~new][order], (start + size)[~new][order])
        flat = gather(raw, start[new], size[new])
        ends = np.concatenate([[0], np.cumsum(size[new])])
        context = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(flat.tobytes())]).cast(pa.binary())
        context = pa.concat_arrays([context, pa.array([b""] * len(lost), pa.binary())])
        key = np.concatenate([key[new], mix64(lost.astype(np.uint64) + np.uint64(number << 32))])
        start, n = np.concatenate([start[new], lost]), np.concatenate([n[new], lost - end])
        owner = ids[np.searchsorted(off, start, side="right") - 1]
    return pa.table({"key": pa.array(signed(key)), "owner": pa.array(owner), "shard": pa.array(np.full(len(start), number, np.int32)), "start": pa.array(start.astype(np.int32)), "n": pa.array(n.astype(np.int32)), "context": context})


# --- suffix arrays ----------------------------------------------------------


def suffix_array(flat: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Larsson-Sadakane: suffixes of flat, each ending at end[i], in order.

    Equal suffixes stay in the order of their places. Suffixes are sorted by their
    first 7 bytes; then only groups that are not yet sorted are refined, by the
    rank of the suffix h bytes on, h doubling.
    Returns the array and its inverse.
    """
    n = len(flat)
    left = end - np.arange(n)
    code = np.zeros(n, np.uint64)
    for k in range(7):
        byte = np.zeros(n, np.uint64)
        byte[: n - k] = flat[k:].astype(np.uint64) + np.uint64(1)
        byte[left <= k] = 0
        code = (code << np.uint64(9)) | byte
    sa = np.argsort(code, kind="stable")
    sorted_code = code[sa]
    head = np.ones(n, bool)
    head[1:] = sorted_code[1:] != sorted_code[:-1]
    rank = np.empty(n, np.int64)
    slot_head = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank[sa] = slot_head + 1  # 0: past the end
    h, longest = 7, int(left.max(initial=0))
    single = head & np.append(head[1:], True)
    active = np.flatnonzero(~single)
    while len(active) and h < longest:
        item = sa[active]
        ahead = np.where(left[item] > h, rank[np.minimum(item + h, n - 1)], 0)
        pair = (rank[item] << 32) | ahead
        order = np.argsort(pair, kind="stable")
        pair, item = pair[order], item[order]
        sa[active] = item
        new = np.ones(len(active), bool)
        new[1:] = pair[1:] != pair[:-1]
        at = np.maximum.accumulate(np.where(new, np.arange(len(active)), 0))
        rank[item] = active[at] + 1
        alone = new & np.append(new[1:], True)
        active = active[~alone]
        h *= 2
    inverse = np.empty(n, np.int64)
    inverse[sa] = np.arange(n)
    return sa, inverse


def kasai(flat: np.ndarray, begin: np.ndarray, size: np.ndarray, sa: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix with its predecessor, every context a lane of its own.

    Within a context the common prefix shrinks by at most one from a suffix to the
    next, so it is carried on; lanes advance together.
    """
    n = len(flat)
    end = np.repeat(begin + size, size)
    out = np.zeros(n, np.int32)
    carried = np.zeros(len(begin), np.int64)
    lane = np.arange(len(begin))
    for t in range(int(size.max(initial=0))):
        lane = lane[size[lane] > t]
        i = begin[lane] + t
        slot = inverse[i]
        j = sa[np.maximum(slot - 1, 0)]
        most = np.minimum(end[i] - i, end[j] - j)
        h = np.where(slot > 0, np.minimum(carried[lane], most), 0)
        going = np.flatnonzero((slot > 0) & (h < most))
        while len(going):
            same = flat[i[going] + h[going]] == flat[j[going] + h[going]]
            going = going[same]
            h[going] += 1
            going = going[h[going] < most[going]]
        out[slot] = h
        carried[lane] = np.maximum(h - 1, 0)
    return out


def windows_as_words(flat: np.ndarray, where: np.ndarray, window: int) -> np.ndarray:
    """The window at each place as big-endian words, so that rows compare like bytes."""
    wide = -(-window // 8) * 8
    rows = np.zeros((len(where), wide), np.uint8)
    rows[:, :window] = flat[where[:, None] + np.arange(window)]
    return rows.view(">u8").astype(np.uint64)


def less(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise a < b for rows of words."""
    differ = a != b
    k = differ.argmax(axis=1)
    row = np.arange(len(a))
    return differ[row, k] & (a[row, k] < b[row, k])


def search(rows: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Binary search: the first of the sorted rows that is not below each wanted row."""
    lo, hi = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(rows), np.int64)
    while (open_ := np.flatnonzero(lo < hi)).size:
        mid = (lo[open_] + hi[open_]) // 2
        below = less(rows[mid], wanted[open_])
        lo[open_[below]] = mid[below] + 1
        hi[open_[~below]] = mid[~below]
    return lo


class Sorted:
    """Distinct windows of one anchor, as sorted runs of falling size, with their first places.

    Each window stands in one run; runs of like size are merged, so n windows cost
    n log n steps however many arrays they come from.
    """

    def __init__(self):
        self.runs: list[list[np.ndarray]] = []

    def add(self, rows: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Sorted distinct windows with their (owner, shard, start) -> the places that lose."""
        lost = []
        for held in self.runs:
            spot = search(held[0], rows)
            at = np.minimum(spot, len(held[0]) - 1)
            same = (spot < len(held[0])) & (held[0][at] == rows).all(axis=1)
            p, mine = at[same], np.flatnonzero(same)
            wins = np.lexsort((np.concatenate([place[mine], held[1][p]]).T)[::-1]).argsort()
            wins = wins[: len(mine)] < wins[len(mine) :]
            lost += [place[mine[~wins]], held[1][p[wins]]]
            held[1][p[wins]] = place[mine[wins]]
            rows, place = rows[~same], place[~same]
        if len(rows):
            self.runs.append([rows, place])
        while len(self.runs) > 1 and len(self.runs[-2][0]) < 2 * len(self.runs[-1][0]):
            more, most = self.runs.pop(), self.runs.pop()
            at = search(most[0], more[0]) + np.arange(len(more[0]))
            old = np.ones(len(most[0]) + len(more[0]), bool)
            old[at] = False
            joined = [np.empty((len(old), x.shape[1]), x.dtype) for x in most]
            for k in range(2):
                joined[k][old], joined[k][at] = most[k], more[k]
            self.runs.append(joined)
        return np.concatenate(lost) if lost else place[:0]


class Repeats:
    """Contexts in anchor order, a suffix-array shard at a time -> places whose window begins earlier elsewhere."""

    def __init__(self, window: int):
        self.window, self.key, self.pool = window, None, None

    def add(self, key: np.ndarray, place: np.ndarray, n: np.ndarray, flat: np.ndarray) -> np.ndarray:
        """place: (owner, shard, start) of each context."""
        window, size = self.window, n + self.window - 1
        begin = np.cumsum(size) - size
        ctx = np.repeat(np.arange(len(n)), size)
        off = np.arange(len(flat)) - begin[ctx]
        sa, inverse = suffix_array(flat, (begin + size)[ctx])
        common = kasai(flat, begin, size, sa, inverse)
        group = np.cumsum(common < window)
        is_window = (off < n[ctx])[sa]
        at, group = sa[is_window], group[is_window]
        c = ctx[at]
        where = place[c]
        where[:, 2] += off[at]
        first = first_of_equal([group], [where[:, 0], where[:, 1], where[:, 2]])
        lost = [where[~first]]
        for k in dict.fromkeys([key[0], key[-1]]):
            if k != self.key:
                if k != key[-1]:
                    continue  # begins and ends within this shard
                self.key, self.pool = k, Sorted()
            mine = np.flatnonzero(first & (key[c] == k))
            mine = mine[np.argsort(group[mine], kind="stable")]
            lost.append(self.pool.add(windows_as_words(flat, at[mine], window), where[mine]))
        return np.concatenate(lost)


REPLIES = "shard int, start int, stop int"


def lost_rows(shard: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
    """Intervals of shards, merged where they touch."""
    base = shard.astype(np.int64) << 32
    order = np.argsort(base + start, kind="stable")
    a, b = covered((base + start)[order], (base + stop)[order])
    low = (1 << 32) - 1
    return pa.RecordBatch.from_arrays([pa.array((a >> 32).astype(np.int32)), pa.array((a & low).astype(np.int32)), pa.array((b & low).astype(np.int32))], names=["shard", "start", "stop"])


def find_repeats(batches: Iterator[pa.RecordBatch], window: int, array_bytes: int) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by key, context and place -> intervals of repeats of each shard."""
    state, kept, held = Repeats(window), [], 0

    def done() -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(kept).combine_chunks()
        key, owner, shard, start, n = (rows.column(c).to_numpy().astype(np.int64) for c in ("key", "owner", "shard", "start", "n"))
        inner = n < 0
        yield lost_rows(shard[inner], start[inner], (start - n)[inner])
        rows = rows.filter(pa.array(~inner))
        if not len(rows):
            return
        key, owner, shard, start, n = (x[~inner] for x in (key, owner, shard, start, n))
        context = rows.column("context").combine_chunks()
        context = pa.concat_arrays(context.chunks) if isinstance(context, pa.ChunkedArray) else context
        same = np.zeros(len(n), bool)
        same[1:] = (key[1:] == key[:-1]) & pc.equal(context.slice(1), context.slice(0, len(n) - 1)).to_numpy(zero_copy_only=False)
        yield lost_rows(shard[same], start[same], (start + n)[same] + window - 1)
        flat, _ = text_bytes(context.filter(pa.array(~same)))
        late = state.add(key[~same], np.stack([owner, shard, start], axis=1)[~same], n[~same], flat)
        yield lost_rows(late[:, 1], late[:, 2], late[:, 2] + window)

    for batch in batches:
        sizes = np.cumsum(pc.binary_length(batch.column("context")).to_numpy(zero_copy_only=False).astype(np.int64))
        a = 0
        while a < len(batch):
            before = int(sizes[a - 1]) if a else 0
            b = min(len(batch), max(a + 1, int(np.searchsorted(sizes, before + array_bytes - held))))
            kept.append(batch.slice(a, b - a))
            held += int(sizes[b - 1]) - before
            a = b
            if held >= array_bytes or a < len(batch):
                yield from done()
                kept, held = [], 0
    if kept:
        yield from done()


def covered(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint intervals that intervals, sorted by start, cover."""
    if not len(start):
        return start, end
    reach = np.maximum.accumulate(end)
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > reach[:-1]
    heads = np.flatnonzero(new)
    return start[heads], reach[np.append(heads[1:], len(start)) - 1]


RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"


def drop_bytes(shard: pa.Table, replies: pa.Table, texts: bool) -> pa.Table:
    """A shard's texts without the bytes that its intervals cover."""
    shard, ids, raw, off = ordered(shard)
    change = np.zeros(len(raw) + 1, np.int32)
    np.add.at(change, replies.column("start").to_numpy(), 1)
    np.add.at(change, replies.column("stop").to_numpy(), -1)
    gone = np.cumsum(change[:-1]) > 0
    total = np.concatenate([[0], np.cumsum(gone)])
    n_removed = total[off[1:]] - total[off[:-1]]
    opens = gone.copy()
    opens[1:] &= ~gone[:-1]
    heads = off[:-1][off[:-1] < len(raw)]
    opens[heads] = gone[heads]
    spans = np.concatenate([[0], np.cumsum(opens)])
    n_spans = spans[off[1:]] - spans[off[:-1]]
    sha, kept = [], []
    for i in range(len(ids)):
        text = raw[off[i] : off[i + 1]]
        if n_removed[i]:
            text = text[~gone[off[i] : off[i + 1]]]
        text = text.tobytes()
        sha.append(hashlib.sha256(text).hexdigest())
        kept.append(text if texts else None)
    return pa.table({"doc_id": shard.column("doc_id"), "n_bytes": pa.array(np.diff(off), pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()), "kept_sha256": pa.array(sha, pa.string()), "kept": pa.array(kept, pa.binary())})


def drop_repeated_bytes(docs: DataFrame, window: int = 100, texts: bool = True, array_bytes: int = ARRAY_BYTES, unsplit: int = UNSPLIT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (null unless texts).

    Removes each byte that a window-byte string covers which also starts earlier:
    in a document with a smaller doc_id, or before it in the same one.
    """
    if window < 2 * GRAM:
        raise ValueError(f"window must be at least {2 * GRAM} bytes")
    held = sharded(docs).groupBy("shard")
    common = shared_keys(held.applyInArrow(lambda t: send_anchors(t, window), KEYS))
    tried = held.cogroup(common.groupBy("shard")).applyInArrow(lambda a, b: send_contexts(a, b, window, unsplit), CONTEXTS)
    dealt = tried.repartition("key").sortWithinPartitions("key", "context", "owner", "shard", "start")
    late = dealt.mapInArrow(lambda it: find_repeats(it, window, array_bytes), REPLIES)
    return held.cogroup(late.groupBy("shard")).applyInArrow(lambda a, b: drop_bytes(a, b, texts), RESULT)


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    found = drop_repeated_bytes(table(spark, sf_dir, "documents"), texts=False)
    return found.select(F.col("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
