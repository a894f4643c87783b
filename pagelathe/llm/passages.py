"""Repeated passages by difference-cover anchors.

A repeat of WINDOW words between two documents at word offsets i and j meets, at
some step below PERIOD, a pair of positions that both lie in the cover: for every
residues i and j a perfect difference set modulo PERIOD has such a step. So only
the runs of WINDOW - PERIOD + 1 words that start at cover positions are hashed
(6 of 31), and every long match shares an aligned anchor. Windows with an anchor
that a second document shares are then extended to all their words: hashed in full
(128 bits) and compared by their first document.

1. Each shard sends its distinct anchors; a window over equal keys answers with
   those of several documents.
2. Each shard sends its distinct windows around such anchors with their first document.
3. A window over equal hashes answers with the places whose window begins in an
   earlier document.
4. Each shard drops the words those windows cover, and those repeated within it.

What is exchanged is one row for an anchor or window of a shard, so it grows in
proportion to the words.

Defined cases: a null or empty text has no words; documents under WINDOW words
lose nothing; rows with equal doc_id are one document and never repeat each
other; rows without doc_id are one document after all others, spread by text;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import grams, signed, table, words
from .shards import KEYS, key_rows, member, ordered, replied_keys, shared_keys, sharded, starts_of

PERIOD = 31
#: A perfect difference set: every residue modulo 31 is a difference of two members.
COVER = np.zeros(PERIOD, bool)
COVER[[1, 5, 11, 24, 25, 27]] = True


def fits(at: np.ndarray, n_words: int, n: int) -> np.ndarray:
    """Which of the runs of n words at each word lie within one text."""
    if n_words < n:
        return np.zeros(0, bool)
    text = np.searchsorted(at, np.arange(n_words - n + 1), side="right")
    return np.arange(n_words - n + 1) + n <= at[text]


def anchors(word: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors at cover positions of texts with a whole window."""
    short = size - PERIOD + 1
    ok = fits(at, len(word), short)
    text = np.searchsorted(at, np.arange(len(ok)), side="right") - 1
    ok &= COVER[(np.arange(len(ok)) - at[text]) % PERIOD]
    ok &= (at[text + 1] - at[text]) >= size
    where = np.flatnonzero(ok)
    return where, grams(word, short, 21)[where]


def send_anchors(shard: pa.Table, size: int) -> pa.Table:
    """The shard's anchors; n is 2 where several of its documents hold one."""
    number = shard.column("shard")[0].as_py()
    _, ids, raw, off = ordered(shard)
    word, _, _, at = words(raw, off)
    where, key = anchors(word, at, size)
    owner = ids[np.searchsorted(at, where, side="right") - 1]
    order = np.lexsort((owner, key))
    key, owner = key[order], owner[order]
    heads = starts_of(key)
    if not len(heads):
        return key_rows(number, key, owner)
    several = owner[heads] != owner[np.append(heads[1:], len(key)) - 1]
    return key_rows(number, key[heads], 1 + several)


def windows(word: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of all windows and their two 64-bit hashes."""
    where = np.flatnonzero(fits(at, len(word), size))
    return where, grams(word, size, 22)[where], grams(word ^ np.uint64(_OTHER), size, 23)[where]


_OTHER = 0x5851F42D4C957F2D
WINDOWS = "one bigint, two bigint, owner bigint, shard int, place int"


def firsts(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows in document order: the class of each, and the first row of each class."""
    order = np.lexsort((two, one))
    new = np.ones(len(order), bool)
    new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    return group, order[new]


def send_windows(shard: pa.Table, replies: pa.Table, size: int) -> pa.Table:
    """The distinct windows around shared anchors, each with its first document and the place there."""
    one = two = np.zeros(0, np.uint64)
    owner, first, number = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    if len(shard) and len(replies):
        number = shard.column("shard")[0].as_py()
        _, ids, raw, off = ordered(shard)
        word, _, _, at = words(raw, off)
        spot, key = anchors(word, at, size)
        spot = spot[member(key, replied_keys(replies)[0])]
        hit = np.zeros(len(word) + 1, np.int64)
        hit[spot + 1] = 1
        hit = np.cumsum(hit)
        first, one, two = windows(word, at, size)
        near = hit[first + PERIOD] > hit[first]
        first, one, two = first[near], one[near], two[near]
        _, new = firsts(one, two)
        first, one, two = first[new], one[new], two[new]
        owner = ids[np.searchsorted(at, first, side="right") - 1]
    return pa.table({"one": pa.array(signed(one)), "two": pa.array(signed(two)), "owner": pa.array(owner), "shard": pa.array(np.full(len(first), number, np.int32)), "place": pa.array(first.astype(np.int32))})


RESULT = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string"


def drop_words(shard: pa.Table, late: pa.Table, size: int, texts: bool) -> pa.Table:
    """late: places whose window begins in an earlier document of another shard."""
    if not len(shard):
        return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept_sha256": pa.array([], pa.string()), "kept_text": pa.array([], pa.string())})
    shard, ids, raw, off = ordered(shard)
    word, begin, end, at = words(raw, off)
    where, one, two = windows(word, at, size)
    owner = ids[np.searchsorted(at, where, side="right") - 1]
    group, first = firsts(one, two)
    gone_class = np.zeros(len(first), bool)
    gone_class[group[np.searchsorted(where, late.column("place").to_numpy())]] = True
    removed = gone_class[group] | (owner[first][group] < owner)
    cover = np.zeros(len(word) + size + 1, np.int64)
    np.add.at(cover, where[removed], 1)
    np.add.at(cover, where[removed] + size, -1)
    gone = np.cumsum(cover)[: len(word)] > 0
    total = np.concatenate([[0], np.cumsum(gone)])
    n_removed = total[at[1:]] - total[at[:-1]]
    sha, kept = [], []
    plain = raw.tobytes()
    for i in range(len(ids)):
        a, b = at[i], at[i + 1]
        if n_removed[i]:
            left = np.flatnonzero(~gone[a:b]) + a
            text = b" ".join([plain[x:y] for x, y in zip(begin[left].tolist(), end[left].tolist(), strict=True)])
        else:
            text = b" ".join(plain[off[i] : off[i + 1]].split())
        sha.append(hashlib.sha256(text).hexdigest())
        kept.append(text.decode("utf-8", "replace") if texts else None)
    return pa.table({"doc_id": shard.column("doc_id"), "n_words": pa.array(np.diff(at), pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(sha, pa.string()), "kept_text": pa.array(kept, pa.string())})


def drop_repeated_passages(docs: DataFrame, window: int = 50, texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text (null unless texts).

    Removes each word covered by a window that also starts in a document with a
    smaller doc_id. window must exceed PERIOD.
    """
    if window <= PERIOD:
        raise ValueError(f"window must be over {PERIOD} words")
    held = sharded(docs).groupBy("shard")
    common = shared_keys(held.applyInArrow(lambda t: send_anchors(t, window), KEYS))
    tried = held.cogroup(common.groupBy("shard")).applyInArrow(lambda a, b: send_windows(a, b, window), WINDOWS)
    first = F.min("owner").over(Window.partitionBy("one", "two"))
    late = tried.withColumn("first", first).where("first < owner").select("shard", "place")
    return held.cogroup(late.groupBy("shard")).applyInArrow(lambda a, b: drop_words(a, b, window, texts), RESULT)


def op6_passage_dedup(spark, sf_dir: str) -> DataFrame:
    found = drop_repeated_passages(table(spark, sf_dir, "documents"), texts=False)
    return found.select(F.col("doc_id"), "n_words", "n_removed", "kept_sha256")
