"""Documents dealt over shards, and the exchange of keys between shards.

Operators that look for repeats over the whole corpus make several passes over
the same shards: a shard derives keys from its texts, Spark brings equal keys
together, and the answer joins the shard's texts again. Every key is one plain row,
so what is exchanged grows in proportion to the texts; a shard sends a key once
however often it holds it, and Spark's sort and window stream over the rows of a hot
key and spill. Texts are shuffled once: every pass reads the same exchange.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parts_for, signed, text_bytes

#: Bytes of input files a shard: a few MB of text, as a task's Python holds one shard at a time.
SHARD_BYTES = 1 << 20
LAST = np.iinfo(np.int64).max


def sharded(docs: DataFrame) -> DataFrame:
    """doc_id, text and shard. Rows of one doc_id share a shard; those without spread by text."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = parts_for(docs, SHARD_BYTES)
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    return docs.withColumn("shard", F.pmod(key, F.lit(n)).cast("int"))


def ordered(shard: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """A shard's rows by doc_id and text, nulls last: table, doc ids, bytes, offsets."""
    shard = shard.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()
    ids = shard.column("doc_id").fill_null(LAST).to_numpy().astype(np.int64)
    raw, off = text_bytes(shard.column("text"))
    return shard, ids, raw, off


def starts_of(sorted_keys: np.ndarray) -> np.ndarray:
    """Indexes at which a sorted array has a new value."""
    first = np.ones(len(sorted_keys), bool)
    first[1:] = sorted_keys[1:] != sorted_keys[:-1]
    return np.flatnonzero(first)


KEYS = "key bigint, shard int, n int"


def key_rows(shard: int, keys: np.ndarray, n: np.ndarray) -> pa.Table:
    """Distinct keys of a shard and how often each counts."""
    return pa.table({"key": pa.array(signed(keys)), "shard": pa.array(np.full(len(keys), shard, np.int32)), "n": pa.array(n.astype(np.int32))})


def shared_keys(sent: DataFrame) -> DataFrame:
    """(key, shard, n) -> (shard, key, total) of the keys whose n sum to more than one."""
    total = F.sum("n").over(Window.partitionBy("key"))
    return sent.withColumn("total", total).where("total > 1").select("shard", "key", "total")


def member(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which keys are in the sorted array known."""
    if not len(known) or not len(keys):
        return np.zeros(len(keys), bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


def replied_keys(replies: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The keys of replies, sorted, and their totals."""
    key = replies.column("key").to_numpy().view(np.uint64)
    order = np.argsort(key)
    return key[order], replies.column("total").to_numpy()[order]
