"""Quality by importance resampling: hashed n-gram models of target and raw text.

Tokens are runs of letters and digits or runs of other signs, in lower case; a token
equal to the one before it is written as one token REPEAT, whatever it is. N-grams
are runs of so many tokens as `orders` lists, one and two by default, and runs of 2,
4, 8 ... REPEATs. Two generative models over hashed n-grams are counted in documents:
the target from those labelled good and not toxic, the raw one from all. A text's log
importance weight is the sum over its distinct n-grams of log p_target - log p_raw,
where

- both models are scaled to agree on the bulk (the median ratio of frequent
  buckets), so length carries no weight of its own, and
- each log ratio is shrunk twice: SMOOTH documents of prior agreement stand beside the
  counts, and NOISE standard errors of the count are taken off, so rare n-grams without
  evidence add nothing, while common ones add little or much, up or down.

The k rows with the largest keys, weight / temperature + Gumbel noise, are kept:
sampling without replacement in proportion to exp(weight / temperature). k is
`fraction` of the rows that have words; by default the share of good documents
among the labelled ones.

Buckets grow with the root of the texts' bytes, which are counted, so the way the
input is stored changes nothing. Counts are summed by Spark per bucket. Log ratios are
whole millionths, so sums do not depend on their order; up to MOST_HELD of them other
than 0 go to the workers, more are joined to the n-grams of the rows. Labels of at most MOST_LABELLED documents, chosen by hash, are held by the
workers (9 bytes each), so texts are never shuffled. The raw model and k cover all rows.

Defined cases: a null or wordless text has weight 0 and is kept outside of k;
without good labels, or without any label, nothing is rejected; documents labelled
both ways count as bad; repeated rows each count and share their noise, so rows
equal in doc_id and text stay or go together; a null doc_id is scored, too; extra
columns are ignored and pass through kept_rows under any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import BYTE, IS_SPACE, LOWER, any_names, grams, materialize, mix64, parts_for, powers, seeds, slices, spread_join, table, text_bytes

#: Buckets for each root of a byte of text; the standard errors that a log ratio loses and its prior documents.
LOAD, NOISE, SMOOTH, TEMPERATURE, ORDERS = 64, 1.0, 8.0, 1.0, (1, 2)
MOST_LABELLED = 200_000
#: Bytes of input files that one task counts: its buckets are summed before they are shuffled.
COUNTED_TOGETHER = 64 << 20
#: Bytes of text whose n-grams a worker holds at a time.
TOGETHER = 8 << 20
#: Log ratios that workers hold (12 bytes each); more are joined.
MOST_HELD = 1 << 22
REPEAT = seeds(1, 606)
RUNS = seeds(40, 707)

#: 0 white space, 1 letters, digits and bytes of other scripts, 2 other signs.
CLASS = np.full(256, 2, np.uint8)
CLASS[IS_SPACE] = 0
CLASS[48:58] = CLASS[65:91] = CLASS[97:123] = CLASS[128:] = 1


def bucket_bits(docs: DataFrame) -> int:
    """log2 of the number of buckets, by the bytes of all texts."""
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).collect()[0][0] or 1
    return max(12, math.ceil(math.log2(LOAD * math.sqrt(size))))


def tokens(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of concatenated texts and the n + 1 token offsets of the texts."""
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    kind = CLASS[raw]
    new = np.ones(len(raw), bool)
    new[1:] = kind[1:] != kind[:-1]
    heads = off[:-1]
    new[heads[heads < len(raw)]] = True
    run = np.flatnonzero(new)
    span = np.diff(np.append(run, len(raw)))
    at = np.arange(len(raw)) - np.repeat(run, span)
    hashed = mix64(np.add.reduceat(BYTE[LOWER[raw]] * powers(int(span.max()) + 1)[at], run) + span.astype(np.uint64))
    word = kind[run] > 0
    return hashed[word], np.searchsorted(run[word], off).astype(np.int64)


def features(raw: np.ndarray, off: np.ndarray, bits: int, orders: tuple[int, ...] = ORDERS) -> Iterator[np.ndarray]:
    """The distinct buckets of each text's n-grams."""
    shift = np.uint64(64 - bits)
    for a, b in slices(off):
        token, at = tokens(raw[off[a] : off[b]], off[a : b + 1] - off[a])
        again = np.zeros(len(token), bool)
        again[1:] = token[1:] == token[:-1]
        again[at[:-1][at[:-1] < len(token)]] = False
        token = np.where(again, REPEAT[0], token)
        listed = [(n, token if n == 1 else grams(token, n, 40 + n)) for n in orders]
        edge = np.flatnonzero(np.diff(np.concatenate([[0], again.astype(np.int8), [0]])))
        begin, length = edge[::2], edge[1::2] - edge[::2]
        cut = np.searchsorted(begin, at)
        for i in range(b - a):
            lo, hi = at[i], at[i + 1]
            longest = int(length[cut[i] : cut[i + 1]].max(initial=1))
            yield np.unique(np.concatenate([*(g[lo : max(lo, hi - n + 1)] for n, g in listed), RUNS[: longest.bit_length() - 1]]) >> shift).astype(np.int64)


def marks_of(ids: pa.Array, marks: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Of each doc_id: 1 good, 0 bad, -1 without a label."""
    known, good = marks
    out = np.full(len(ids), -1, np.int8)
    if len(known):
        have = ids.is_valid().to_numpy(zero_copy_only=False)
        key = ids.fill_null(0).to_numpy()
        at = np.minimum(np.searchsorted(known, key), len(known) - 1)
        hit = have & (known[at] == key)
        out[hit] = good[at[hit]]
    return out


def count(batches: Iterator[pa.RecordBatch], marks: tuple[np.ndarray, np.ndarray], bits: int, orders: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """(bucket, documents of the target, all documents), summed over some MB of texts at a time."""
    for batch in batches:
        raw, off = text_bytes(batch.column("text"))
        marked = marks_of(batch.column("doc_id"), marks) == 1
        for a, b in slices(off, TOGETHER):
            found = list(features(raw[off[a] : off[b]], off[a : b + 1] - off[a], bits, orders))
            target = np.repeat(marked[a:b], [len(f) for f in found])
            bucket, where = np.unique(np.concatenate(found), return_inverse=True)
            every = np.bincount(where, minlength=len(bucket))
            good = np.bincount(where[target], minlength=len(bucket))
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(good.astype(np.int32)), pa.array(every.astype(np.int32))], names=["bucket", "good", "every"])


def log_ratio(good: Column, every: Column, scale: float) -> Column:
    """log p_target - log p_raw of a bucket, shrunk by its noise."""
    expected = every * scale
    ratio = F.log((good + SMOOTH) / (expected + SMOOTH))
    return F.signum(ratio) * F.greatest(F.lit(0.0), F.abs(ratio) - NOISE / F.sqrt(expected + 1))


def in_millionths(ratio: Column) -> Column:
    return F.round(ratio * 1e6).cast("int")


def weigh(batches: Iterator[pa.RecordBatch], ratios: tuple[np.ndarray, np.ndarray], bits: int, orders: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """The rows with their log weight (null: no words) as the last column."""
    known, ratio = np.append(ratios[0], np.iinfo(np.int64).max), np.append(ratios[1], 0)  # sorted
    for batch in batches:
        raw, off = text_bytes(batch.column(batch.schema.names.index("text")))
        weight, empty = np.zeros(len(batch)), np.ones(len(batch), bool)
        for a, b in slices(off, TOGETHER):
            found = list(features(raw[off[a] : off[b]], off[a : b + 1] - off[a], bits, orders))
            size = np.array([len(f) for f in found], np.int64)
            flat = np.concatenate(found)
            at = np.searchsorted(known, flat)
            total = np.concatenate([[0], np.cumsum(np.where(known[at] == flat, ratio[at], 0), dtype=np.int64)])
            end = np.cumsum(size)
            weight[a:b], empty[a:b] = (total[end] - total[end - size]) / 1e6, size == 0
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(weight, pa.float64(), mask=empty)], names=[*batch.schema.names, "weight"])


def listed(batches: Iterator[pa.RecordBatch], bits: int, orders: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """(mark, bucket) for each n-gram of each row."""
    for batch in batches:
        found = list(features(*text_bytes(batch.column("text")), bits, orders))
        mark = np.repeat(batch.column("mark").to_numpy(), [len(f) for f in found])
        yield pa.RecordBatch.from_arrays([pa.array(mark, pa.int64()), pa.array(np.concatenate(found) if found else mark, pa.int64())], names=["mark", "bucket"])


def weighed(docs: DataFrame, model: tuple) -> DataFrame:
    """docs, whose names any_names() made, and a last column weight (null: no words)."""
    ratios, bits, orders = model
    if not isinstance(ratios, DataFrame):
        kinds = StructType([*docs.schema.fields, StructField("weight", DoubleType())])
        return docs.mapInArrow(lambda it: weigh(it, ratios.value, bits, orders), kinds)
    rows = materialize(docs.withColumn("mark", F.monotonically_increasing_id()))
    grams_of = rows.select("mark", F.col("text").cast("string").alias("text")).mapInArrow(lambda it: listed(it, bits, orders), "mark bigint, bucket bigint")
    total = spread_join(grams_of, ratios, "bucket", "mark").groupBy("mark").agg(F.sum("r").alias("r"))
    has_words = F.coalesce(F.col("text").cast("string").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    weight = F.when(has_words, F.coalesce("r", F.lit(0)) / F.lit(1e6))
    return rows.join(total, "mark", "left").select(*docs.columns, weight.alias("weight"))


def gumbel_key(weight: Column, text: Column, seed: int, temperature: float) -> Column:
    """weight / temperature + Gumbel noise that follows from doc_id and text."""
    noise = F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("bigint"), text, F.lit(seed)), 11).cast("double") / float(1 << 53)
    return weight / temperature - F.log(-F.log(noise * (1 - 2e-16) + 1e-16))


def whole_key(key: Column) -> Column:
    return F.round(key * 1e6).cast("bigint")


def kth_largest(keys: DataFrame, k: int) -> int | None:
    """The k-th largest of the longs in column key, by four countings of 16 bits."""
    if k <= 0:
        return None
    low, left = -(1 << 63), k
    for shift in (48, 32, 16, 0):
        digit = F.shiftrightunsigned(F.col("key") - F.lit(low), shift).cast("int") if shift < 48 else F.shiftright("key", 48).cast("int")
        within = keys if shift == 48 else keys.where((F.col("key") >= low) & (F.col("key") <= low + (1 << (shift + 16)) - 1))
        counts = sorted(((r["d"], r["n"]) for r in within.groupBy(digit.alias("d")).agg(F.count("*").alias("n")).collect()), reverse=True)  # at most 65,536 rows
        for d, n in counts:
            if left <= n:
                low = d << 48 if shift == 48 else low + (d << shift)
                break
            left -= n
        else:
            return None
    return low


def fit(docs: DataFrame, labels: DataFrame, seed: int, orders: tuple[int, ...]) -> tuple[tuple, float]:
    """(log ratios other than 0 as a broadcast, or as a table if they are many; bits; orders), and the share of good documents among the sampled labels."""
    marked = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).alias("good"))
    sample = marked.orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id").limit(MOST_LABELLED).toPandas().sort_values("doc_id")
    share = docs.sparkSession.sparkContext.broadcast
    held = share((sample["doc_id"].to_numpy(np.int64), sample["good"].to_numpy(bool)))
    bits = bucket_bits(docs)
    few = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tasks = parts_for(docs, COUNTED_TOGETHER, docs.sparkSession.sparkContext.defaultParallelism)
    counted = few.coalesce(tasks).mapInArrow(lambda it: count(it, held.value, bits, orders), "bucket bigint, good int, every int")
    counts = materialize(counted.groupBy("bucket").agg(F.sum("good").alias("good"), F.sum("every").alias("every")))
    bulk = counts.where(F.col("every") >= (counts.agg(F.percentile_approx("every", 0.5).alias("m")).collect()[0]["m"] or 1))
    seen = bulk.agg(F.percentile_approx(F.col("good") / F.col("every"), 0.5).alias("median")).collect()[0]
    total = counts.agg((F.sum("good") / F.sum("every")).alias("mean")).collect()[0]["mean"] or 0.0
    scale = seen["median"] or total
    good = float(sample["good"].mean()) if len(sample) and scale else 1.0
    if not scale:
        return (share((np.zeros(0, np.int64), np.zeros(0, np.int32))), bits, orders), good
    told = materialize(counts.select("bucket", in_millionths(log_ratio(F.col("good"), F.col("every"), float(scale))).alias("r")).where("r <> 0"))
    if told.count() > MOST_HELD:
        return (told, bits, orders), good
    held_ratios = told.toPandas().sort_values("bucket")
    return (share((held_ratios["bucket"].to_numpy(np.int64), held_ratios["r"].to_numpy(np.int32))), bits, orders), good


def threshold(scored: DataFrame, fraction: float) -> int | None:
    """scored (key; null: no words) -> the k-th largest key."""
    keyed = scored.where("key IS NOT NULL")
    return kth_largest(keyed, round(fraction * keyed.count()))


def resample(docs: DataFrame, labels: DataFrame, seed: int = 7, temperature: float = TEMPERATURE, fraction: float | None = None, orders: tuple[int, ...] = ORDERS) -> DataFrame:
    """doc_id, weight, gumbel_key, kept: one row per row of docs."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model, good = fit(docs, labels, seed, orders)
    rows = weighed(docs, model)
    scored = materialize(rows.select("doc_id", "weight", gumbel_key(F.col("weight"), F.col("text"), seed, temperature).alias("gumbel_key")))
    least = threshold(scored.select(whole_key(F.col("gumbel_key")).alias("key")), good if fraction is None else fraction)
    kept = F.col("gumbel_key").isNull() | (whole_key(F.col("gumbel_key")) >= least if least is not None else F.lit(False))
    return scored.select("doc_id", F.coalesce("weight", F.lit(0.0)).alias("weight"), "gumbel_key", kept.alias("kept"))


def kept_rows(docs: DataFrame, labels: DataFrame, seed: int = 7, temperature: float = TEMPERATURE, fraction: float | None = None, orders: tuple[int, ...] = ORDERS) -> DataFrame:
    """The rows of docs that resample keeps, all columns.

    Rows are weighed once, into a table with their keys; the threshold filters that table.
    """
    rows = any_names(docs, "doc_id", "text")
    model, good = fit(rows, labels, seed, orders)
    key = whole_key(gumbel_key(F.col("weight"), F.col("text").cast("string"), seed, temperature))
    whole = materialize(weighed(rows, model).select(*rows.columns, key.alias("key")))
    least = threshold(whole.select("key"), good if fraction is None else fraction)
    stays = F.col("key").isNull() | (F.col("key") >= least if least is not None else F.lit(False))
    return whole.where(stays).drop("key").toDF(*docs.columns)


def op4_quality_resample(spark, sf_dir: str) -> DataFrame:
    """The documents that the resampling keeps."""
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.where("kept").select("doc_id", "weight", "gumbel_key", "kept")
