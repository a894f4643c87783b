"""Shared pieces of the corpus operators: tables, checkpoints, byte-level hashing.

Hashes are 64-bit and computed on UTF-8 bytes with wrapping arithmetic; every
worker computes the same value for the same bytes.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that numpy works on at a time; keeps temporary arrays near cache size.
SLICE_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus, read by Spark alone so any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Where none is set a local master gets one of its own; a cluster gets an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        have = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = have.get() if have.isDefined() else None
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="corpus-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it back.

    A lost executor later costs a reread, not a recomputation. Parquet is
    compressed, which a plain checkpoint() is not. The table goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpus-tables/{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    df.write.option("compression", "zstd").parquet(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def input_bytes(df: DataFrame) -> int:
    """Bytes of df as the optimizer estimates them from file sizes; where it can't, the bytes of the texts."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size < 1 << 60:
        return size
    return int(df.agg(F.sum(F.octet_length(F.col("text").cast("string")))).collect()[0][0] or 0)


def parts_for(df: DataFrame, bytes_each: int, least: int = 1) -> int:
    """How many groups of about bytes_each the input makes."""
    return max(least, -(-input_bytes(df) // bytes_each))


def any_names(docs: DataFrame, *needed: str) -> DataFrame:
    """docs with names that nothing can clash with or misread, but for the needed ones; toDF(*docs.columns) brings them back."""
    return docs.toDF(*[c if c in needed else f"column {k}" for k, c in enumerate(docs.columns)])


#: Tasks that the rows of one join key are dealt over.
WAYS = 16


def spread_join(left: DataFrame, right: DataFrame, key: str | list[str], by: str, ways: int = WAYS) -> DataFrame:
    """left joined with right; the left rows of a hot key are dealt over `ways` tasks by another column, right rows go to all."""
    keys = [key] if isinstance(key, str) else key
    salted = left.withColumn("way", F.pmod(F.xxhash64(by), F.lit(ways)).cast("int"))
    copied = right.withColumn("way", F.explode(F.sequence(F.lit(0), F.lit(ways - 1))))
    return salted.join(copied, [*keys, "way"]).drop("way")


#: Bits of a filter for each of its keys, and keys beyond which no filter is made.
BITS_EACH, MOST_FILTERED = 16, 1 << 22


def maybe_in(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """rows with `maybe`: false where no row of keys has their key, true for all others and about one in 16 of these.

    What follows need not shuffle the rows that are out. Only the bits are broadcast, 64 to
    a row; with more than MOST_FILTERED keys all rows are told maybe.
    """
    n = keys.count()
    if n > MOST_FILTERED:
        return rows.withColumn("maybe", F.lit(True))
    place = F.pmod(F.xxhash64(key), F.lit(64 * max(1, n * BITS_EACH // 64)))
    word, bit = F.shiftright(place, 6).alias("_word"), place.bitwiseAND(F.lit(63)).cast("int").alias("_bit")
    bits = keys.select(word, bit).groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits"))
    told = rows.select("*", word, bit).join(F.broadcast(bits), "_word", "left")
    return told.withColumn("maybe", F.coalesce(F.getbit("_bits", "_bit") == 1, F.lit(False))).drop("_word", "_bit", "_bits")


# --- hashing ---------------------------------------------------------------


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer; works on a copy."""
    x = np.array(x, dtype=np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeds(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit constants that follow from the seed."""
    base = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix64(base + np.uint64(seed)) | np.uint64(1)


BYTE = seeds(256, 11)
#: The white space that ends a word: x20 and x09 to x0D.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
WORD_BYTE = np.where(IS_SPACE, np.uint64(0), BYTE)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_P = np.uint64(0xD6E8FEB86659FD93)
_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of the hash base, kept between calls."""
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 2 * len(_powers), 1024), _P, dtype=np.uint64)
        grown[0] = 1
        _powers = np.multiply.accumulate(grown)
    return _powers[:n]


# --- texts of an Arrow batch ------------------------------------------------


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 offsets; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def slices(off: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts together have about size bytes, one row at least."""
    n, a = len(off) - 1, 0
    while a < n:
        b = int(np.searchsorted(off, off[a] + size, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of concatenated texts.

    Returns each word's hash, first byte, end byte, and the n + 1 word offsets of
    the texts. Words never cross from one text into the next.
    """
    if not len(raw):
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, np.zeros(len(off), np.int64)
    inside = ~IS_SPACE[raw]
    begins = np.empty(len(raw), bool)
    begins[0] = True
    np.logical_not(inside[:-1], out=begins[1:])
    heads = off[:-1]
    begins[heads[heads < len(raw)]] = True
    begins &= inside
    start = np.flatnonzero(begins)
    if not len(start):
        return np.zeros(0, np.uint64), start, start, np.zeros(len(off), np.int64)
    stops = np.empty(len(raw), bool)
    stops[-1] = True
    np.logical_not(inside[1:], out=stops[:-1])
    tails = off[1:] - 1
    stops[tails[tails >= 0]] = True
    stops &= inside
    end = np.flatnonzero(stops) + 1
    span = np.diff(np.append(start, len(raw)))
    at = np.arange(len(raw) - start[0], dtype=np.int64) - np.repeat(start - start[0], span)
    value = WORD_BYTE[raw[start[0] :]]
    value *= powers(int(at.max()) + 1)[at]
    hashed = mix64(np.add.reduceat(value, start - start[0]) + (end - start).astype(np.uint64))
    return hashed, start, end, np.searchsorted(start, off).astype(np.int64)


def grams(word: np.ndarray, n: int, seed: int = 3) -> np.ndarray:
    """Hashes of all runs of n consecutive words; run i starts at word i."""
    if len(word) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(word) - n + 1, np.uint64)
    for k, a in enumerate(seeds(n, seed)):
        total += word[k : len(word) - n + 1 + k] * a
    return mix64(total)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def column_like(df: DataFrame, **kinds: str) -> DataFrame:
    """Only the named columns, cast to the given types: extra columns never clash."""
    return df.select(*[F.col(f"`{k}`").cast(v).alias(k) for k, v in kinds.items()])
