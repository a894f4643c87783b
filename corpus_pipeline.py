"""The corpus pipeline: stages over the columns of `documents`, each written and reread.

run(spark, sf_dir) applies STAGES in order. Every stage but the last returns the
columns of its input, so unknown columns pass through, whatever their names.

Decisions hold for rows, not for doc_ids. Defined cases, for every stage: an empty
table gives an empty one; a null or empty text is kept (its pieces are null or none);
rows without doc_id are judged like any other but are never near-duplicates of
others; rows that repeat exactly, or in the same near-duplicate group, leave one: that
with the smallest doc_id; very long texts are read whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelathe.llm.common import any_names, materialize, table
from pagelathe.llm.decontam import benchmark_leaks
from pagelathe.llm.minhash import clusters
from pagelathe.llm.pieces import encode
from pagelathe.llm.pii import find_personal_data, mask_texts
from pagelathe.llm.quality import kept_rows


def numbered(docs: DataFrame) -> DataFrame:
    """The rows of docs with a number of their own, `key`, as a table; names as any_names() makes them."""
    return materialize(any_names(docs, "doc_id", "text").withColumn("key", F.monotonically_increasing_id()))


def plain(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs from its numbered rows."""
    return rows.drop("key").toDF(*docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier's resampling keeps."""
    return kept_rows(docs, table(spark, sf_dir, "labels"))


def keep_first_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: that with the smallest doc_id. Five-word shingles, the rule where no contract says otherwise."""
    rows = numbered(docs)
    found = clusters(rows, shingle=5, percent=80, row="key")
    first = found.where("cluster IS NOT NULL").groupBy("cluster").agg(F.min(F.struct("doc_id", "row")).alias("first")).select(F.col("first.row").alias("key"))
    kept = first.union(found.where("cluster IS NULL").select("row"))
    return plain(rows.join(kept, "key", "left_semi"), docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a benchmark item."""
    rows = numbered(docs)
    leaks = benchmark_leaks(rows.select(F.col("key").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return plain(rows.join(leaks.select(F.col("doc_id").alias("key")).distinct(), "key", "left_anti"), docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each personal datum becomes its kind in angle brackets; n_chars follows."""
    done = mask_texts(docs)
    if done is None:
        return mask_by_join(docs)
    return with_length(done)


def with_length(docs: DataFrame) -> DataFrame:
    """n_chars, if there, follows the text."""
    if "n_chars" not in docs.columns:
        return docs
    rows = any_names(docs, "text", "n_chars")
    return rows.withColumn("n_chars", F.length(F.col("text").cast("string")).cast(docs.schema["n_chars"].dataType)).toDF(*docs.columns)


def mask_by_join(docs: DataFrame) -> DataFrame:
    """The same with the spans of each row joined to it: for more patterns than workers may hold."""
    rows = numbered(docs)
    found = find_personal_data(rows, key="key")
    # where spans overlap, the one that starts first is masked
    listed = F.transform(F.filter(F.split("base", ","), lambda s: s != ""), lambda s: F.struct(F.split_part(s, F.lit(":"), F.lit(2)).cast("int").alias("a"), F.split_part(s, F.lit(":"), F.lit(3)).cast("int").alias("b"), F.upper(F.split_part(s, F.lit(":"), F.lit(1))).alias("kind")))
    more = F.transform("added", lambda s: F.struct(s["start"].cast("int").alias("a"), s["stop"].cast("int").alias("b"), F.lit("CONTEXT").alias("kind")))
    joined = rows.join(found.select("key", F.array_sort(F.concat(listed, more)).alias("spans")), "key")
    text = F.col("text").cast("string")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    step = lambda acc, s: F.when(s["a"] < acc["at"], acc).otherwise(
        F.struct(s["b"].alias("at"), F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, s["a"] - acc["at"]), F.lit("<"), s["kind"], F.lit(">"))).alias("out"))
    )
    done = F.aggregate("spans", start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    masked = joined.withColumn("text", F.when(F.size("spans") > 0, done).otherwise(text))
    return with_length(plain(masked.drop("spans"), docs))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the best segmentation, the others with the scores of all, and whether all decode to the text."""
    return encode(docs).select("doc_id", "pieces", "n_pieces", "ids_sha256", "others", "scores", "round_trip")


STAGES = [
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", keep_first_of_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("PII", mask_personal_data),
    ("SentencePiece encoding and decoding", encode_pieces),
]

#: SQL can't express the stages: they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = [lambda docs, f=f: f(spark, docs, sf_dir) for _, f in STAGES]
    return reduce(lambda docs, f: materialize(f(docs)), stages[:-1], table(spark, sf_dir, "documents")).transform(stages[-1])
