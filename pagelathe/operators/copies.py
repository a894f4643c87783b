"""Copying pages between files: the objects they need, with numbers of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut

#: Bits of a row: so many files whose numbers lie side by side; and the block of the file without a number.
BITS, NO_FILE = 64, 1 << 58


def dense_numbers(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """Adds number: 1, 2, 3 ... in each group by order, without bringing a group into one task.

    Rows are dealt by ranges, so a part holds a stretch of the order; numbers within a
    part are moved on by the sizes of the parts before it.
    """
    by = [F.col(c).asc_nulls_last() for c in order]
    dealt = cut(rows.repartitionByRange(group, *by).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy(group, "_part").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(F.col(group).alias("_group"), F.col("_part").alias("_of"), before.alias("_before"))
    own = F.row_number().over(Window.partitionBy(group, "_part").orderBy(*by))
    met = (F.col("_part") == F.col("_of")) & F.col(group).eqNullSafe(F.col("_group"))
    return dealt.withColumn("_own", own).join(offsets, met).withColumn("number", F.col("_own") + F.col("_before")).drop("_part", "_own", "_before", "_group", "_of")


def file_bits(rows: DataFrame) -> DataFrame:
    """(file_no, doc_id, num) -> (doc_id, num, block, bits): one row for every BITS files of an object."""
    block, bit = F.coalesce(F.shiftright("file_no", 6), F.lit(NO_FILE)), F.expr("shiftleft(1L, cast(coalesce(file_no, 0) & 63 as int))")
    return rows.select("doc_id", "num", block.alias("block"), bit.alias("bits")).groupBy("doc_id", "num", "block").agg(F.bit_or("bits").alias("bits"))


def files_of(rows: DataFrame) -> DataFrame:
    """The rows of (block, bits) once a file: file_no in their place."""
    told = rows.withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(BITS - 1)))).where(F.getbit("bits", "bit") == 1)
    return told.withColumn("file_no", F.when(F.col("block") < NO_FILE, F.col("block") * BITS + F.col("bit"))).drop("block", "bits", "bit")


def needed_objects(wanted: DataFrame, refs: DataFrame, pages: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """wanted (file_no, doc_id, num): the pages of each new file; refs (doc_id, src, dst); pages (doc_id, num): all pages.

    Everything that a file's pages reach, each object once for every BITS files: doc_id, num,
    block, bits. References never lead into other pages: those of the file are there from
    the start, others stay out. A round follows the references of what the last one added,
    for all files of a row at once.
    """
    inner = refs.where("dst IS NOT NULL").join(pages.select("doc_id", F.col("num").alias("dst")), ["doc_id", "dst"], "left_anti")
    inner = inner.select("doc_id", F.col("src").alias("num"), "dst").transform(cut)
    key, none = ["doc_id", "num", "block"], F.lit(0).cast("bigint")
    state = file_bits(wanted).select(*key, none.alias("old"), F.col("bits").alias("new")).transform(cut)
    for _ in range(most_rounds):
        step = state.where("new <> 0").join(inner, ["doc_id", "num"]).select("doc_id", F.col("dst").alias("num"), "block", none.alias("old"), "new")
        met = state.select(*key, F.col("old").bitwiseOR(F.col("new")).alias("old"), none.alias("new")).unionByName(step)
        met = met.groupBy(*key).agg(F.bit_or("old").alias("old"), F.bit_or("new").alias("new"))
        state = met.select(*key, "old", F.col("new").bitwiseAND(F.bitwise_not("old")).alias("new")).transform(cut)
        if state.where("new <> 0").isEmpty():
            return state.select(*key, F.col("old").alias("bits"))
    raise RuntimeError("the objects of a page did not end")


def copied_pages(wanted: DataFrame, refs: DataFrame, pages: DataFrame) -> DataFrame:
    """file_no, new_num, doc_id, num, refs: the objects of each new file, renumbered, and the new numbers that they refer to.

    Objects follow the order of their files and old numbers, nulls last; references to what
    is not in the file are left out. file_no, doc_id and num are longs.
    """
    refs = refs.select("doc_id", "src", "dst").distinct().transform(cut)
    found = needed_objects(wanted, refs, pages)
    objects = dense_numbers(files_of(found), "file_no", "doc_id", "num").select("file_no", "doc_id", "num", "number").transform(cut)
    links = files_of(found.join(refs.withColumnRenamed("src", "num"), ["doc_id", "num"]))
    targets = links.withColumnsRenamed({"num": "src", "dst": "num"}).join(objects, ["file_no", "doc_id", "num"])
    told = targets.groupBy("file_no", "doc_id", F.col("src").alias("num")).agg(F.sort_array(F.collect_list("number")).alias("refs"))
    rows = objects.withColumnRenamed("number", "new_num").join(told, ["file_no", "doc_id", "num"], "left")
    return rows.select("file_no", "new_num", "doc_id", "num", F.coalesce("refs", F.array().cast("array<bigint>")).alias("refs"))
