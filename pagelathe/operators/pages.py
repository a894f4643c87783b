"""Pages in and out of files: ranges, splitting, merging, numbering, names, inheritance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut

# Fixed pattern of one range: n, n-m, n to m, n a m, n- (open end).
RANGE = r"(?i)^(\d+)\s*(?:([-–—a]|to)\s*(\d*))?$"


def range_parts(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "[,;]"), lambda p: F.trim(p)), lambda p: p != "")


def parse_ranges(text: Column, total: Column) -> Column:
    """struct<groups array<array<int>>, problems array<string>>: positions from 0, or all distinct problems."""

    def bounds(p: Column) -> tuple[Column, Column]:
        first = F.regexp_extract(p, RANGE, 1).cast("bigint")
        word, second = F.regexp_extract(p, RANGE, 2), F.regexp_extract(p, RANGE, 3)
        return first, F.when(word == "", first).when(second == "", total.cast("bigint")).otherwise(second.cast("bigint"))

    def problem(p: Column) -> Column:
        first, last = bounds(p)
        return (
            F.when(~p.rlike(RANGE), F.concat(F.lit("syntax:"), p))
            .when((first < 1) | (last < 1), F.lit("below-1"))
            .when((first > total) | (last > total), F.concat(F.lit("beyond:"), F.greatest(first, last).cast("string")))
            .when(first > last, F.concat(F.lit("reversed:"), p))
        )

    def pages(p: Column) -> Column:
        first, last = bounds(p)
        return F.when(problem(p).isNull(), F.transform(F.sequence(first, F.greatest(first, last)), lambda i: (i - 1).cast("int")))

    parts = range_parts(text)
    problems = F.when(F.size(parts) == 0, F.array(F.lit("empty"))).otherwise(F.array_distinct(F.filter(F.transform(parts, problem), lambda x: x.isNotNull())))
    groups = F.when(F.size(problems) == 0, F.transform(parts, pages))
    return F.struct(groups.alias("groups"), problems.alias("problems"))


def split_pages(requests: DataFrame, pages: DataFrame) -> DataFrame:
    """requests (doc_id, ranges, total) x pages (doc_id, page_no from 0): rows of the output files in order."""
    parsed = requests.select("doc_id", parse_ranges(F.col("ranges"), F.col("total")).alias("p")).where(F.size("p.problems") == 0)
    wanted = parsed.select("doc_id", F.posexplode("p.groups").alias("file_no", "g")).select("doc_id", "file_no", F.posexplode("g").alias("position", "page_no"))
    return wanted.join(pages, ["doc_id", "page_no"])


def merge_pages(pages: DataFrame) -> DataFrame:
    """Adds position: files one after another, pages in order, from 0 in each output."""
    order = Window.partitionBy("out_id").orderBy("file_no", "page_no")
    return pages.withColumn("position", F.row_number().over(order) - 1)


def number_pages(pages: DataFrame) -> DataFrame:
    """Adds n, total and the label `n de total` that restart in each file."""
    own = Window.partitionBy("file_no")
    out = pages.withColumn("n", F.row_number().over(own.orderBy("position"))).withColumn("total", F.count("*").over(own))
    return out.withColumn("label", F.concat_ws(" ", F.col("n").cast("string"), F.lit("de"), F.col("total").cast("string")))


def output_name(base: Column, first: Column, last: Column, total: Column) -> Column:
    """base-03 or base-03-07, padded to the digits of total; letters that file systems refuse become -."""
    clean = F.regexp_replace(F.regexp_replace(base, r"(?i)\.pdf$", ""), r'[\\/:*?"<>|\x00-\x1f]', "-")
    pad = lambda n: F.lpad(n.cast("string"), F.length(total.cast("string")), F.lit("0"))
    return F.concat(clean, F.lit("-"), pad(first), F.when(last != first, F.concat(F.lit("-"), pad(last))).otherwise(F.lit("")))


def newest_objects(entries: DataFrame) -> DataFrame:
    """doc_id, num, revision, offset: the entry of the newest revision of each object, the last of them on a tie."""
    return entries.groupBy("doc_id", "num").agg(F.max_by("offset", F.struct("revision", "offset")).alias("offset"), F.max("revision").alias("revision"))


def reachable(roots: DataFrame, refs: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """Nodes (doc_id, num) reached from roots along refs (doc_id, src, dst); cycles are fine.

    A frontier loop: each round joins only the nodes found last and writes only what
    is new; what was found is written as one table every few rounds.
    """
    front = roots.select("doc_id", "num").distinct().transform(cut)
    seen = front
    for n in range(1, most_rounds + 1):
        step = front.join(refs.select("doc_id", F.col("src").alias("num"), "dst"), ["doc_id", "num"]).select("doc_id", F.col("dst").alias("num")).distinct()
        front = step.join(seen, ["doc_id", "num"], "left_anti").transform(cut)
        if front.isEmpty():
            return seen
        seen = seen.union(front)
        if n % 8 == 0:  # one table instead of many
            seen = cut(seen)
    raise RuntimeError("reachability did not end")


def carried(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """value, or the last one before it in order that is not null."""
    return rows.withColumn(value, F.last(value, ignorenulls=True).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
