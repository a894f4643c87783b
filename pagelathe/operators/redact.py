"""Words and boxes against redaction rectangles: one equi-join a page, ranges inside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.boxes import columns, inside, overlaps, under


def drop_words(words: DataFrame, rects: DataFrame) -> DataFrame:
    """Words that no rectangle of their page overlaps; a line ends where words went.

    words: page_id, word_no, text, x0, y0, x1, y1, last. A kept word becomes the
    last of its line if the next word went, or if a rectangle overlaps the box that
    spans it and the next kept word.
    """
    sides = ("x0", "y0", "x1", "y1")
    listed = rects.groupBy("page_id").agg(F.collect_list(F.struct(*sides)).alias("rects"))
    hit = lambda box: F.coalesce(F.exists("rects", lambda r: overlaps(box, {c: r[c] for c in sides})), F.lit(False))
    order = Window.partitionBy("page_id").orderBy("word_no")
    # one shuffle by page: the rectangles come as an array, both windows keep the partitioning
    marked = words.join(listed, "page_id", "left").withColumn("gone", hit({c: F.col(c) for c in sides}))
    kept = marked.withColumn("cut", F.coalesce(F.lead("gone").over(order), F.lit(False))).where("NOT gone")
    for c in sides:
        kept = kept.withColumn(f"n{c}", F.lead(c).over(order))
    span = {c: (F.least if c in ("x0", "y0") else F.greatest)(c, f"n{c}") for c in sides}
    split = F.col("nx0").isNotNull() & hit(span)
    return kept.select("page_id", "word_no", "text", (F.col("last") | F.col("cut") | split).alias("last"))


def leaks(boxes: DataFrame, rects: DataFrame) -> DataFrame:
    """Text boxes under a rectangle, unless the text is part of a replacement text there.

    boxes: page_id, box_no, str, x0..y1; rects: page_id, x0..y1, text (may be null).
    """
    hits = boxes.alias("b").join(rects.alias("r"), (F.col("b.page_id") == F.col("r.page_id")) & under(columns("b"), columns("r")))
    allowed = F.coalesce(F.contains(F.col("r.text"), F.trim("b.str")), F.lit(False))
    return hits.where(F.trim("b.str") != "").groupBy("b.page_id", "b.box_no", "b.str").agg(F.bool_or(allowed).alias("allowed")).where("NOT allowed").select("page_id", "box_no", "str")


def new_findings(findings: DataFrame, rects: DataFrame) -> DataFrame:
    """Findings not inside a rectangle that is already there."""
    f, r = columns("f"), columns("r")
    return findings.alias("f").join(rects.alias("r"), (F.col("f.page_id") == F.col("r.page_id")) & inside(f, r), "left_anti")


def grouped_findings(findings: DataFrame) -> DataFrame:
    """page_id, type, value -> number of rectangles, the list of them in reading order, and their union."""
    listed = F.array_sort(F.collect_list(F.struct("y0", "x0", "y1", "x1"))).alias("rects")
    return findings.groupBy("page_id", "type", "value").agg(F.count("*").alias("n_rects"), listed, F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
