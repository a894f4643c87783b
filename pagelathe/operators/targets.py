"""Targets of a touch: neighbouring pieces of text as phrases, by islands."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values, in heights of the text: gaps within a phrase of words and of pieces, from where on a blank stands, how much sizes may differ.
GAP_WORDS, GAP_PIECES, BLANK, SAME_SIZE = 0.6, 0.08, 0.15, 1.35


def text_targets(pieces: DataFrame) -> DataFrame:
    """pieces (page_id, piece_no, str, x0..y1, line, words, family) -> page_id, target_no, text, x0..y1: the phrases of each page, in reading order.

    Lines are the numbers that pieces bring, or islands of heights: from the top, a piece
    opens a line where all before it have ended above its middle. Along a line a piece
    opens a phrase where the gap behind everything before it is wide, or where it differs
    in size or family from the piece before. Windows only; a page's lines are its groups.
    """
    text = F.trim(F.regexp_replace("str", r"\s+", " "))
    tall = F.col("y1") - F.col("y0")
    rows = pieces.withColumn("str", text).where((F.col("str") != "") & (F.col("x1") > F.col("x0")) & (tall > 0)).withColumn("middle", (F.col("y0") + F.col("y1")) / 2).withColumn("tall", tall)
    down = Window.partitionBy("page_id", "line").orderBy("middle", "x0", "piece_no")
    reach = F.max("y1").over(down.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("opens", F.when(F.col("line").isNull() & (F.coalesce(reach, F.lit(float("-inf"))) <= F.col("middle")), 1).otherwise(0))
    rows = rows.withColumn("island", F.sum("opens").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    line = Window.partitionBy("page_id", "line", "island")
    along = line.orderBy("x0", "piece_no")
    before = lambda c: F.lag(c).over(along)
    gap = F.col("x0") - F.max("x1").over(along.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.select("*", gap.alias("gap"), before("tall").alias("tall_before"), (before("words") & F.col("words")).alias("both"), (before("family").eqNullSafe(F.col("family"))).alias("same"))
    least = F.least("tall", "tall_before")
    near = F.col("gap") < F.when(F.col("both"), GAP_WORDS).otherwise(GAP_PIECES) * least
    ratio = F.col("tall_before") / F.col("tall")
    joins = F.coalesce(near & F.col("same") & (ratio < SAME_SIZE) & (ratio > 1 / SAME_SIZE), F.lit(False))
    rows = rows.withColumn("joins", joins).withColumn("phrase", F.sum(F.when(F.col("joins"), 0).otherwise(1)).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    part = F.when(F.col("joins") & (F.coalesce("both", F.lit(False)) | (F.col("gap") > BLANK * least)), F.concat(F.lit(" "), "str")).otherwise(F.col("str"))
    ordered = F.array_sort(F.collect_list(F.struct("x0", "piece_no", part.alias("part"))))
    found = rows.groupBy("page_id", "line", "island", "phrase").agg(ordered.alias("parts"), *[pick(c).alias(c) for pick, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))])
    number = F.row_number().over(Window.partitionBy("page_id").orderBy("y0", "x0", "line", "island", "phrase")) - 1
    return found.select("page_id", number.alias("target_no"), F.array_join("parts.part", "").alias("text"), "x0", "y0", "x1", "y1")
