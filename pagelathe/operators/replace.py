"""Texts that replace others: the mark over a target, its width for a new text, the text's size and place in it.

Places run from 0 to 1 on a page whose width and height are columns too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import glyphs

# Room around a target in heights; a line's height, room around a text and least width in sizes of the letter.
ROOM, LINE, PAD, LEAST_WIDTH = 0.12, 1.25, 0.2, 0.5


def width_arrays(metrics: DataFrame) -> DataFrame:
    """metrics (font, code, width) -> font, widths: thousandths by code from 32 on, 0 where a font has none.

    The smallest of several widths of one code counts; codes outside of 32 to 255 and nulls don't.
    """
    one = metrics.where(F.col("code").between(32, 255) & F.col("width").isNotNull() & F.col("font").isNotNull()).groupBy("font", "code").agg(F.min("width").cast("int").alias("width"))
    by_code = one.groupBy("font").agg(F.map_from_entries(F.collect_list(F.struct(F.col("code").cast("int"), "width"))).alias("m"))
    return by_code.select("font", F.transform(F.sequence(F.lit(32), F.lit(255)), lambda c: F.coalesce(F.try_element_at("m", c), F.lit(0))).alias("widths"))


def unit_size(text: Column, font: Column, widths: Column | None = None) -> Column:
    """struct<width, height> of a text of several lines with letters of size 1, room included; null for a null text."""
    table = F.create_map(font, widths) if widths is not None else None
    lines = F.split(text, "\n")
    wide = F.array_max(F.transform(lines, lambda line: glyphs.text_width(line, font, F.lit(1.0), table)))
    return F.when(text.isNotNull(), F.struct((F.greatest(wide, F.lit(LEAST_WIDTH)) + 2 * PAD).alias("width"), (F.size(lines) * LINE + 2 * PAD).alias("height")))


def marks(targets: DataFrame) -> DataFrame:
    """targets (x0..y1, size, page_width, page_height; size null: unknown) with x0..y1 as the mark that covers them, kept on the page."""
    tall = (F.col("y1") - F.col("y0")) * ROOM
    aside = F.when(F.col("size") > 0, F.col("size") * PAD).otherwise(tall) * F.col("page_height") / F.col("page_width")
    held = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    return targets.withColumns({"x0": held(F.col("x0") - aside), "y0": held(F.col("y0") - tall), "x1": held(F.col("x1") + aside), "y1": held(F.col("y1") + tall)})


def fitted(marked: DataFrame, fonts: DataFrame | None = None) -> DataFrame:
    """marked (x0..y1, size, page_width, page_height, text, family) with x1 of the mark, grew, and edit: struct<x0..y1, points> of the new text.

    A mark of a known size grows to the right, up to the page's side, and never shrinks;
    the text takes that size or the largest that still fits the width. Without a size it
    is the largest that fits both ways. fonts (font, widths) as of width_arrays; a font
    that is not there has fixed widths. A blank text, and a mark without extent, gives a
    null edit. Other columns pass.
    """
    rows = marked.withColumn("text", F.regexp_replace("text", r"\s+$", "")).withColumn("font", glyphs.font_name(F.col("family"), F.lit(False), F.lit(False)))
    rows = rows.join(fonts.select("font", "widths"), "font", "left") if fonts is not None else rows
    rows = rows.withColumn("unit", unit_size(F.col("text"), F.col("font"), F.col("widths") if fonts is not None else None))
    known, said = F.coalesce(F.col("size") > 0, F.lit(False)), F.coalesce(F.trim("text") != "", F.lit(False))
    points = F.col("size") * F.col("page_height")
    right = F.when(known & said, F.least(F.lit(1.0), F.col("x0") + F.col("unit.width") * points / F.col("page_width")))
    grew = F.coalesce(right > F.col("x1") + 1e-9, F.lit(False))
    rows = rows.withColumn("grew", grew).withColumn("x1", F.when(F.col("grew"), right).otherwise(F.col("x1")))
    w, h = (F.col("x1") - F.col("x0")) * F.col("page_width"), (F.col("y1") - F.col("y0")) * F.col("page_height")
    size = F.least(w / F.col("unit.width"), F.when(known, points).otherwise(h / F.col("unit.height")))
    rows = rows.withColumn("points", size)
    top = F.col("y0") + (h - F.col("points") * F.col("unit.height")) / 2 / F.col("page_height")
    edit = F.struct(F.col("x0"), top.alias("y0"), (F.col("x0") + F.col("points") * F.col("unit.width") / F.col("page_width")).alias("x1"), (top + F.col("points") * F.col("unit.height") / F.col("page_height")).alias("y1"), "points")
    return rows.withColumn("edit", F.when(said & (F.col("points") > 0), edit)).drop("unit", "points", "widths")
