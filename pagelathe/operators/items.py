"""Items of laid out pages (texts, images) against redaction rectangles, letter by letter.

items: page_id, item_no, x, y (of the baseline), text, font, size, rise, word_spacing.
rects: page_id, rect_no, x0, y0, x1, y1 from 0 to 1 of the page before it turns, text.
A page's rectangles are one array, joined once, so no range join is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import glyphs
from .reading import lines_text

# A letter's height around its baseline, and how much of it must be covered.
TOP, BOTTOM, COVER, LEAST_WIDTH = 0.75, 0.22, 0.2, 0.01
BOX_TOP, BOX_BOTTOM, UNDER, UNDER_WIDTH = 0.85, 0.25, 0.3, 0.001


def in_points(rects: DataFrame, width: float, height: float) -> DataFrame:
    """page_id, hits: the rectangles of a page in points."""
    box = F.struct("rect_no", (F.col("x0") * width).alias("x0"), (F.col("y0") * height).alias("y0"), (F.col("x1") * width).alias("x1"), (F.col("y1") * height).alias("y1"), "text")
    return rects.groupBy("page_id").agg(F.array_sort(F.collect_list(box)).alias("hits"))


def letters(items: DataFrame, widths: Column | None = None) -> DataFrame:
    """One row a character: place k and where it begins and how far it goes."""
    listed = F.arrays_zip(F.filter(F.split("text", ""), lambda c: c != "").alias("c"), glyphs.advances(F.col("text"), F.col("font"), F.col("size"), widths, F.col("word_spacing")).alias("wide"))
    rows = items.select("*", F.posexplode(listed).alias("k", "l")).select(*items.columns, "k", F.col("l.c").alias("c"), F.col("l.wide").alias("wide"))
    before = Window.partitionBy("page_id", "item_no").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("at", F.col("x") + F.coalesce(F.sum("wide").over(before), F.lit(0.0)))


def redact_texts(items: DataFrame, rects: DataFrame, width: float, height: float, widths: Column | None = None) -> DataFrame:
    """page_id, item_no, part_no, x, text: what is left of texts, each run of letters where it stood.

    A letter goes if a rectangle covers a share of its height and enters its width.
    """
    return _redacted(items, rects, width, height, widths, [])


def redacted_items(items: DataFrame, rects: DataFrame, width: float, height: float, widths: Column | None = None) -> DataFrame:
    """What is left of texts as redact_texts has it, with the other columns of the items."""
    numbered = items.where("page_id IS NOT NULL AND item_no IS NOT NULL")
    return _redacted(numbered, rects, width, height, widths, [c for c in items.columns if c not in ("page_id", "item_no", "x", "text")])


def _redacted(items: DataFrame, rects: DataFrame, width: float, height: float, widths: Column | None, others: list[str]) -> DataFrame:
    hit = items.join(in_points(rects, width, height), "page_id", "left")
    base = F.col("y") - F.coalesce("rise", F.lit(0.0))
    top, bottom = base - F.col("size") * TOP, base + F.col("size") * BOTTOM
    tall = F.filter(F.coalesce("hits", F.array().cast(hit.schema["hits"].dataType)), lambda r: F.least(bottom, r["y1"]) - F.greatest(top, r["y0"]) >= (bottom - top) * COVER)
    marked = hit.withColumn("hits", tall)
    whole = marked.where(F.size("hits") == 0).select("page_id", "item_no", F.lit(0).alias("part_no"), "x", "text", *others)
    each = letters(marked.where(F.size("hits") > 0), widths)
    covered = F.exists("hits", lambda r: F.least(F.col("at") + F.greatest("wide", F.lit(2 * LEAST_WIDTH)), r["x1"]) - F.greatest(F.col("at"), r["x0"]) > LEAST_WIDTH)
    order = Window.partitionBy("page_id", "item_no").orderBy("k")
    parts = each.withColumn("gone", covered).withColumn("island", F.sum(F.col("gone").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("NOT gone")
    runs = parts.groupBy("page_id", "item_no", "island").agg(F.min_by("at", "k").alias("x"), F.array_join(F.array_sort(F.collect_list(F.struct("k", "c")))["c"], "").alias("text"), *[F.first(c).alias(c) for c in others])
    runs = runs.where(F.trim("text") != "").withColumn("part_no", F.row_number().over(Window.partitionBy("page_id", "item_no").orderBy("island")) - 1)
    return whole.unionByName(runs.select("page_id", "item_no", "part_no", "x", "text", *others))


def image_areas(images: DataFrame, rects: DataFrame, width: float, height: float) -> DataFrame:
    """images (page_id, item_no, x, y, w, h) -> page_id, item_no, rect_no and the area to paint, from 0 to 1 of the image."""
    hit = images.join(in_points(rects, width, height), "page_id").select("*", F.explode("hits").alias("r")).where("r.x0 < x + w AND x < r.x1 AND r.y0 < y + h AND y < r.y1")
    low = lambda a, b, c: F.greatest(F.lit(0.0), (F.col(a) - F.col(b)) / F.col(c))
    high = lambda a, b, c: F.least(F.lit(1.0), (F.col(a) - F.col(b)) / F.col(c))
    return hit.select("page_id", "item_no", "r.rect_no", low("r.x0", "x", "w").alias("x0"), low("r.y0", "y", "h").alias("y0"), high("r.x1", "x", "w").alias("x1"), high("r.y1", "y", "h").alias("y1"))


def boxes(items: DataFrame, width: float, height: float, widths: Column | None = None) -> DataFrame:
    """The items with the box of their text, from 0 to 1."""
    base = F.col("y") - F.coalesce("rise", F.lit(0.0))
    wide = F.aggregate(glyphs.advances(F.col("text"), F.col("font"), F.col("size"), widths, F.col("word_spacing")), F.lit(0.0), lambda a, x: a + x)
    return items.select("*", (F.col("x") / width).alias("x0"), ((F.col("x") + wide) / width).alias("x1"), ((base - F.col("size") * BOX_TOP) / height).alias("y0"), ((base + F.col("size") * BOX_BOTTOM) / height).alias("y1"))


def left_under(found: DataFrame, rects: DataFrame) -> DataFrame:
    """Boxes (page_id, text, x0..y1) that a rectangle still covers, unless they are part of its own text: none means a page is clean."""
    return _with_left(found, rects).where("left_under").drop("left_under")


def _with_left(found: DataFrame, rects: DataFrame) -> DataFrame:
    """The boxes with left_under, whether they are what left_under() gives."""
    rects = rects.groupBy("page_id").agg(F.collect_list(F.struct("x0", "y0", "x1", "y1", "text")).alias("hits"))
    under = lambda r: (F.least(F.col("x1"), r["x1"]) - F.greatest(F.col("x0"), r["x0"]) > UNDER_WIDTH) & (F.least(F.col("y1"), r["y1"]) - F.greatest(F.col("y0"), r["y0"]) > UNDER * (F.col("y1") - F.col("y0")))
    flat = lambda t: F.trim(F.regexp_replace(t, r"\s+", " "))
    hits = F.filter("hits", under)
    own = F.exists(hits, lambda r: F.coalesce(F.contains(flat(r["text"]), flat(F.col("text"))), F.lit(False)))
    return found.join(rects, "page_id", "left").withColumn("left_under", F.coalesce((F.size(hits) > 0) & ~own, F.lit(False))).drop("hits")


def clean_texts(items: DataFrame, rects: DataFrame, width: float, height: float, widths: Column | None = None) -> DataFrame:
    """page_id, text, clean: the lines of a page without what is under rectangles; text is null where the check still finds some."""
    boxed = _with_left(boxes(redacted_items(items, rects, width, height, widths), width, height, widths), rects)
    number = (F.col("item_no") * 1000 + F.col("part_no")).alias("box_no")
    pages = lines_text(boxed.select("page_id", number, F.col("text").alias("str"), "x0", "y0", "x1", "y1", F.lit(width).alias("page_width"), F.lit(height).alias("page_height"), "left_under"), "left_under")
    return pages.select("page_id", F.when(~F.col("left_under"), F.col("text")).alias("text"), (~F.col("left_under")).alias("clean"))
