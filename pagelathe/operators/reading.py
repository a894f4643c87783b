"""Words of recognised pages: quality, noise, best reading, lines, lines from boxes."""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
WEAK_BELOW, MEAN_BELOW, WEAK_OVER, NOISE_BELOW, SPACE_GAP = 70, 82, 0.2, 50, 0.15


def quality(words: DataFrame) -> DataFrame:
    """page_id -> mean confidence weighted by letters, and the share of letters in weak words."""
    n = F.length("text")
    return words.groupBy("page_id").agg(
        (F.sum(n * F.col("confidence")) / F.sum(n)).alias("mean"), (F.sum(F.when(F.col("confidence") < WEAK_BELOW, n).otherwise(0)) / F.sum(n)).alias("weak")
    )


def low_confidence(words: DataFrame) -> DataFrame:
    return quality(words).where((F.col("mean") < MEAN_BELOW) | (F.col("weak") > WEAK_OVER))


def without_noise(words: DataFrame) -> DataFrame:
    """Drops words of low confidence without a letter, digit or useful sign."""
    return words.where(~(~F.col("text").rlike(r"[\p{L}\p{N}§&%$@#]") & (F.col("confidence") < NOISE_BELOW)))


def best_reading(readings: DataFrame) -> DataFrame:
    """page_id, reading, words -> the reading with most letters in sure words, the smaller on a tie."""
    good = readings.groupBy("page_id", "reading").agg(F.sum(F.when(F.col("confidence") >= WEAK_BELOW, F.length("text")).otherwise(0)).alias("good"))
    return good.groupBy("page_id").agg(F.max_by("reading", F.struct("good", -F.col("reading"))).alias("reading"), F.max("good").alias("good"))


def line_numbers(words: DataFrame) -> DataFrame:
    """Adds line_no: a word after one marked last begins a line."""
    order = Window.partitionBy("page_id").orderBy("word_no")
    before = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = F.coalesce(F.lag(F.col("last").cast("int")).over(order), F.lit(0))
    return words.withColumn("_e", ends).withColumn("line_no", F.sum("_e").over(before)).drop("_e")


def plain_text(words: DataFrame) -> DataFrame:
    """page_id -> the text: words by blanks, lines by newlines, empty words left out."""
    full = line_numbers(words).withColumn("text", F.trim("text")).where("text <> ''")
    lines = full.groupBy("page_id", "line_no").agg(F.array_sort(F.collect_list(F.struct("word_no", "text"))).alias("w"))
    lines = lines.select("page_id", "line_no", F.array_join("w.text", " ").alias("line"))
    return lines.groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("line_no", "line")))["line"], "\n").alias("text"))


def joined_lines(rows: list[tuple]) -> str:
    """Boxes of a page as (middle, height, x0, x1, str, ...), by middle -> its text.

    A box stays on the line whose first box has its middle near; blanks come from gaps.
    """
    lines: list[list[tuple]] = []
    for row in rows:
        if lines and abs(row[0] - lines[-1][0][0]) < min(row[1], lines[-1][0][1]) / 2:
            lines[-1].append(row)
        else:
            lines.append([row])
    out = []
    for line in lines:
        parts, end, last = [], float("-inf"), " "
        for _, tall, x0, x1, s, *_ in sorted(line, key=itemgetter(2)):
            if x0 - end > SPACE_GAP * tall and not last.isspace() and not s[0].isspace():
                parts.append(" ")
            parts.append(s)
            last, end = s[-1], max(end, x1)
        if text := " ".join("".join(parts).split()):
            out.append(text)
    return "\n".join(out)


def _page_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages with their boxes -> their texts."""
    for batch in batches:
        boxes, texts, end = batch.column("boxes").flatten(), [], 0
        columns = [boxes.field(c) for c in ("middle", "tall", "x0", "x1", "str", "box_no")]
        for n in batch.column("boxes").value_lengths().to_pylist():
            rows = zip(*(c.slice(end, n).to_pylist() for c in columns), strict=True)
            texts.append(joined_lines(sorted(rows, key=itemgetter(0, 5))))
            end += n
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(texts, pa.string()), *batch.columns[2:]], names=["page_id", "text", *batch.schema.names[2:]])


def lines_text(boxes: DataFrame, flag: str | None = None) -> DataFrame:
    """boxes (page_id, box_no, str, x0..y1, page_width, page_height) -> page_id, text, flag (true if that of any box is). One shuffle, none of boxes that are dealt by page; a page at a time is sorted and read."""
    tall = (F.col("y1") - F.col("y0")) * F.col("page_height")
    box = F.struct(((F.col("y0") + F.col("y1")) * F.col("page_height") / 2).alias("middle"), "box_no", tall.alias("tall"), (F.col("x0") * F.col("page_width")).alias("x0"), (F.col("x1") * F.col("page_width")).alias("x1"), "str")
    rows = boxes.where("page_id IS NOT NULL").groupBy(F.col("page_id").cast("bigint").alias("page_id")).agg(F.collect_list(F.when(F.trim("str") != "", box)).alias("boxes"), *[F.max(c).alias(c) for c in [flag] if c])
    return rows.where(F.size("boxes") > 0).mapInArrow(_page_texts, "page_id bigint, text string" + (f", {flag} boolean" if flag else ""))


def nearest_label(fields: DataFrame, pieces: DataFrame) -> DataFrame:
    """The piece nearest to the left of a field on its line, else the nearest above.

    fields: page_id, field_no, x0..y1; pieces: page_id, piece_no, str, x0..y1.
    """
    tall = 0.25
    f, p = (lambda c: F.col(f"f.{c}")), (lambda c: F.col(f"p.{c}"))
    fields = fields.withColumn("band", F.explode(F.sequence(F.floor((F.col("y0") - tall) / tall), F.floor(F.col("y1") / tall))))
    pieces = pieces.withColumn("band", F.floor((F.col("y0") + F.col("y1")) / 2 / tall))
    middle = (p("y0") + p("y1")) / 2
    left = (middle > f("y0")) & (middle < f("y1")) & (p("x1") <= f("x0")) & (f("x0") - p("x1") <= 0.25)
    above = (p("y1") <= f("y0")) & (f("y0") - p("y1") <= 0.25) & (p("x0") < f("x1")) & (f("x0") < p("x1"))
    pairs = fields.alias("f").join(pieces.alias("p"), (f("page_id") == p("page_id")) & (f("band") == p("band")) & (left | above))
    rank = F.struct(F.when(left, 0).otherwise(1), F.when(left, f("x0") - p("x1")).otherwise(f("y0") - p("y1")), p("piece_no"))
    return pairs.groupBy(f("page_id"), f("field_no")).agg(F.min_by(p("str"), rank).alias("label"))
