"""Text layout: line breaks, rows of tables with spanning cells."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType


def items_of(words: DataFrame, line: float) -> DataFrame:
    """words (para_no, word_no, text, letter, blank) -> para_no, word_no, part, text, width, blank: what a line can break between.

    letter: width of each letter; blank: width of the gap before the word. A word that no
    line can hold falls into its letters; they follow each other without a gap.
    """
    wide = F.length("text") * F.col("letter") > line
    parts = F.when(wide, F.split("text", "")).otherwise(F.array("text"))
    rows = words.select(F.col("para_no").cast("bigint").alias("para_no"), "word_no", "letter", "blank", F.posexplode(parts).alias("part", "text")).where("text <> ''")
    return rows.select("para_no", "word_no", "part", "text", (F.length("text") * F.col("letter")).alias("width"), F.when(F.col("part") == 0, F.col("blank")).otherwise(0).alias("blank"))


def _filled(batches: Iterator[pa.RecordBatch], line: float, first: float, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Items sorted by paragraph and place -> lines; only the line that is open is held."""
    none = object()
    para, number, parts, width, gaps, stop, room = none, 0, [], 0, 0, 0, 0

    def told(last: bool) -> tuple:
        free = (first if number == 0 else line) - width
        return para, number, "".join(parts), width, 0.0 if last or not gaps or free <= 0 else free / gaps

    for batch in batches:
        done = []
        for key, text, wide, blank in zip(*(batch.column(c).to_pylist() for c in ("para_no", "text", "width", "blank")), strict=True):
            fresh = key != para
            if fresh:
                if parts:
                    done.append(told(True))
                para, number, stop = key, 0, 0
            stop += wide + blank
            if fresh or stop > room:
                if not fresh:
                    done.append(told(False))
                    number += 1
                parts, width, gaps, room = [text], wide, 0, stop - wide + (first if fresh else line)
            else:
                parts.append(" " + text if blank > 0 else text)
                width, gaps = width + wide + blank, gaps + (blank > 0)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
    if parts:
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(told(True), schema, strict=True)], schema=schema)


def broken_lines(words: DataFrame, line: float, first: float | None = None) -> DataFrame:
    """words as in items_of -> para_no, line_no, text, width, spacing: lines no wider than line (the first one: first).

    A blank at a line's end does not count. spacing is what each blank of a justified
    line is wider by; the last line of a paragraph has none. Items are shuffled once and
    stream through a task in their order.
    """
    first = line if first is None else first
    items = items_of(words, min(line, first))
    whole = all(isinstance(items.schema[c].dataType, IntegralType) for c in ("width", "blank"))
    kind = "bigint" if whole else "double"
    items = items.select("para_no", "word_no", "part", "text", *[F.col(c).cast(kind).alias(c) for c in ("width", "blank")])
    schema = pa.schema([("para_no", pa.int64()), ("line_no", pa.int64()), ("text", pa.string()), ("width", pa.int64() if whole else pa.float64()), ("spacing", pa.float64())])
    dealt = items.repartition("para_no").sortWithinPartitions("para_no", "word_no", "part").drop("word_no", "part")
    return dealt.mapInArrow(lambda parts: _filled(parts, line, first, schema), f"para_no bigint, line_no bigint, text string, width {kind}, spacing double")


def spanned_rows(cells: DataFrame, least: float = 4.0) -> DataFrame:
    """cells (table_no, row_no from 0 without gaps, cell_no, height, span) -> table_no, row_no, height.

    Cells over one row, and `least`, give rows their own heights. Then cells over several
    rows, by the row they begin in, add what they lack to the last of their rows. A table
    is one row while its spanning cells are folded over the heights of its rows.
    """
    own = cells.groupBy("table_no", "row_no").agg(F.greatest(F.max(F.when(F.col("span") == 1, F.col("height").cast("double"))), F.lit(float(least))).alias("own"))
    heights = own.groupBy("table_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "own"))), lambda r: r["own"]).alias("heights"))
    spanning = F.struct("row_no", "cell_no", (F.col("row_no") + F.col("span") - 1).alias("last"), F.col("height").cast("double").alias("height"))
    spans = cells.where("span > 1").groupBy("table_no").agg(F.array_sort(F.collect_list(spanning)).alias("spans"))

    def grown(now: Column, cell: Column) -> Column:
        held = F.aggregate(F.slice(now, cell["row_no"].cast("int") + 1, (cell["last"] - cell["row_no"] + 1).cast("int")), F.lit(0.0), lambda a, h: a + h)
        return F.transform(now, lambda h, i: F.when(i == cell["last"], h + F.greatest(F.lit(0.0), cell["height"] - held)).otherwise(h))

    done = heights.join(spans, "table_no", "left").select("table_no", F.when(F.col("spans").isNull(), F.col("heights")).otherwise(F.aggregate("spans", F.col("heights"), grown)).alias("heights"))
    return done.select("table_no", F.posexplode("heights").alias("row_no", "height"))
