"""Inheritance along parents, field locks, nearest targets, findings with their place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import personal
from ..lineage import cut, dealt_join

def inherit(rows: DataFrame, key: str, parent: str, values: list[str]) -> DataFrame:
    """key and values, each null filled from the nearest ancestor that has one.

    Pointer doubling: round k knows what 2**k ancestors give, so a chain of n rows
    takes log2(n) equi-joins, each written out; rows that share an ancestor, as late
    rounds do, are dealt over several tasks. Longer than all rows no chain is:
    what is still going on then is a cycle, and ends.
    """
    now = rows.select(key, F.col(parent).alias("_up"), *values)
    for _ in range(max(1, rows.count()).bit_length() + 1):
        now = cut(now)
        if now.where("_up IS NOT NULL").isEmpty():
            break
        above = now.select(F.col(key).alias("_up"), F.col("_up").alias("_next"), *[F.col(v).alias(f"_{v}") for v in values])
        now = dealt_join(now, above, ["_up"], [key]).select(key, F.col("_next").alias("_up"), *[F.coalesce(v, f"_{v}").alias(v) for v in values])
    return now.drop("_up")


def locked_fields(fields: DataFrame, rules: DataFrame) -> DataFrame:
    """fields (doc_id, name), rules (doc_id, action All / Include / Exclude, names) -> the locked fields.

    A rule's name stands for the field of that name and all below it.
    """
    named = F.exists("r.names", lambda n: (F.col("f.name") == n) | F.col("f.name").startswith(F.concat(n, F.lit("."))))
    hit = F.when(F.col("r.action") == "All", True).when(F.col("r.action") == "Include", named).when(F.col("r.action") == "Exclude", ~named)
    return fields.alias("f").join(rules.alias("r"), (F.col("f.doc_id") == F.col("r.doc_id")) & hit, "left_semi")


#: Heights of the bands that pages are cut into, so that a range join meets neighbours only.
BAND = 0.05


def bands(low, high):
    """The bands from low to high."""
    return F.sequence(F.floor(low / BAND), F.floor(high / BAND))


def target_at(points: DataFrame, boxes: DataFrame, slack: float = 0.35) -> DataFrame:
    """points (page_id, point_no, x, y), boxes (page_id, box_no, x0..y1) -> the nearest box within slack heights."""
    away = lambda at, low, high: F.greatest(F.col(low) - F.col(at), F.col(at) - F.col(high), F.lit(0.0))
    dx, dy = away("p.x", "b.x0", "b.x1"), away("p.y", "b.y0", "b.y1")
    reach = slack * (F.col("y1") - F.col("y0"))
    banded = boxes.withColumn("band", F.explode(bands(F.col("y0") - reach, F.col("y1") + reach)))
    here = points.withColumn("band", F.floor(F.col("y") / BAND))
    near = here.alias("p").join(banded.alias("b"), (F.col("p.page_id") == F.col("b.page_id")) & (F.col("p.band") == F.col("b.band")) & (F.greatest(dx, dy) <= slack * (F.col("b.y1") - F.col("b.y0"))))
    rank = F.struct((dx * dx + dy * dy).alias("d"), F.col("b.box_no").alias("n"))
    return near.groupBy("p.page_id", "p.point_no").agg(F.min_by("b.box_no", rank).alias("box_no"))


#: Letters that a number may go on with in the next piece.
_GOES_ON = ((r"\d$", r"^[./-]\d"), (r"\d[./-]$", r"^\d"))


def piece_lines(pieces: DataFrame) -> DataFrame:
    """pieces (page_id, str, xs, y0, y1, line, width, height) -> page_id, line_no, text, and for each letter its place (-1: an inserted blank).

    Pieces with a line number of their own make those lines. The others are islands:
    in order of their middles a piece opens a line where everything before it on the
    page has ended above its middle.
    """
    middle = (F.col("y0") + F.col("y1")) / 2
    full = pieces.where("str <> ''").withColumn("middle", middle).withColumn("x", F.get("xs", F.lit(0))).withColumn("stop", F.element_at("xs", -1))
    group = Window.partitionBy("page_id", "line")
    down = group.orderBy("middle", "x", "str")
    reach = F.max("y1").over(down.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.col("line").isNull() & (F.coalesce(reach, F.lit(float("-inf"))) <= F.col("middle")), 1).otherwise(0)
    island = full.withColumn("opens", opens).withColumn("island", F.sum("opens").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    line = Window.partitionBy("page_id", "line", "island")
    across = line.orderBy("x", "middle", "str")
    before = lambda c: F.lag(c).over(across)
    tall = F.max("y1").over(line) - F.min("y0").over(line)
    set_ = island.select("*", tall.alias("tall"), before("str").alias("prior"), before("stop").alias("prior_stop"), (before("y1") - before("y0")).alias("prior_tall"), F.min(F.struct("middle", "x", "str")).over(line).alias("first"))
    gap = (F.col("x") - F.col("prior_stop")) * F.col("width")
    height = F.col("height") * F.when(F.col("line").isNull(), F.col("tall")).otherwise(F.greatest(F.col("y1") - F.col("y0"), "prior_tall"))
    goes_on = F.lit(False)
    for left, right in _GOES_ON:
        goes_on = goes_on | (F.col("prior").rlike(left) & F.col("str").rlike(right))
    blank = (gap > 0.2 * height) & ~(goes_on & (gap < 1.5 * height)) & ~F.col("prior").rlike(r"\s$") & ~F.col("str").rlike(r"^\s")
    parted = F.coalesce(blank, F.lit(False))
    done = set_.select("page_id", "line", "island", "first", "x", "middle", "str", F.when(parted, F.concat(F.lit(" "), "str")).otherwise(F.col("str")).alias("part"), parted.alias("parted"), "xs", "y0", "y1")
    # places in a list of their own, so that they and the ends of letters go where nobody reads them
    told = F.array_sort(F.collect_list(F.struct("x", "middle", "part"))).alias("p")
    boxes = F.array_sort(F.collect_list(F.struct("x", "middle", "part", "xs", "y0", "y1", "str", "parted"))).alias("q")
    lines = done.groupBy("page_id", "line", "island").agg(F.min("first").alias("first"), told, boxes)
    number = F.row_number().over(Window.partitionBy("page_id").orderBy("first")) - 1
    none = F.array(F.array(F.lit(-1.0), F.lit(-1.0), F.lit(0.0), F.lit(0.0)))

    def places(piece: Column) -> Column:
        own = F.transform(F.sequence(F.lit(0), F.length(piece["str"]) - 1), lambda i: F.array(F.get(piece["xs"], i), F.get(piece["xs"], i + 1), piece["y0"], piece["y1"]))
        return F.when(piece["parted"], F.concat(none, own)).otherwise(own)

    return lines.select("page_id", number.alias("line_no"), F.array_join("p.part", "").alias("text"), F.flatten(F.transform("q", places)).alias("places"))


def find_in_pieces(pieces: DataFrame) -> DataFrame:
    """pieces as in piece_lines -> page_id, line_no, type, value, start and the box of each finding."""
    found = piece_lines(pieces).select("page_id", "line_no", "places", F.explode(personal.find_sensitive(F.col("text"))).alias("f"))
    real = F.filter(F.slice("places", F.col("f.start") + 1, F.col("f.stop") - F.col("f.start")), lambda p: p[0] >= 0)
    side = lambda pick, i: pick(F.transform(real, lambda p: p[i]))
    return found.select("page_id", "line_no", "f.start", "f.type", "f.value", side(F.array_min, 0).alias("x0"), side(F.array_min, 2).alias("y0"), side(F.array_max, 1).alias("x1"), side(F.array_max, 3).alias("y1"))
