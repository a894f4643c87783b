"""What redactions leave of drawn paths: curves as points, strokes without what rectangles cover, filled areas.

Positions on a stroke are structs (at, share): the segment's number and the share of it, ordered as such.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import bound, without_rect

# Fixed values, in points: how far a flattened curve may be off, how far a cut stays away from the rectangle; most steps of a curve.
FLAT, EDGE, MOST_STEPS = 0.1, 0.02, 200


def _norm(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def flattened(commands: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """commands (path_id, step_no, op, v) -> path_id, part_no, points, closed: the parts of each path as lines.

    op is M, L, Q, C or Z with the numbers of its points in v. A curve becomes as many
    equal steps of its parameter as keep it within FLAT. A path goes on at its start
    after Z. A null op or v and other ops are left out; a lone M is a part of one point.
    by: columns that a path has one value of; they pass, and commands dealt by them are not dealt again.
    """
    path = [*by, "path_id"]
    rows = commands.where(F.col("op").isin("M", "L", "Q", "C", "Z") & ((F.col("op") == "Z") | F.col("v").isNotNull()))
    order = Window.partitionBy(*path).orderBy("step_no")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    n = F.size("v")
    end = F.when(F.col("op") != "Z", F.array(F.get("v", n - 2), F.get("v", n - 1)))
    rows = rows.withColumn("end", end).withColumn("start", F.last(F.when(F.col("op") == "M", F.col("end")), True).over(so_far))
    opens = (F.col("op") == "M") | (F.lag("op").over(order) == "Z") | F.lag("op").over(order).isNull()
    rows = rows.withColumn("part_no", F.sum(F.when(opens, 1).otherwise(0)).over(so_far) - 1)
    origin = F.array(F.lit(0.0), F.lit(0.0))
    at = F.coalesce(F.lag("end").over(order), F.lag("start").over(order), origin)
    rows = rows.withColumn("at", at).withColumn("opens", F.coalesce(opens, F.lit(True)))
    # numbers of their own columns: a row a point is made by compiled code, elements of arrays inside lambdas are not
    numbers = [F.col("at")[k].alias(f"{c}0") for k, c in enumerate("xy")] + [F.get("v", F.lit(2 * j + k)).alias(f"{c}{j + 1}") for k, c in enumerate("xy") for j in range(3)]
    rows = rows.select(*path, "part_no", "step_no", "op", "opens", F.col("end")[0].alias("x"), F.col("end")[1].alias("y"), *numbers)
    bend = lambda j: _norm(*[F.col(f"{c}{j}") - 2 * F.col(f"{c}{j + 1}") + F.col(f"{c}{j + 2}") for c in "xy"])
    off = F.when(F.col("op") == "Q", bend(0) / 4).when(F.col("op") == "C", 0.75 * F.greatest(bend(0), bend(1))).otherwise(0.0)
    rows = rows.withColumn("steps", F.greatest(F.lit(1), F.least(F.lit(MOST_STEPS), F.ceil(F.sqrt(off / FLAT)))).cast("int"))
    # a part that no M opens begins where the path stands; Z draws nothing
    first = F.when(F.col("opens") & (F.col("op") != "M"), 0).otherwise(1)
    rows = rows.withColumn("i", F.explode_outer(F.when(F.col("op") != "Z", F.sequence(first, F.col("steps")))))

    def on_curve(c: str) -> Column:
        t = F.col("i") / F.col("steps")
        s = 1 - t
        p0, p1, p2, p3 = (F.col(f"{c}{j}") for j in range(4))
        quad = s * s * p0 + 2 * s * t * p1 + t * t * p2
        cube = s * s * s * p0 + 3 * s * s * t * p1 + 3 * s * t * t * p2 + t * t * t * p3
        return F.when(F.col("i") == 0, p0).when(F.col("op") == "Q", quad).when(F.col("op") == "C", cube).otherwise(F.col(c))

    point = F.struct("step_no", "i", F.array(on_curve("x"), on_curve("y")).alias("p"))
    rows = rows.select(*path, "part_no", F.when(F.col("i").isNotNull(), point).alias("point"), (F.col("op") == "Z").alias("closes"))
    parts = rows.groupBy(*path, "part_no").agg(F.array_sort(F.collect_list("point"))["p"].alias("points"), F.max("closes").alias("closed"))
    return parts.select(*path, "part_no", "points", "closed").where(F.size("points") > 0)


def hidden_ways(strokes: DataFrame, rects: DataFrame, edge: float = EDGE) -> DataFrame:
    """page_id, stroke_no, from, to: the stretches of each stroke inside rectangles grown by edge, overlapping ones as one."""
    line = F.when(F.col("closed"), F.concat("points", F.slice("points", 1, 1))).otherwise(F.col("points"))
    legs = F.size("line") - 1
    segment = F.arrays_zip(F.slice(F.col("line"), F.lit(1), legs).alias("p"), F.slice(F.col("line"), F.lit(2), legs).alias("q"))
    ways = strokes.where(F.size("points") > 1).select("page_id", "stroke_no", line.alias("line")).select("page_id", "stroke_no", F.posexplode(segment).alias("at", "s"))
    ways = ways.select("page_id", "stroke_no", "at", *[F.col(f"s.{e}")[k].alias(e + c) for e in "pq" for k, c in enumerate("xy")])
    # all that needs the segment alone is made before the join: the compiled step of a pair must stay short, or Java only interprets it
    reach = [f("p" + c, "q" + c).alias(f"{name}_{c}") for c in "xy" for name, f in (("low", F.least), ("high", F.greatest))]
    ways = ways.select("page_id", "stroke_no", "at", "px", "py", *[F.nullif(F.col("q" + c) - F.col("p" + c), F.lit(0.0)).alias("way_" + c) for c in "xy"], *reach)
    r = rects.select("page_id", (F.col("x0") - edge).alias("x0"), (F.col("y0") - edge).alias("y0"), (F.col("x1") + edge).alias("x1"), (F.col("y1") + edge).alias("y1"))
    near = (F.col("high_x") > F.col("x0")) & (F.col("low_x") < F.col("x1")) & (F.col("high_y") > F.col("y0")) & (F.col("low_y") < F.col("y1"))
    # the share of the segment at a side; null for one along the axis, which lies between both sides if it is near
    at_side = lambda c, side: (F.col(f"{c}{side}") - F.col("p" + c)) / F.col("way_" + c)
    met = ways.join(r, "page_id").where(near).select("page_id", "stroke_no", "at", *[at_side(c, side).alias(f"{c}_{side}") for c in "xy" for side in (0, 1)])
    enters, leaves = F.greatest(F.least("x_0", "x_1"), F.least("y_0", "y_1"), F.lit(0.0)), F.least(F.greatest("x_0", "x_1"), F.greatest("y_0", "y_1"), F.lit(1.0))
    met = met.select("page_id", "stroke_no", "at", enters.alias("a"), leaves.alias("b")).where("a < b")
    place = lambda share: F.when(F.col(share) < 1, F.struct(F.col("at"), F.col(share).alias("share"))).otherwise(F.struct((F.col("at") + 1).alias("at"), F.lit(0.0).alias("share")))
    met = met.select("page_id", "stroke_no", place("a").alias("from"), place("b").alias("to"))
    along = Window.partitionBy("page_id", "stroke_no").orderBy("from", "to")
    reach = F.max("to").over(along.rowsBetween(Window.unboundedPreceding, -1))
    met = met.withColumn("opens", F.when(reach >= F.col("from"), 0).otherwise(1))
    met = met.withColumn("island", F.sum("opens").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return met.groupBy("page_id", "stroke_no", "island").agg(F.min("from").alias("from"), F.max("to").alias("to")).drop("island")


def cut_strokes(strokes: DataFrame, rects: DataFrame, edge: float = EDGE) -> DataFrame:
    """strokes (page_id, stroke_no, points, closed), rects (page_id, x0..y1) -> page_id, stroke_no, piece_no, points, closed: what stays outside of all rectangles.

    A stroke that no rectangle meets stays as it is. Pieces of a closed stroke are open;
    that at its start and that at its end stay two. A covered stroke gives no row, and one
    of fewer than two points, or null ones, has no length to cut: it is left out.
    Rectangles without a number or without extent cut as far as their grown sides reach.
    Other columns of strokes pass.
    """
    others = [c for c in strokes.columns if c not in ("page_id", "stroke_no", "points", "closed")]
    gone = hidden_ways(strokes, rects, edge).groupBy("page_id", "stroke_no").agg(F.array_sort(F.collect_list(F.struct("from", "to"))).alias("gone"))
    rows = strokes.where(F.size("points") > 1).select("page_id", "stroke_no", "points", F.coalesce("closed", F.lit(False)).alias("closed"), *others).join(gone, ["page_id", "stroke_no"], "left")
    line = F.when(F.col("closed") & F.col("gone").isNotNull(), F.concat("points", F.slice("points", 1, 1))).otherwise(F.col("points"))
    rows = rows.select("page_id", "stroke_no", line.alias("line"), "closed", "gone", *others)
    spot = lambda at: F.struct(at.cast("int").alias("at"), F.lit(0.0).alias("share"))
    ends = F.concat(F.col("gone.from"), F.array(spot(F.size("line") - 1)))
    starts = F.concat(F.array(spot(F.lit(0))), F.col("gone.to"))
    gaps = F.filter(F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda g: g["a"] < g["b"])

    def point(place: Column) -> Column:
        p, q = F.get("line", place["at"]), F.get("line", place["at"] + 1)
        return F.when(place["share"] == 0, p).otherwise(F.transform(p, lambda x, k: x + (F.get(q, k) - x) * place["share"]))

    def piece(g: Column) -> Column:
        last = F.when(g["b"]["share"] == 0, g["b"]["at"] - 1).otherwise(g["b"]["at"])
        within = F.slice(F.col("line"), g["a"]["at"] + 2, F.greatest(last - g["a"]["at"], F.lit(0)))
        return F.concat(F.array(point(g["a"])), within, F.array(point(g["b"])))

    pieces = F.when(F.col("gone").isNull(), F.array("line")).otherwise(bound(gaps, lambda g: F.transform(g, piece)))
    return rows.select("page_id", "stroke_no", F.posexplode(pieces).alias("piece_no", "points"), (F.col("closed") & F.col("gone").isNull()).alias("closed"), *others)


def area_outside(points: Column, rects: Column, edge: float = EDGE) -> Column:
    """The parts of a filled polygon outside of all rectangles (array of structs x0..y1) grown by edge."""
    start = F.array(points)
    return F.aggregate(rects, start, lambda parts, r: F.flatten(F.transform(parts, lambda p: without_rect(p, r["x0"] - edge, r["y0"] - edge, r["x1"] + edge, r["y1"] + edge))))


def length(points: Column) -> Column:
    """Length of a line through points."""
    legs = F.transform(F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0))), lambda p, i: _norm(p[0] - F.get(points, i)[0], p[1] - F.get(points, i)[1]))
    return F.aggregate(legs, F.lit(0.0), lambda a, x: a + x)
