"""Drawn paths under redactions: polylines and curves cut by all rectangles of their page."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geometry import polygon_area
from ..lineage import dealt
from ..operators import cuts
from .base import load, query

#: Bytes of vectors that a task draws.
VECTORS_TOGETHER = 1 << 20


def _drawings(spark, sf_dir):
    """Embeddings as strokes of two components a point, ten a page, each also a rectangle from its first point a quarter of the way to its second."""
    e = F.col("embedding")
    points = F.transform(F.sequence(F.lit(0), F.floor(F.size(e) / 2).cast("int") - 1), lambda i: F.array(F.get(e, 2 * i).cast("double") * 100, F.get(e, 2 * i + 1).cast("double") * 100))
    vectors = dealt(load(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 10).alias("page_id"), "vec_id", "label", "embedding"), VECTORS_TOGETHER, "page_id", joined=True)
    rows = vectors.select("page_id", F.col("vec_id").alias("stroke_no"), points.alias("points"), (F.col("label") % 3 == 0).alias("closed"))
    first = lambda k: F.col("points")[0][k]
    side = lambda pick, k: pick(first(k), first(k) + (F.col("points")[1][k] - first(k)) / 4)
    rects = rows.select("page_id", side(F.least, 0).alias("x0"), side(F.least, 1).alias("y0"), side(F.greatest, 0).alias("x1"), side(F.greatest, 1).alias("y1"))
    return rows, rects


_POINTS = "pt AS (SELECT vec_id // 10 AS page_id, vec_id AS stroke_no, label % 3 = 0 AS closed, i, embedding[2 * i + 1]::DOUBLE * 100 AS x, embedding[2 * i + 2]::DOUBLE * 100 AS y FROM embeddings, range(512) r(i) WHERE i < len(embedding) // 2)"
_RECTS = """q AS (SELECT page_id, stroke_no, i, x AS xa, y AS ya, x + (lead(x) OVER o - x) / 4 AS xb, y + (lead(y) OVER o - y) / 4 AS yb FROM pt WINDOW o AS (PARTITION BY stroke_no ORDER BY i)),
rc AS (SELECT page_id, least(xa, xb) - 0.02::DOUBLE AS x0, least(ya, yb) - 0.02::DOUBLE AS y0, greatest(xa, xb) + 0.02::DOUBLE AS x1, greatest(ya, yb) + 0.02::DOUBLE AS y1 FROM q WHERE i = 0)"""
# a sweep over the ends of what each rectangle covers: visible where none does
_VISIBLE = lambda segments: f"""{segments},
hit AS (SELECT s.*, greatest(0, CASE WHEN x2 <> x THEN least((x0 - x) / (x2 - x), (x1 - x) / (x2 - x)) ELSE 0 END, CASE WHEN y2 <> y THEN least((y0 - y) / (y2 - y), (y1 - y) / (y2 - y)) ELSE 0 END) AS a,
 least(1, CASE WHEN x2 <> x THEN greatest((x0 - x) / (x2 - x), (x1 - x) / (x2 - x)) WHEN x > x0 AND x < x1 THEN 1 ELSE -1 END, CASE WHEN y2 <> y THEN greatest((y0 - y) / (y2 - y), (y1 - y) / (y2 - y)) WHEN y > y0 AND y < y1 THEN 1 ELSE -1 END) AS b FROM seg s JOIN rc USING (page_id)),
ev AS (SELECT page_id, stroke_no, i, a AS t, 1 AS d FROM hit WHERE a < b UNION ALL SELECT page_id, stroke_no, i, b, -1 FROM hit WHERE a < b
 UNION ALL SELECT page_id, stroke_no, i, 0, 0 FROM seg UNION ALL SELECT page_id, stroke_no, i, 1, 0 FROM seg),
sw AS (SELECT *, sum(d) OVER w AS depth, lead(t) OVER w AS t2 FROM ev WINDOW w AS (PARTITION BY page_id, stroke_no, i ORDER BY t, d DESC ROWS UNBOUNDED PRECEDING)),
vis AS (SELECT page_id, stroke_no, i, t, t2, sqrt((x2 - x) ** 2 + (y2 - y) ** 2) * (t2 - t) AS len FROM sw JOIN seg USING (page_id, stroke_no, i) WHERE depth = 0 AND t2 > t)"""  # noqa: E731


@query(
    f"""WITH {_POINTS}, {_RECTS}, {_VISIBLE("seg AS (SELECT page_id, stroke_no, closed, i, x, y, coalesce(lead(x) OVER o, first_value(x) OVER o) AS x2, coalesce(lead(y) OVER o, first_value(y) OVER o) AS y2 FROM pt WINDOW o AS (PARTITION BY stroke_no ORDER BY i) QUALIFY closed OR lead(x) OVER o IS NOT NULL)")},
g AS (SELECT *, CASE WHEN t = 0 AND lag(t2) OVER o = 1 AND lag(i) OVER o = i - 1 THEN 0 ELSE 1 END AS opens FROM vis WINDOW o AS (PARTITION BY page_id, stroke_no ORDER BY i, t)),
n AS (SELECT *, sum(opens) OVER (PARTITION BY page_id, stroke_no ORDER BY i, t) - 1 AS piece_no FROM g)
SELECT page_id, stroke_no, piece_no::INTEGER AS piece_no, (count(*) + 1)::INTEGER AS n_points, round(sum(len), 6) AS length FROM n GROUP BY ALL"""
)
def stroke_cuts(spark, sf_dir):
    strokes, rects = _drawings(spark, sf_dir)
    pieces = cuts.cut_strokes(strokes, rects)
    line = F.when(F.col("closed"), F.concat("points", F.slice("points", 1, 1))).otherwise(F.col("points"))
    return pieces.select("page_id", "stroke_no", "piece_no", F.size(line).alias("n_points"), F.round(cuts.length(line), 6).alias("length"))


_STEPS = "greatest(1, least(200, ceil(sqrt({} / 0.1::DOUBLE))))::INTEGER"
_BEND = lambda a, b, c: f"sqrt((x{a} - 2 * x{b} + x{c}) ** 2 + (y{a} - 2 * y{b} + y{c}) ** 2)"
_MIX3 = lambda v: f"(1 - t) ** 3 * {v}0 + 3 * (1 - t) ** 2 * t * {v}1 + 3 * (1 - t) * t * t * {v}2 + t ** 3 * {v}3"
_MIX2 = lambda v: f"(1 - t) ** 2 * {v}0 + 2 * (1 - t) * t * {v}1 + t * t * {v}2"


@query(
    f"""WITH {_POINTS}, {_RECTS},
k AS (SELECT page_id, stroke_no, i // 5 AS c, i % 5 AS j, i, x AS x0, y AS y0, lead(x, 1) OVER o AS x1, lead(y, 1) OVER o AS y1, lead(x, 2) OVER o AS x2, lead(y, 2) OVER o AS y2, lead(x, 3) OVER o AS x3, lead(y, 3) OVER o AS y3 FROM pt WINDOW o AS (PARTITION BY stroke_no ORDER BY i)),
cu AS (SELECT *, {_STEPS.format(f"(0.75::DOUBLE * greatest({_BEND(0, 1, 2)}, {_BEND(1, 2, 3)}))")} AS n FROM k WHERE j = 0 AND x3 IS NOT NULL),
qu AS (SELECT *, {_STEPS.format(f"({_BEND(0, 1, 2)} / 4)")} AS n FROM k WHERE j = 3 AND x2 IS NOT NULL),
fl AS (SELECT page_id, stroke_no, i * 1000 AS i, x0 AS x, y0 AS y FROM k WHERE i = 0
 UNION ALL SELECT page_id, stroke_no, i * 1000 + s, {_MIX3("x")}, {_MIX3("y")} FROM (SELECT *, s / n::DOUBLE AS t FROM (SELECT *, unnest(range(1, n + 1)) AS s FROM cu))
 UNION ALL SELECT page_id, stroke_no, i * 1000 + s, {_MIX2("x")}, {_MIX2("y")} FROM (SELECT *, s / n::DOUBLE AS t FROM (SELECT *, unnest(range(1, n + 1)) AS s FROM qu))),
{_VISIBLE("seg AS (SELECT page_id, stroke_no, i, x, y, lead(x) OVER o AS x2, lead(y) OVER o AS y2 FROM fl WINDOW o AS (PARTITION BY stroke_no ORDER BY i) QUALIFY lead(x) OVER o IS NOT NULL)")}
SELECT stroke_no, (SELECT count(*) FROM fl WHERE fl.stroke_no = v.stroke_no)::INTEGER AS n_points, round(sum(len), 6) AS visible FROM vis v GROUP BY stroke_no"""
)
def curve_cuts(spark, sf_dir):
    """Strokes as paths: a start, then cubic curves and quadratic ones in turn, as far as points reach."""
    strokes, rects = _drawings(spark, sf_dir)
    at = lambda i: F.get("points", i)
    steps = F.sequence(F.lit(0), F.size("points") - 1)
    command = lambda i: (
        F.when(i == 0, F.struct(F.lit(0).alias("step_no"), F.lit("M").alias("op"), at(i).alias("v")))
        .when((i % 5 == 3), F.struct(i.alias("step_no"), F.lit("C").alias("op"), F.concat(at(i - 2), at(i - 1), at(i)).alias("v")))
        .when((i % 5 == 0), F.struct(i.alias("step_no"), F.lit("Q").alias("op"), F.concat(at(i - 1), at(i)).alias("v")))
    )
    commands = strokes.select("page_id", F.col("stroke_no").alias("path_id"), F.explode(F.filter(F.transform(steps, command), lambda c: c.isNotNull())).alias("c")).select("page_id", "path_id", "c.*")
    drawn = cuts.flattened(commands, ("page_id",)).select("page_id", F.col("path_id").alias("stroke_no"), "points", "closed", F.size("points").alias("n_points"))
    return cuts.cut_strokes(drawn, rects).groupBy("stroke_no", "n_points").agg(F.round(F.sum(cuts.length(F.col("points"))), 6).alias("visible"))


@query(
    f"""WITH {_POINTS}, {_RECTS},
b AS (SELECT page_id, greatest(x0, -10::DOUBLE) AS x0, greatest(y0, -10::DOUBLE) AS y0, least(x1, 10::DOUBLE) AS x1, least(y1, 10::DOUBLE) AS y1 FROM rc WHERE x0 < 10 AND x1 > -10 AND y0 < 10 AND y1 > -10),
v AS (SELECT DISTINCT page_id, x FROM (SELECT page_id, unnest([x0, x1]) AS x FROM b UNION SELECT page_id, unnest([-10::DOUBLE, 10::DOUBLE]) FROM pt)),
strip AS (SELECT page_id, x AS a, lead(x) OVER (PARTITION BY page_id ORDER BY x) AS z FROM v QUALIFY z IS NOT NULL),
inn AS (SELECT s.page_id, s.a, s.z, b.y0, b.y1, max(b.y1) OVER (PARTITION BY s.page_id, s.a ORDER BY b.y0, b.y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM strip s JOIN b ON b.page_id = s.page_id AND b.x0 <= s.a AND b.x1 >= s.z)
SELECT p.page_id, round(400::DOUBLE - coalesce(sum((z - a) * greatest(0, y1 - greatest(y0, coalesce(top, y0)))), 0), 6) AS area FROM (SELECT DISTINCT page_id FROM pt) p LEFT JOIN inn USING (page_id) GROUP BY p.page_id"""
)
def area_cuts(spark, sf_dir):
    """A filled square on each page without all of its rectangles."""
    _, rects = _drawings(spark, sf_dir)
    pages = rects.groupBy("page_id").agg(F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("r"))
    square = F.array(*[F.array(F.lit(x), F.lit(y)) for x, y in ((-10.0, -10.0), (10.0, -10.0), (10.0, 10.0), (-10.0, 10.0))])
    area = F.aggregate(F.transform(cuts.area_outside(square, F.col("r")), polygon_area), F.lit(0.0), lambda a, x: a + x)
    return pages.select("page_id", F.round(area, 6).alias("area"))
