"""Queries over boxes, quadrilaterals, lists and strokes derived from orders, events and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import strokes
from .base import load, query

K = "o_orderkey"


def _boxes(spark, sf_dir):
    """A box of each order with a turn, a shift and a page size."""
    k = F.col(K)
    x0, y0 = (k % 83) / F.lit(100.0), (k % 71) / F.lit(100.0)
    b = g.box(x0, y0, x0 + (k % 13 + 1) / F.lit(100.0), y0 + (k % 17 + 1) / F.lit(100.0))
    return load(spark, sf_dir, "orders").select(K, b.alias("b"), (k % 4 * 90).cast("int").alias("turn"), ((k % 41 - 20) / F.lit(50.0)).alias("dx"), ((k % 37 - 18) / F.lit(50.0)).alias("dy"), (400.0 + k % 300).alias("w"), (500.0 + k % 200).alias("h"))


_BOX = """b AS (SELECT o_orderkey, x0, y0, x0 + (o_orderkey % 13 + 1) / 100.0::DOUBLE AS x1, y0 + (o_orderkey % 17 + 1) / 100.0::DOUBLE AS y1, (o_orderkey % 4 * 90)::INTEGER AS turn,
 (o_orderkey % 41 - 20) / 50.0::DOUBLE AS dx, (o_orderkey % 37 - 18) / 50.0::DOUBLE AS dy, 400.0::DOUBLE + o_orderkey % 300 AS w, 500.0::DOUBLE + o_orderkey % 200 AS h
 FROM (SELECT o_orderkey, (o_orderkey % 83) / 100.0::DOUBLE AS x0, (o_orderkey % 71) / 100.0::DOUBLE AS y0 FROM orders))"""
_R = lambda x: f"floor(({x}) * 1000000 + 0.5) / 1000000"


@query(f"WITH {_BOX} SELECT o_orderkey, least(greatest(least(x1 + dx, x0), 0), 1) AS x0, least(greatest(least(y1 + dy, y0), 0), 1) AS y0, least(greatest(greatest(x1 + dx, x0), 0), 1) AS x1, least(greatest(greatest(y1 + dy, y0), 0), 1) AS y1 FROM b")
def edit_box_normalize(spark, sf_dir):
    b = F.col("b")
    return _boxes(spark, sf_dir).select(K, g.sorted_box(g.box(b["x1"] + F.col("dx"), b["y1"] + F.col("dy"), b["x0"], b["y0"])).alias("n")).select(K, "n.*")


@query(
    f"""WITH {_BOX}, t AS (SELECT o_orderkey, (turn + 90) % 360 AS turn, CASE turn WHEN 0 THEN [x0, y0, x1, y1] WHEN 90 THEN [1 - y1, x0, 1 - y0, x1] WHEN 180 THEN [1 - x1, 1 - y1, 1 - x0, 1 - y0] ELSE [y0, 1 - x1, y1, 1 - x0] END AS t FROM b)
SELECT o_orderkey, turn, {_R('t[1]')} AS x0, {_R('t[2]')} AS y0, {_R('t[3]')} AS x1, {_R('t[4]')} AS y1 FROM t"""
)
def edit_rotate(spark, sf_dir):
    return _boxes(spark, sf_dir).select(K, F.pmod(F.col("turn") + 90, F.lit(360)).alias("turn"), g.turned_box(F.col("b"), F.col("turn")).alias("r")).select(K, "turn", "r.*")


_MOVE = lambda dx, dy: f"""m AS (SELECT *, least(greatest({dx}, -x0), 1 - x1) AS mx, least(greatest({dy}, -y0), 1 - y1) AS my FROM b)
SELECT o_orderkey, {_R('x0 + mx')} AS x0, {_R('y0 + my')} AS y0, {_R('x1 + mx')} AS x1, {_R('y1 + my')} AS y1 FROM m"""  # noqa: E731


@query(f"WITH {_BOX}, {_MOVE('dx', 'dy')}")
def edit_move(spark, sf_dir):
    return _boxes(spark, sf_dir).select(K, g.moved_box(F.col("b"), F.col("dx"), F.col("dy")).alias("m")).select(K, "m.*")


@query(f"WITH {_BOX}, {_MOVE('CASE WHEN x1 + 0.03::DOUBLE <= 1 THEN 0.03::DOUBLE ELSE -0.03::DOUBLE END', 'CASE WHEN y1 + 0.03::DOUBLE <= 1 THEN 0.03::DOUBLE ELSE -0.03::DOUBLE END')}")
def edit_duplicate(spark, sf_dir):
    return _boxes(spark, sf_dir).select(K, g.copied_box(F.col("b")).alias("m")).select(K, "m.*")


def _resize_sql(source: str) -> str:
    """Twin of resizing: source gives corner, px, py, aspect, keep beside the box."""
    return f"""s AS ({source}),
f AS (SELECT *, corner IN (0, 3) AS l, corner IN (0, 1) AS t, CASE WHEN corner IN (0, 3) THEN x1 ELSE x0 END AS fx, CASE WHEN corner IN (0, 1) THEN y1 ELSE y0 END AS fy FROM s),
a AS (SELECT *, greatest(0.004::DOUBLE, CASE WHEN l THEN fx - least(greatest(px, 0), 1) ELSE least(greatest(px, 0), 1) - fx END) AS w0, greatest(0.004::DOUBLE, CASE WHEN t THEN fy - least(greatest(py, 0), 1) ELSE least(greatest(py, 0), 1) - fy END) AS h0,
 CASE WHEN l THEN fx ELSE 1 - fx END AS rx, CASE WHEN t THEN fy ELSE 1 - fy END AS ry, (x1 - x0) / (y1 - y0) * aspect AS ratio FROM f),
k AS (SELECT *, CASE WHEN w0 * aspect / ratio > h0 THEN w0 ELSE h0 * ratio / aspect END AS kw, CASE WHEN w0 * aspect / ratio > h0 THEN w0 * aspect / ratio ELSE h0 END AS kh FROM a),
z AS (SELECT *, least(1.0::DOUBLE, rx / kw, ry / kh) AS shrink FROM k),
e AS (SELECT *, least(CASE WHEN keep THEN kw * shrink ELSE w0 END, rx) AS ww, least(CASE WHEN keep THEN kh * shrink ELSE h0 END, ry) AS hh FROM z)
SELECT o_orderkey, {_R('CASE WHEN l THEN fx - ww ELSE fx END')} AS x0, {_R('CASE WHEN t THEN fy - hh ELSE fy END')} AS y0, {_R('CASE WHEN l THEN fx ELSE fx + ww END')} AS x1, {_R('CASE WHEN t THEN fy ELSE fy + hh END')} AS y1 FROM e"""


@query(f"WITH {_BOX}, {_resize_sql('SELECT *, o_orderkey // 4 % 4 AS corner, 0.5::DOUBLE + dx AS px, 0.5::DOUBLE + dy AS py, w / h AS aspect, o_orderkey % 3 = 0 AS keep FROM b')}")
def edit_resize(spark, sf_dir):
    corner, keep = F.floor(F.col(K) / 4) % 4, F.col(K) % 3 == 0
    return _boxes(spark, sf_dir).select(K, g.resized_box(F.col("b"), corner, 0.5 + F.col("dx"), 0.5 + F.col("dy"), F.col("w") / F.col("h"), keep).alias("r")).select(K, "r.*")


_GROW = """SELECT *, 2 AS corner, w / h AS aspect, CASE WHEN keep THEN x0 + (x1 - x0) * f ELSE x1 + dx END AS px, CASE WHEN keep THEN y0 + (y1 - y0) * f ELSE y1 + dy END AS py
FROM (SELECT *, o_orderkey % 2 = 0 AS keep, CASE WHEN dx <> 0 THEN ((x1 - x0) + dx) / (x1 - x0) ELSE ((y1 - y0) + dy) / (y1 - y0) END AS f FROM b)"""


@query(f"WITH {_BOX}, {_resize_sql(_GROW)}")
def edit_grow(spark, sf_dir):
    return _boxes(spark, sf_dir).select(K, g.grown_box(F.col("b"), F.col("dx"), F.col("dy"), F.col("w") / F.col("h"), F.col(K) % 2 == 0).alias("r")).select(K, "r.*")


@query(
    f"""WITH {_BOX}, s AS (SELECT *, least(1.0::DOUBLE, (50 + o_orderkey % 700) / w) AS bw, least(1.0::DOUBLE, (20 + o_orderkey % 90) / h) AS bh FROM b),
p AS (SELECT *, least(greatest(x0 - bw / 2, 0), 1 - bw) AS a, least(greatest(y0 - bh / 2, 0), 1 - bh) AS c FROM s)
SELECT o_orderkey, {_R('a')} AS x0, {_R('c')} AS y0, {_R('a + bw')} AS x1, {_R('c + bh')} AS y1 FROM p"""
)
def box_around(spark, sf_dir):
    k, b = F.col(K), F.col("b")
    return _boxes(spark, sf_dir).select(K, g.box_around(b["x0"], b["y0"], 50 + k % 700, 20 + k % 90, F.col("w"), F.col("h")).alias("r")).select(K, "r.*")


@query(
    f"""WITH {_BOX}, f AS (SELECT *, (x1 - x0) * w AS bw, (y1 - y0) * h AS bh, x0 * w AS u, y0 * h AS v FROM b),
m AS (SELECT *, CASE turn WHEN 0 THEN [1, 0, 0, 1, u, v] WHEN 90 THEN [0, 1, -1, 0, u + bw, v] WHEN 180 THEN [-1, 0, 0, -1, u + bw, v + bh] ELSE [0, -1, 1, 0, u, v + bh] END AS n,
 CASE o_orderkey // 4 % 4 WHEN 0 THEN [1, 0, 0, -1, 10, h] WHEN 1 THEN [0, 1, 1, 0, 10, 20] WHEN 2 THEN [-1, 0, 0, 1, w, 20] ELSE [0, -1, -1, 0, w, h] END AS p FROM f)
SELECT o_orderkey, p[1] * n[1] + p[3] * n[2] AS a, p[2] * n[1] + p[4] * n[2] AS b, p[1] * n[3] + p[3] * n[4] AS c, p[2] * n[3] + p[4] * n[4] AS d, p[1] * n[5] + p[3] * n[6] + p[5] AS e, p[2] * n[5] + p[4] * n[6] + p[6] AS f FROM m"""
)
def edit_frame(spark, sf_dir):
    turn = (F.floor(F.col(K) / 4) % 4 * 90).cast("int")
    page = g.page_matrix(F.lit(10.0), F.lit(20.0), F.col("w"), F.col("h"), turn)
    rows = _boxes(spark, sf_dir).select(K, page.alias("p"), g.frame_matrix(F.col("b"), F.col("w"), F.col("h"), F.col("turn")).alias("n"))
    m = g.product(F.col("p"), F.col("n"))
    return rows.select(K, m.alias("m")).select(K, *[F.col("m")[i].alias(c) for i, c in enumerate("abcdef")])


@query(f"WITH {_BOX}, p AS (SELECT o_orderkey, CASE turn WHEN 90 THEN [10 + y0 * h, 20 + x0 * w] WHEN 180 THEN [w - x0 * w, 20 + y0 * h] WHEN 270 THEN [w - y0 * h, h - x0 * w] ELSE [10 + x0 * w, h - y0 * h] END AS p FROM b) SELECT o_orderkey, p[1] AS x, p[2] AS y FROM p")
def visible_to_page(spark, sf_dir):
    at = g.to_page(F.lit(10.0), F.lit(20.0), F.col("w"), F.col("h"), F.col("turn"), F.col("b")["x0"] * F.col("w"), F.col("b")["y0"] * F.col("h"))
    return _boxes(spark, sf_dir).select(K, at.alias("p")).select(K, F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


@query(
    f"""WITH {_BOX}, a AS (SELECT *, dx / 2 AS q FROM b), c AS (SELECT *, unnest([[x0, y0], [x1, y0], [x1, y1], [x0, y1]]) AS p FROM a),
d AS (SELECT *, least(greatest((w / 2 + (p[1] * w - w / 2) * cos(q) + (p[2] * h - h / 2) * sin(q)) / w, 0), 1) AS x, least(greatest((h / 2 - (p[1] * w - w / 2) * sin(q) + (p[2] * h - h / 2) * cos(q)) / h, 0), 1) AS y FROM c)
SELECT o_orderkey, round(CASE WHEN any_value(q) = 0 THEN any_value(x0) ELSE min(x) END, 9) AS x0, round(CASE WHEN any_value(q) = 0 THEN any_value(y0) ELSE min(y) END, 9) AS y0, round(CASE WHEN any_value(q) = 0 THEN any_value(x1) ELSE max(x) END, 9) AS x1, round(CASE WHEN any_value(q) = 0 THEN any_value(y1) ELSE max(y) END, 9) AS y1 FROM d GROUP BY o_orderkey"""
)
def unskew_rect(spark, sf_dir):
    r = g.unskewed_box(F.col("b"), F.col("dx") / 2, F.col("w"), F.col("h"))
    return _boxes(spark, sf_dir).select(K, r.alias("r")).select(K, *[F.round(f"r.{c}", 9).alias(c) for c in ("x0", "y0", "x1", "y1")])


def _quads(spark, sf_dir):
    """A sheet in a photo of each order, some of them twisted or full."""
    k = F.col(K)
    part = lambda m: (k % m) / F.lit(100.0)
    point = lambda x, y: F.array(x, y)
    full = F.array(*[point(F.lit(float(x)), F.lit(float(y))) for x, y in ((0, 0), (1, 0), (1, 1), (0, 1))])
    quad = F.array(point(part(7), part(11)), point(1 - part(13), part(5)), point(1 - part(9), 1 - part(8)), point(part(12), 1 - part(6)))
    twisted = F.array(quad[0], quad[2], quad[1], quad[3])
    return load(spark, sf_dir, "orders").select(K, F.when(k % 10 == 0, full).when(k % 10 == 1, twisted).otherwise(quad).alias("q"), (k % 4 * 90).cast("int").alias("turn"))


_QUAD = """q AS (SELECT o_orderkey, (o_orderkey % 4 * 90)::INTEGER AS turn, CASE o_orderkey % 10 WHEN 0 THEN [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0]] WHEN 1 THEN [q[1], q[3], q[2], q[4]] ELSE q END AS q FROM (
 SELECT o_orderkey, [[(o_orderkey % 7) / 100.0::DOUBLE, (o_orderkey % 11) / 100.0::DOUBLE], [1 - (o_orderkey % 13) / 100.0::DOUBLE, (o_orderkey % 5) / 100.0::DOUBLE],
 [1 - (o_orderkey % 9) / 100.0::DOUBLE, 1 - (o_orderkey % 8) / 100.0::DOUBLE], [(o_orderkey % 12) / 100.0::DOUBLE, 1 - (o_orderkey % 6) / 100.0::DOUBLE]]::DOUBLE[][] AS q FROM orders))"""


@query(
    f"""WITH {_QUAD}, t AS (SELECT o_orderkey, turn, i, q[(i - turn // 90 + 4) % 4 + 1] AS p, q[(i + turn // 90) % 4 + 1] AS b FROM q, range(4) r(i))
SELECT o_orderkey, i::INTEGER AS corner, CASE turn WHEN 90 THEN 1 - p[2] WHEN 180 THEN 1 - p[1] WHEN 270 THEN p[2] ELSE p[1] END AS x, CASE turn WHEN 90 THEN p[1] WHEN 180 THEN 1 - p[2] WHEN 270 THEN 1 - p[1] ELSE p[2] END AS y,
 CASE turn WHEN 270 THEN 1 - b[2] WHEN 180 THEN 1 - b[1] WHEN 90 THEN b[2] ELSE b[1] END AS bx, CASE turn WHEN 270 THEN b[1] WHEN 180 THEN 1 - b[2] WHEN 90 THEN 1 - b[1] ELSE b[2] END AS "by" FROM t"""
)
def quad_rotated(spark, sf_dir):
    both = F.arrays_zip(g.turned_quad(F.col("q"), F.col("turn")).alias("t"), g.unturned_quad(F.col("q"), F.col("turn")).alias("u"))
    rows = _quads(spark, sf_dir).select(K, F.posexplode(both).alias("corner", "p"))
    return rows.select(K, "corner", F.col("p.t")[0].alias("x"), F.col("p.t")[1].alias("y"), F.col("p.u")[0].alias("bx"), F.col("p.u")[1].alias("by"))


@query(
    f"""WITH {_QUAD}, c AS (SELECT o_orderkey, i, q[i + 1] AS p, q[(i + 1) % 4 + 1] AS n, q[(i + 2) % 4 + 1] AS m, [[0, 0], [1, 0], [1, 1], [0, 1]][i + 1] AS f FROM q, range(4) r(i)),
s AS (SELECT *, (n[1] - p[1]) * (m[2] - n[2]) - (n[2] - p[2]) * (m[1] - n[1]) AS x FROM c)
SELECT o_orderkey, min(abs(x)) >= 1e-9 AND (min(x) > 0 OR max(x) < 0) AS convex, max(greatest(abs(p[1] - f[1]), abs(p[2] - f[2]))) <= 0.01 AS full_frame, round(abs(sum(p[1] * n[2] - n[1] * p[2])) / 2, 9) AS area FROM s GROUP BY o_orderkey"""
)
def quad_checks(spark, sf_dir):
    q = F.col("q")
    return _quads(spark, sf_dir).select(K, g.is_convex(q).alias("convex"), g.is_full_frame(q).alias("full_frame"), F.round(g.polygon_area(q), 9).alias("area"))


_D = lambda a, b: f"sqrt((q[{b}][1] - q[{a}][1]) ** 2 + (q[{b}][2] - q[{a}][2]) ** 2)"
_DET = lambda a, b, c: f"({a}[1] * ({b}[2] - {c}[2]) + {a}[2] * ({c}[1] - {b}[1]) + ({b}[1] * {c}[2] - {b}[2] * {c}[1]))"


@query(
    f"""WITH {_QUAD}, px AS (SELECT o_orderkey, list_transform(q, lambda p: [p[1] * 1200, p[2] * 1600]) AS q FROM q WHERE o_orderkey % 10 <> 1),
m AS (SELECT *, [q[1][1] - 600, q[1][2] - 800] AS m1, [q[2][1] - 600, q[2][2] - 800] AS m2, [q[4][1] - 600, q[4][2] - 800] AS m3, [q[3][1] - 600, q[3][2] - 800] AS m4, {_D(1, 2)} AS t, {_D(4, 3)} AS b, {_D(1, 4)} AS l, {_D(2, 3)} AS r FROM px),
k AS (SELECT *, {_DET('m1', 'm4', 'm3')} / {_DET('m2', 'm4', 'm3')} AS k2, {_DET('m1', 'm4', 'm2')} / {_DET('m3', 'm4', 'm2')} AS k3 FROM m),
n AS (SELECT *, k2 * m2[1] - m1[1] AS ax, k2 * m2[2] - m1[2] AS ay, k2 - 1 AS az, k3 * m3[1] - m1[1] AS dx, k3 * m3[2] - m1[2] AS dy, k3 - 1 AS dz FROM k),
s AS (SELECT *, CASE WHEN abs(az) > 0.02 AND abs(dz) > 0.02 THEN -(ax * dx + ay * dy) / (az * dz) END AS seen FROM n),
f AS (SELECT *, CASE WHEN seen > 0.1225 * 4000000 AND seen < 4 * 4000000 THEN seen ELSE 0.4225 * 4000000 END AS f FROM s),
a AS (SELECT *, sqrt(((ax * ax + ay * ay) / f + az * az) / ((dx * dx + dy * dy) / f + dz * dz)) AS aspect, (t + b) / (l + r) AS plain FROM f),
p AS (SELECT *, CASE WHEN aspect > plain / 2.5 AND aspect < plain * 2.5 THEN aspect END AS ok FROM a)
SELECT o_orderkey, round(coalesce(greatest(t, b, greatest(l, r) * ok), (t + b) / 2), 4) AS width, round(CASE WHEN ok IS NULL THEN (l + r) / 2 ELSE greatest(t, b, greatest(l, r) * ok) / ok END, 4) AS height FROM p"""
)
def quad_size(spark, sf_dir):
    px = F.transform("q", lambda p: F.array(p[0] * 1200, p[1] * 1600))
    rows = _quads(spark, sf_dir).where(F.col(K) % 10 != 1).select(K, px.alias("q"))
    return rows.select(K, g.quad_size(F.col("q"), F.lit(1200.0), F.lit(1600.0)).alias("s")).select(K, F.round("s.width", 4).alias("width"), F.round("s.height", 4).alias("height"))


def _lists(spark, sf_dir):
    """A list of ten cards of each order and a move in it."""
    k = F.col(K)
    cards = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.struct(((i % 3) * 100.0).alias("left"), (F.floor(i / 3) * 130.0).alias("top"), ((i % 3) * 100.0 + 90).alias("right"), (F.floor(i / 3) * 130.0 + 100 + i).alias("bottom")))
    return load(spark, sf_dir, "orders").select(K, cards.alias("cards"), F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: i * 7 + k % 5).alias("items"), (k % 10).cast("int").alias("start"), (F.floor(k / 10) % 10).cast("int").alias("to"), (k % 310).cast("double").alias("x"), (k % 530).cast("double").alias("y"))


_LIST = "l AS (SELECT o_orderkey, o_orderkey % 10 AS a, o_orderkey // 10 % 10 AS b, (o_orderkey % 310)::DOUBLE AS x, (o_orderkey % 530)::DOUBLE AS y FROM orders)"


@query(
    f"""WITH {_LIST}, m AS (SELECT *, i, CASE WHEN i = a THEN b WHEN a < b AND i > a AND i <= b THEN i - 1 WHEN b < a AND i >= b AND i < a THEN i + 1 ELSE i END AS n FROM l, range(10) r(i))
SELECT o_orderkey, string_agg((i * 7 + o_orderkey % 5)::VARCHAR, ',' ORDER BY n) AS items, string_agg(n::VARCHAR, ',' ORDER BY i) AS places FROM m GROUP BY o_orderkey"""
)
def move_item(spark, sf_dir):
    places = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: g.new_index(i, F.col("start"), F.col("to")))
    return _lists(spark, sf_dir).select(K, F.array_join(g.moved_item(F.col("items"), F.col("start"), F.col("to")).cast("array<string>"), ",").alias("items"), F.array_join(places.cast("array<string>"), ",").alias("places"))


@query(
    f"""WITH {_LIST}, c AS (SELECT *, i, i % 3 * 100.0::DOUBLE AS l, i // 3 * 130.0::DOUBLE AS t, i // 3 * 130.0::DOUBLE + 100 + i AS b2 FROM l, range(10) r(i)),
d AS (SELECT *, greatest(t - y, 0, y - b2) AS away FROM c), n AS (SELECT *, min(away) OVER (PARTITION BY o_orderkey) AS nearest FROM d)
SELECT o_orderkey, arg_min(i, [abs(l + 45 - x), i])::INTEGER AS dropped FROM n WHERE away - nearest <= 0.5 GROUP BY o_orderkey"""
)
def drop_index(spark, sf_dir):
    return _lists(spark, sf_dir).select(K, g.drop_index(F.col("cards"), F.col("x"), F.col("y")).alias("dropped"))


@query(
    f"""WITH {_LIST}, s AS (SELECT *, least(80.0::DOUBLE, (300 + o_orderkey % 400) / 5) AS e, 300 + o_orderkey % 400 AS h, 1 + 2 * least(greatest(o_orderkey % 3000, 0) / 2000.0::DOUBLE, 1) AS boost FROM l)
SELECT o_orderkey, CASE WHEN y < e THEN -1.2::DOUBLE * boost * least(1.0::DOUBLE, (e - y) / e) WHEN y > h - e THEN 1.2::DOUBLE * boost * least(1.0::DOUBLE, (y - h + e) / e) ELSE 0.0::DOUBLE END AS speed,
 least(greatest(x - 150, least(0 - a * 20, 0)), greatest(300 - a * 20 - 90, 0))::DOUBLE AS shift FROM s"""
)
def edge_speed(spark, sf_dir):
    k = F.col(K)
    card = F.col("start") * 20
    return _lists(spark, sf_dir).select(K, g.edge_speed(F.col("y"), 300.0 + k % 400, (k % 3000).cast("double")).alias("speed"), g.held_shift(card, card + 90, F.lit(0.0), F.lit(300.0), F.col("x") - 150).alias("shift"))


def _strokes(spark, sf_dir):
    """Embeddings read as strokes: two components a point."""
    e = F.col("embedding")
    points = F.transform(F.sequence(F.lit(0), F.floor(F.size(e) / 2).cast("int") - 1), lambda i: F.array(F.get(e, 2 * i).cast("double"), F.get(e, 2 * i + 1).cast("double")))
    return load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("stroke_id"), points.alias("points"))


_STROKE = "pt AS (SELECT vec_id AS stroke_id, i, embedding[2 * i + 1]::DOUBLE AS x, embedding[2 * i + 2]::DOUBLE AS y, len(embedding) // 2 - 1 AS last FROM embeddings, range(512) r(i) WHERE i < len(embedding) // 2)"
_SMOOTH = lambda source: f"SELECT stroke_id, i, last, CASE WHEN i IN (0, last) THEN x ELSE (lag(x) OVER w + 2 * x + lead(x) OVER w) / 4 END AS x, CASE WHEN i IN (0, last) THEN y ELSE (lag(y) OVER w + 2 * y + lead(y) OVER w) / 4 END AS y FROM {source} WINDOW w AS (PARTITION BY stroke_id ORDER BY i)"


@query(f"WITH {_STROKE}, one AS ({_SMOOTH('pt')}) SELECT stroke_id, i::INTEGER AS i, x, y FROM ({_SMOOTH('one')})")
def stroke_smooth(spark, sf_dir):
    rows = _strokes(spark, sf_dir).select("stroke_id", F.posexplode(g.smoothed(F.col("points"), 2)).alias("i", "p"))
    return rows.select("stroke_id", "i", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


@query(
    f"""WITH RECURSIVE {_STROKE}, seg(stroke_id, a, b, level) AS (
 SELECT stroke_id, 0::BIGINT, max(last)::BIGINT, 0 FROM pt GROUP BY stroke_id
 UNION ALL SELECT stroke_id, unnest([a, k]), unnest([k, b]), level + 1 FROM (
  SELECT s.stroke_id, s.a, s.b, s.level, arg_max(p.i, [p_d, -p.i]) AS k, max(p_d) AS d FROM (
   SELECT s.stroke_id, s.a, s.b, s.level, p.i, sqrt((p.x - u.x - t * (v.x - u.x)) ** 2 + (p.y - u.y - t * (v.y - u.y)) ** 2) AS p_d FROM (
    SELECT s.*, p.i AS pi, CASE WHEN (v.x - u.x) ** 2 + (v.y - u.y) ** 2 > 0 THEN least(greatest(((p.x - u.x) * (v.x - u.x) + (p.y - u.y) * (v.y - u.y)) / ((v.x - u.x) ** 2 + (v.y - u.y) ** 2), 0), 1) ELSE 0 END AS t
    FROM seg s JOIN pt u ON u.stroke_id = s.stroke_id AND u.i = s.a JOIN pt v ON v.stroke_id = s.stroke_id AND v.i = s.b JOIN pt p ON p.stroke_id = s.stroke_id AND p.i > s.a AND p.i < s.b) s
   JOIN pt u ON u.stroke_id = s.stroke_id AND u.i = s.a JOIN pt v ON v.stroke_id = s.stroke_id AND v.i = s.b JOIN pt p ON p.stroke_id = s.stroke_id AND p.i = s.pi) AS p(stroke_id, a, b, level, i, p_d)
  JOIN (SELECT 1) one ON true JOIN seg s ON s.stroke_id = p.stroke_id AND s.a = p.a AND s.b = p.b GROUP BY s.stroke_id, s.a, s.b, s.level HAVING max(p_d) > 0.3))
SELECT stroke_id, count(DISTINCT p) AS n, string_agg(DISTINCT p::VARCHAR, ',' ORDER BY p::VARCHAR) AS places FROM (SELECT stroke_id, unnest([a, b]) AS p FROM seg) GROUP BY stroke_id"""
)
def stroke_simplify(spark, sf_dir):
    kept = strokes.simplify(_strokes(spark, sf_dir), 0.3)
    return kept.select("stroke_id", F.size("points").cast("bigint").alias("n"), F.array_join(F.array_sort(F.col("points").cast("array<string>")), ",").alias("places"))


@query(
    f"""WITH {_BOX} SELECT o_orderkey, round(0.72::DOUBLE * 0.6::DOUBLE - greatest(0, least(x1, 0.9::DOUBLE) - greatest(x0, 0.18::DOUBLE)) * greatest(0, least(y1, 0.8::DOUBLE) - greatest(y0, 0.2::DOUBLE)), 9) AS area FROM b"""
)
def area_without_rect(spark, sf_dir):
    b = F.col("b")
    area = F.array(*[F.array(F.lit(x), F.lit(y)) for x, y in ((0.18, 0.2), (0.9, 0.2), (0.9, 0.8), (0.18, 0.8))])
    parts = g.without_rect(area, b["x0"], b["y0"], b["x1"], b["y1"])
    left = F.aggregate(F.transform(parts, g.polygon_area), F.lit(0.0), lambda a, x: a + x)
    return _boxes(spark, sf_dir).select(K, F.round(left, 9).alias("area"))
