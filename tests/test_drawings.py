"""Paths under redactions against sampled points and hand-made cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from pagelathe.operators import cuts

STROKES = "page_id bigint, stroke_no bigint, points array<array<double>>, closed boolean"
RECTS = "page_id bigint, x0 double, y0 double, x1 double, y1 double"


def pieces(spark, strokes, rects, edge=0.0):
    rows = cuts.cut_strokes(spark.createDataFrame(strokes, STROKES), spark.createDataFrame(rects, RECTS), edge).orderBy("page_id", "stroke_no", "piece_no").collect()
    return [(r.stroke_no, r.points, r.closed) for r in rows]


def test_hand_made_strokes(spark):
    line = [[0.0, 0.0], [10.0, 0.0], [10.0, 10.0]]
    square = [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0]]
    rects = [(1, 2.0, -1.0, 4.0, 1.0), (1, 3.0, -1.0, 5.0, 1.0), (1, 9.0, -1.0, 11.0, 1.0), (2, -1.0, -1.0, 9.0, 9.0), (3, 1.0, 3.0, 3.0, 5.0), (4, None, 0.0, 1.0, 1.0)]
    strokes = [(1, 1, line, False), (2, 2, square, True), (3, 3, square, True), (4, 4, square, True), (5, 5, line, None), (1, 6, [[0.0, 1.0], [9.5, 1.0]], False), (1, 7, [[3.0, 0.0]], False), (1, 8, None, False), (1, 9, [], False)]
    got = pieces(spark, strokes, rects)
    assert got == [
        (1, [[0, 0], [2, 0]], False),
        (1, [[5, 0], [9, 0]], False),
        (1, [[10, 1], [10, 10]], False),
        (6, [[0, 1], [9.5, 1]], False),  # along the side is outside
        (3, [[0, 0], [4, 0], [4, 4], [3, 4]], False),
        (3, [[1, 4], [0, 4], [0, 0]], False),
        (4, square, True),
        (5, line, False),
    ]


def test_rects_and_pages_missing(spark):
    assert pieces(spark, [], [(1, 0.0, 0.0, 1.0, 1.0)]) == []
    assert pieces(spark, [(1, 1, [[0.0, 0.0], [1.0, 1.0]], False)], []) == [(1, [[0, 0], [1, 1]], False)]


def test_random_strokes(spark):
    """Points of the pieces lie outside; together they are as long as what sampling sees outside."""
    rng = random.Random(5)
    strokes = [(s % 4, s, [[rng.uniform(0, 20), rng.uniform(0, 20)] for _ in range(rng.randint(2, 40))], rng.random() < 0.3) for s in range(60)]
    rects = []
    for _ in range(40):
        x, y = rng.uniform(0, 18), rng.uniform(0, 18)
        rects.append((rng.randrange(4), x, y, x + rng.uniform(0, 4), y + rng.uniform(0, 4)))
    found = {}
    for s, points, closed in pieces(spark, strokes, rects, 0.02):
        line = points + points[:1] if closed else points
        found[s] = found.get(s, 0.0) + sum(math.dist(a, b) for a, b in zip(line, line[1:]))
        for x, y in points:
            assert not any(r[0] == s % 4 and r[1] - 0.0199 < x < r[3] + 0.0199 and r[2] - 0.0199 < y < r[4] + 0.0199 for r in rects)
    for page, s, points, closed in strokes:
        line, want, steps = points + points[:1] if closed else points, 0.0, 2000
        mine = [r for r in rects if r[0] == page]
        for a, b in zip(line, line[1:]):
            seen = sum(not any(r[1] - 0.02 < a[0] + (b[0] - a[0]) * t < r[3] + 0.02 and r[2] - 0.02 < a[1] + (b[1] - a[1]) * t < r[4] + 0.02 for r in mine) for t in ((k + 0.5) / steps for k in range(steps)))
            want += math.dist(a, b) * seen / steps
        assert found.get(s, 0.0) == pytest.approx(want, rel=2e-3, abs=0.3)


def test_flattened(spark):
    k = 0.5523 * 50
    circle = [("M", [50.0, 0.0]), ("C", [50.0, k, k, 50.0, 0.0, 50.0]), ("C", [-k, 50.0, -50.0, k, -50.0, 0.0]), ("C", [-50.0, -k, -k, -50.0, 0.0, -50.0]), ("C", [k, -50.0, 50.0, -k, 50.0, 0.0]), ("Z", None)]
    rows = [(1, i, *c) for i, c in enumerate(circle)]
    rows += [(2, i, *c) for i, c in enumerate([("L", [3.0, 4.0]), ("Z", None), ("L", [1.0, 1.0]), ("M", [7.0, 7.0]), ("Q", [8.0, 7.0, 9.0, 7.0]), ("X", [1.0, 2.0]), (None, [1.0, 2.0])])]
    got = {(r.path_id, r.part_no): r for r in cuts.flattened(spark.createDataFrame(rows, "path_id bigint, step_no int, op string, v array<double>")).collect()}
    ring = got[1, 0]
    assert ring.closed and len(ring.points) > 30 and all(abs(math.hypot(*p) - 50) < 0.1 for p in ring.points)
    assert got[2, 0].points == [[0, 0], [3, 4]] and got[2, 0].closed
    assert not got[2, 1].closed and got[2, 1].points[-1] == [1, 1]
    assert got[2, 2].points[0] == [7, 7] and got[2, 2].points[-1] == [9, 7]


def test_areas(spark):
    square = F.array(*[F.array(F.lit(x), F.lit(y)) for x, y in ((0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0))])
    rects = spark.createDataFrame([([(1.0, 1.0, 2.0, 2.0), (1.5, 1.5, 3.0, 3.0)],), ([(-1.0, -1.0, 5.0, 5.0)],), ([],)], "r array<struct<x0:double,y0:double,x1:double,y1:double>>")
    from pagelathe.functions.geometry import polygon_area

    got = [sum(r) for (r,) in rects.select(F.transform(cuts.area_outside(square, F.col("r"), 0.0), polygon_area)).collect()]
    assert got == [16 - 1 - 2.25 + 0.25, 0, 16]
