"""Replacement texts: marks, growth, sizes and width tables by hand."""

import pytest
from pyspark.sql import functions as F

from pagelathe.operators import replace

MARKED = "id int, x0 double, y0 double, x1 double, y1 double, size double, page_width double, page_height double, text string, family string"


def test_marks_and_sizes(spark):
    rows = [
        (1, 0.1, 0.1, 0.2, 0.12, 0.02, 500.0, 1000.0, "WIDER TEXT", "mono"),
        (2, 0.1, 0.1, 0.9, 0.12, 0.02, 500.0, 1000.0, "ab  ", "mono"),
        (3, 0.1, 0.1, 0.9, 0.12, None, 500.0, 1000.0, "ab\nc", "mono"),
        (4, 0.1, 0.1, 0.9, 0.12, 0.02, 500.0, 1000.0, " \n", "mono"),
        (5, 0.1, 0.1, 0.9, 0.12, 0.02, 500.0, 1000.0, None, "mono"),
        (6, 0.9, 0.1, 0.99, 0.12, 0.02, 500.0, 1000.0, "far too long for the page", "mono"),
        (7, 0.5, 0.5, 0.5, 0.5, None, 500.0, 1000.0, "x", None),
    ]
    frame = spark.createDataFrame(rows, MARKED)
    mark = replace.marks(frame).where("id = 1").first()
    assert (mark.x0, mark.y0, mark.x1, mark.y1) == pytest.approx((0.092, 0.0976, 0.208, 0.1224))
    assert replace.marks(frame.where("id = 3")).first().x0 == pytest.approx(0.1 - 0.0024 * 2)
    got = {r.id: r for r in replace.fitted(frame).collect()}
    assert got[1].grew and got[1].x1 == pytest.approx(0.1 + 6.4 * 20 / 500) and got[1].edit.points == pytest.approx(20)
    assert not got[2].grew and got[2].text == "ab" and got[2].edit.points == 20 and got[2].edit.x1 == pytest.approx(0.1 + 1.6 * 20 / 500)
    assert got[3].edit.points == pytest.approx(20 / 2.9) and got[3].edit.y0 == pytest.approx(0.1) and got[3].edit.y1 == pytest.approx(0.12)
    assert got[4].edit is None and got[5].edit is None and got[7].edit is None
    assert got[6].grew and got[6].x1 == 1 and got[6].edit.points == pytest.approx(50 / (25 * 0.6 + 0.4)) and got[6].edit.x1 == pytest.approx(1)


def test_width_tables(spark):
    metrics = spark.createDataFrame([("Helvetica", 105, 222), ("Helvetica", 105, 300), ("Helvetica", 109, 833), ("Helvetica", 128, 556), ("Helvetica", 10, 1), (None, 40, 1), ("Times-Roman", 105, None)], "font string, code int, width int")
    fonts = replace.width_arrays(metrics)
    assert [r.font for r in fonts.collect()] == ["Helvetica"]
    rows = spark.createDataFrame([("im€",), ("iz",), (None,)], "t string").crossJoin(fonts)
    got = [r[0] and r[0].width for r in rows.select(replace.unit_size(F.col("t"), F.col("font"), F.col("widths"))).collect()]
    assert got[:2] == pytest.approx([0.222 + 0.833 + 0.556 + 0.4, 0.5 + 0.4]) and got[2] is None
    frame = spark.createDataFrame([(1, 0.0, 0.0, 0.5, 0.5, None, 100.0, 100.0, "mmm", "sans"), (2, 0.0, 0.0, 0.5, 0.5, None, 100.0, 100.0, "mmm", "serif")], MARKED)
    got = {r.id: r.edit.points for r in replace.fitted(frame, fonts).collect()}
    assert got == pytest.approx({1: 50 / (3 * 0.833 + 0.4), 2: 50 / (3 * 0.6 + 0.4)})
