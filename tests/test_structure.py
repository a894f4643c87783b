"""Inheritance, targets, findings in pieces and typed dates."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from pagelathe.functions import dates
from pagelathe.operators import pages, structure


def test_inherit_with_cycles(spark):
    rows = spark.createDataFrame([(1, None, 10), (2, 1, None), (3, 2, None), (4, 3, 7), (5, 6, None), (6, 5, None)], "id int, up int, v int")
    assert {r.id: r.v for r in structure.inherit(rows, "id", "up", ["v"]).collect()} == {1: 10, 2: 10, 3: 10, 4: 7, 5: None, 6: None}


def test_reachable_with_cycles(spark):
    refs = spark.createDataFrame([(1, 1, 2), (1, 2, 1), (1, 2, 3), (1, 9, 8), (2, 1, 5)], "doc_id int, src int, dst int")
    roots = spark.createDataFrame([(1, 1)], "doc_id int, num int")
    assert {tuple(r) for r in pages.reachable(roots, refs).collect()} == {(1, 1), (1, 2), (1, 3)}


def piece(text, x, y=0.1, line=None, step=0.01):
    return (1, text, [x + step * i for i in range(len(text) + 1)], y, y + 0.02, line, 600.0, 800.0)


@pytest.mark.parametrize(
    ("pieces", "values"),
    [
        ([piece("529.982", 0.1), piece(".247-25,", 0.18)], ["529.982.247-25"]),
        ([piece("CPF", 0.1), piece("529.982.247-25", 0.2)], ["529.982.247-25"]),
        ([piece("529.982.247-25", 0.1, 0.1, 3), piece("x@y.org", 0.4, 0.2, 3)], ["529.982.247-25", "x@y.org"]),
        ([piece("nada", 0.1)], []),
    ],
)
def test_find_in_pieces(spark, pieces, values):
    rows = spark.createDataFrame(pieces, "page_id bigint, str string, xs array<double>, y0 double, y1 double, line int, width double, height double")
    got = structure.find_in_pieces(rows).orderBy("line_no", "start").collect()
    assert [r.value for r in got] == values
    assert all(r.x0 < r.x1 and r.y0 < r.y1 for r in got)


def test_dates(spark):
    typed = ["5/2/24", "050224", "5/2/49", "5/2/50", "5 de fevereiro de 2024", "29/02/1900", "31/04/2024", "05022024", "3 mar 2021", "x", None]
    rows = spark.createDataFrame(list(enumerate(typed)), "i int, t string").orderBy("i")
    got = [r[0] for r in rows.select(dates.read_date(F.col("t"))).collect()]
    assert got == [date(2024, 2, 5), date(2024, 2, 5), date(2049, 2, 5), date(1950, 2, 5), date(2024, 2, 5), None, None, date(2024, 2, 5), date(2021, 3, 3), None, None]
    shown = spark.range(1).select(*[dates.print_date(F.lit("2024-02-05 14:03:09").cast("timestamp"), p) for p in ("dd/mm/yyyy", "mmm d, yyyy", "HH:MM", "h:MM tt")]).first()
    assert tuple(shown) == ("05/02/2024", "Feb 5, 2024", "14:03", "2:03 pm")


def test_dealt_join_is_not_broadcast(spark, tmp_path):
    """Files that compress well look small, but their rows need not fit the driver."""
    from pagelathe.lineage import dealt_join

    spark.range(1000).selectExpr("id", "id div 2 AS up").write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    made = dealt_join(rows, rows.selectExpr("id AS up", "up AS next"), ["up"], ["id"])
    assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()
    assert made.where("next = up div 2").count() == 1000


def test_cuts_of_shared_places(spark):
    """Edits and rectangles that share their places meet once; every copy keeps its cuts."""
    from pagelathe.operators import trees

    sides = "page_id int, {} x0 double, y0 double, x1 double, y1 double"
    edits = spark.createDataFrame([(1, n, 0.0, 0.0, 0.5, 0.5, 0) for n in range(3)] + [(1, 9, 0.0, 0.0, 0.5, 0.5, 180), (2, 0, 0.0, 0.0, 1.0, 1.0, 0)], sides.format("edit_no int,") + ", turn int")
    rects = spark.createDataFrame([(1, 0.0, 0.0, 0.25, 0.25)] * 2 + [(1, 0.4, 0.4, 0.9, 0.9)], sides.format(""))
    one, two, back, far = "0.0000,0.0000,0.5000,0.5000", "0.8000,0.8000,1.0000,1.0000", "0.5000,0.5000,1.0000,1.0000", "0.0000,0.0000,0.2000,0.2000"
    got = {(r.page_id, r.edit_no): r.cuts for r in trees.image_cuts(edits, rects, ";").collect()}
    assert got == {**{(1, n): ";".join([one, one, two]) for n in range(3)}, (1, 9): ";".join([far, back, back])}
    assert trees.image_cuts(edits, rects).where("edit_no = 0").first().cuts == [one, one, two]


def test_images_of_a_place_are_dealt_once(spark, tmp_path):
    """Copies of a text are written by one task, so they are dealt by place, by one exchange; sides of -0 and 0 are one place."""
    from pagelathe.operators import trees

    sides = "page_id int, {} x0 double, y0 double, x1 double, y1 double"
    rows = [(p, 10 * p + n, [0.0, -0.0][n % 2], 0.0, 0.5, 0.5, 0) for p in range(20) for n in range(4)] + [(None, 1, 0.0, 0.0, 1.0, 1.0, 0), (1, 2, None, 0.0, 1.0, 1.0, 0)]
    spark.createDataFrame(rows, sides.format("edit_no int,") + ", turn int").write.parquet(str(tmp_path / "edits"))
    rects = spark.createDataFrame([(p, 0.0, 0.0, 0.25, 0.25) for p in range(20)] * 3, sides.format(""))
    made = trees.image_cuts(spark.read.parquet(str(tmp_path / "edits")), rects, ";")
    told = made._jdf.queryExecution().executedPlan().toString()
    left = told[told.index("SortMergeJoin") :].split("FileScan")[0]
    assert left.count("Exchange") == 1 and "REPARTITION_BY_NUM" in left
    got = made.withColumn("task", F.spark_partition_id()).collect()
    assert len(got) == 80 and {r.cuts for r in got} == {";".join(["0.0000,0.0000,0.5000,0.5000"] * 3)}
    assert len({(r.page_id, r.task) for r in got}) == 20
