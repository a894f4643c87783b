"""What crosses the network, and how often a value is made, by the plans of queries over small tables."""

import pytest

from pagelathe.functions import personal
from pagelathe.operators import images, lists
from pagelathe.plans import queries
from pyspark.sql import functions as F


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(1, "a@b.org and more, words. Of it " * 4), (2, " \n"), (3, None)], "doc_id bigint, text string").write.parquet(f"{at}/documents.parquet")
    spark.range(70).selectExpr("id AS p_partkey").union(spark.range(70).selectExpr("id AS p_partkey")).write.parquet(f"{at}/part.parquet")
    spark.range(5).selectExpr("id AS s_suppkey").write.parquet(f"{at}/supplier.parquet")
    return at


def made(name, spark, tables):
    return queries.queries()[name](spark, tables)


@pytest.mark.parametrize("name", ["find_in_pieces", "lines_text", "text_targets", "replaced_texts", "redact_words_anti"])
def test_texts_are_dealt_before_they_become_words(spark, tables, name):
    """Read from the top of the plan, words are made above the only exchange of documents."""
    told = plan(made(name, spark, tables))
    assert told.index("Generate posexplode") < told.index("REPARTITION_BY_NUM")
    assert "Exchange hashpartitioning(page_id" not in told[told.index("Generate explode") if name == "find_in_pieces" else 0 : told.index("Generate posexplode")]


def test_places_of_letters_go_where_nobody_reads_them(spark, tables):
    assert "flatten" not in plan(made("find_in_pieces", spark, tables))
    assert made("find_in_pieces", spark, tables).groupBy("type").agg(F.sum("n").alias("n")).collect() == [("email", 4)]


def test_curves_are_made_once_a_setting(spark, tables):
    df = made("tone_curves", spark, tables)
    assert "HashAggregate(keys=[black" in plan(df).replace("knownfloatingpointnormalized(normalizenanandzero(", "")
    k = F.col("p_partkey")
    each = images.tone_curve((k % 30) / F.lit(100.0), 0.7 + (k % 40) / F.lit(100.0), 0.5 + (k % 9) / F.lit(4.0))
    total = F.aggregate(F.transform(each, lambda x, i: x * (i % 7 + 1)), F.lit(0).cast("bigint"), lambda a, x: a + x)
    assert sorted(df.collect()) == sorted(spark.read.parquet(f"{tables}/part.parquet").select(k, total).collect())


@pytest.mark.parametrize("name", ["cnpj_check_digits", "cnpj_alnum"])
def test_endings_are_tried_on_every_core(spark, tables, name):
    """Few roots are dealt before they are tried, and a tried text is cleaned once."""
    told = plan(made(name, spark, tables))
    assert told.index("Generate explode") < told.index("REPARTITION_BY_NUM")
    assert told[: told.index("Generate explode")].count("regexp_replace") == 1
    assert made(name, spark, tables).count() == 5


def test_company_numbers(spark):
    typed = {"11.222.333/0001-81": True, "11222333000180": False, "12.abc.345/01de-35": True, "00000000000000": False, "1122233300018": False, "": False, None: False}
    rows = spark.createDataFrame([(t,) for t in typed], "t string")
    assert {r.t: r.ok for r in rows.select("t", personal.valid_cnpj(F.col("t")).alias("ok")).collect()} == typed


def test_sections_hold_no_set_of_numbers(spark):
    rows = spark.createDataFrame([(1, 3), (1, 4), (1, 4), (1, 7), (1, None), (1, None), (2, -1), (2, 0), (None, 5)], "d int, n int")
    got = lists.sections(rows, "d", "n")
    assert plan(got).count("HashAggregate(keys=[d") <= 2
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, 3, 2), (1, 7, 1), (1, None, 1), (2, -1, 2), (None, 5, 1)], key=str)


@pytest.mark.parametrize("name", ["sanitize_text", "winansi_filter"])
def test_texts_are_dealt_before_they_are_read(spark, tables, name):
    told = plan(made(name, spark, tables))
    assert told.index("Project") < told.index("REPARTITION_BY_NUM")
    assert len(told) < 100_000  # one replacement for each pair of letter and mark before


def test_composed_letters(spark):
    from pagelathe.functions import glyphs

    every = "".join(glyphs._marks())
    texts = [every, "a\u0301\u0301b", "x\u0301", "\u0301a\u0308\u0302", "e\n\u0301 e\u0301", "漢\u0301€\x07ÿ\x85", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i")

    def want(t):
        for pair, letter in glyphs._marks().items():
            t = t.replace(pair, letter)
        return t

    assert [r[0] for r in rows.select(glyphs.composed(F.col("t"))).collect()] == [t and want(t) if t is not None else None for t in texts]
    known = {*map(chr, [*range(0x20, 0x7F), *range(0xA0, 0x100)]), *(c for c in glyphs.HIGH if c)}
    got = rows.select(F.regexp_extract_all("t", F.lit(glyphs.OUTSIDE), F.lit(0))).collect()
    assert [r[0] for r in got] == [None if t is None else [c for c in t if c not in known] for t in texts]


def test_curves_are_drawn_twice_at_most(spark, tables):
    """Once to find what is hidden, once to cut; before, a third time to count points."""
    rows = [(k, k % 4, [float((k * 7 + i * 3) % 11) / 10 for i in range(20)]) for k in range(30)]
    spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>").write.mode("overwrite").parquet(f"{tables}/embeddings.parquet")
    df = made("curve_cuts", spark, tables)
    assert plan(df).count("collect_list(struct(step_no") <= 4  # a partial and a final one each
    assert "REPARTITION_BY_NUM" in plan(df)
    assert all(r.n_points > 1 for r in df.collect())


@pytest.mark.parametrize("name", ["redact_letters", "document_text_redacted", "redaction_postcondition"])
def test_texts_cross_once_to_be_redacted(spark, tables, name):
    """Lines are made above the only exchange of texts, and neither they nor what is left of them is dealt again."""
    told = plan(made(name, spark, tables))
    assert told.index("Generate posexplode") < told.index("REPARTITION_BY_NUM")
    dealings = [line for line in told.splitlines() if "Exchange" in line]
    assert all("item_no" not in line for line in dealings)


def test_blank_boxes_of_a_page(spark):
    """A page of blank boxes has no lines; a flag of a blank box counts for its page."""
    from pagelathe.operators import reading

    rows = [(1, 2, "b", False), (1, 1, "a", False), (1, 3, " ", True), (2, 1, " ", True), (3, 1, "c", False), (None, 1, "d", True)]
    boxes = spark.createDataFrame(rows, "page_id int, box_no int, str string, under boolean").selectExpr("*", "0D AS x0", "box_no / 10D AS y0", "1D AS x1", "box_no / 10D + 0.05D AS y1", "100D AS page_width", "100D AS page_height")
    assert sorted(map(tuple, reading.lines_text(boxes, "under").collect())) == [(1, "a\nb", True), (3, "c", False)]
    assert sorted(map(tuple, reading.lines_text(boxes).collect())) == [(1, "a\nb"), (3, "c")]


def test_steps_of_cut_curves_are_compiled(spark, tables):
    """Java only interprets methods of over 8,000 bytes: the step that meets segments with rectangles was one of these."""
    rows = [(k, k % 4, [float((k * 7 + i * 3) % 11) / 10 for i in range(20)]) for k in range(30)]
    spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>").write.mode("overwrite").parquet(f"{tables}/embeddings.parquet")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        made_ = made("curve_cuts", spark, tables)
        told = made_._jdf.queryExecution().debug().codegenToSeq()
        sizes = [told.apply(k)._3().maxMethodCodeSize() for k in range(told.size())]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sizes and max(sizes) < 8000


def test_commands_dealt_by_pages_are_not_dealt_again(spark):
    from pagelathe.operators import cuts

    rows = [(p, 10 * p + k, s, "MLQZC"[s], [float(p + k + s + i) for i in range([2, 2, 4, 0, 6][s])]) for p in range(3) for k in range(2) for s in range(5)]
    commands = spark.createDataFrame(rows, "page_id int, path_id int, step_no int, op string, v array<double>")
    drawn = cuts.flattened(commands.repartition(5, "page_id"), ("page_id",))
    assert plan(drawn).count("Exchange") == 1
    plain = {(r.path_id, r.part_no): (r.points, r.closed) for r in cuts.flattened(commands).collect()}
    assert len(plain) == 12 and {(r.path_id, r.part_no): (r.points, r.closed) for r in drawn.collect()} == plain
    assert all(r.path_id // 10 == r.page_id for r in drawn.collect())
