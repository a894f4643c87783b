"""Cases that the queries' tables do not hold: damage, bounds, nulls, long texts."""

import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelathe.functions import formats, geometry, glyphs, personal, values
from pagelathe.operators import items, strokes, structure
from pagelathe.sources import headers, packages, pdf, writer


def test_damaged_stream_keeps_what_was_readable():
    rng = random.Random(1)
    plain = bytes(rng.randrange(97, 105) for _ in range(200_000))
    packed = bytearray(zlib.compress(plain))
    packed[len(packed) // 2] ^= 255
    got = packages.inflate(bytes(packed), 1 << 20, raw=False, lenient=True)
    assert 60_000 < len(got) and got[:60_000] == plain[:60_000]
    with pytest.raises(packages.PackageError):
        packages.inflate(bytes(packed), 1 << 20, raw=False)


def by_byte(data, colors, columns):
    """The predictors of rows, a byte at a time."""
    width, before, out = colors * columns, [0] * (colors * columns), []
    for at in range(0, len(data), width + 1):
        kind, row = data[at], list(data[at + 1 : at + 1 + width])
        for i in range(width):
            a, b, c = (row[i - colors] if i >= colors else 0), before[i], (before[i - colors] if i >= colors else 0)
            p = a + b - c
            near = min((a, b, c), key=lambda x: abs(p - x))
            row[i] = (row[i] + (0, a, b, (a + b) // 2, near)[kind]) % 256
        out += row
        before = row
    return bytes(out)


@pytest.mark.parametrize("colors", [1, 3])
def test_predictors(colors):
    rng = np.random.default_rng(colors)
    rows = rng.integers(0, 256, (20, 7 * colors + 1), dtype=np.uint8)
    rows[:, 0] = np.arange(20) % 5
    data = rows.tobytes()
    assert pdf.unpredict(data, {"Predictor": 15, "Colors": colors, "Columns": 7}) == by_byte(data, colors, 7)


def test_page_walk_raises_beyond_its_bound(monkeypatch):
    monkeypatch.setattr(pdf, "MOST_PAGES", 3)
    page = [(40.0, 50.0, "x", "Courier", 10.0)]
    assert len(pdf.Pdf(writer.write_file([page] * 3, 600, 800)).pages()) == 3
    with pytest.raises(packages.PackageError, match="too many pages"):
        pdf.Pdf(writer.write_file([page] * 4, 600, 800)).pages()


def test_later_packed_object_wins():
    inner = b"7 0 (new)"
    packed = zlib.compress(inner)
    data = b"%PDF-1.7\n1 0 obj << /Type /Catalog >> endobj\n7 0 obj (old) endobj\n"
    data += b"9 0 obj << /Type /ObjStm /N 1 /First 4 /Filter /FlateDecode /Length %d >> stream\n%b\nendstream endobj\ntrailer << /Root 1 0 R >>" % (len(packed), packed)
    assert pdf.Pdf(data).get(pdf.Ref(7)) == b"new"


def test_written_table_of_objects():
    data = writer.write_file([[(1.0, 2.0, "a (é\\)", "Times-Roman", 9.5)], []], 300, 400)
    start = int(data.rsplit(b"startxref\n", 1)[1].split()[0])
    lines = data[start:].split(b"\n")
    assert lines[0] == b"xref"
    for k, line in enumerate(lines[3 : 2 + int(lines[1].split()[1])]):
        assert data[int(line[:10]) :].startswith(b"%d 0 obj" % (k + 1))
    doc = pdf.Pdf(data)
    assert [doc.text(p) for p in doc.pages()] == ["a (é\\)", ""]


def test_photo_heads():
    frame = bytes.fromhex("FFC0000B080102030401000000")
    assert headers.photo_head(b"\xff\xd8" + frame) == (0x0304, 0x0102, 1)
    for bad in (b"", b"\xff\xd8", b"\x89PNG" + frame):
        with pytest.raises(packages.PackageError):
            headers.photo_head(bad)


def test_spans_are_linear_in_matches():
    text = " ".join(f"a{k}@mail.org" for k in range(16_000))
    began = time.time()
    assert len(personal.spans_of(text)) == 16_000
    assert time.time() - began < 2


def test_inheritance_of_long_chains_and_cycles(spark):
    rows = [(k, k - 1 if k else None, 7 if k == 0 else None) for k in range(700)] + [(1000, 1001, None), (1001, 1000, None)]
    got = {r.id: r.v for r in structure.inherit(spark.createDataFrame(rows, "id int, up int, v int"), "id", "up", ["v"]).collect()}
    assert got[699] == 7 and got[1000] is None and len(got) == 702


def test_strokes(spark):
    line = np.array([[x, 0.0] for x in range(10)])
    assert strokes.simplified(line, 0.1).tolist() == [0, 9] and strokes.simplified(line[:1], 0.1).tolist() == [0]
    assert strokes.apart(np.array([[0, 0], [0.1, 0], [2, 0], [2.1, 0]]), 0.5).tolist() == [[0, 0], [2.1, 0]]
    rows = [(1, [[0.0, 0.0], [0.5, 0.5], [1.0, 1.0]]), (2, None), (3, []), (4, [[0.2, 0.2]])]
    got = {r.stroke_id: r.points for r in strokes.prepare(spark.createDataFrame(rows, "stroke_id bigint, points array<array<double>>"), 100, 100).collect()}
    assert got == {1: [[0.0, 0.0], [1.0, 1.0]], 2: None, 3: None, 4: [[0.2, 0.2]]}


def one(spark, column, *args):
    names = [f"c{k}" for k in range(len(args))]
    return spark.createDataFrame([tuple(args)], names).select(column(*map(F.col, names)).alias("x")).collect()[0].x


def test_scripts(spark):
    call = lambda t: one(spark, formats.parse_call, t)
    assert call(" f ( ) ;").name == "f" and call("f();g()") is None and call("f(x)") is None and call('f("a', ) is None
    assert call("f('a\\'b', \"c,d\", -1.5, true)").args == ["'a\\'b'", '"c,d"', "-1.5", "true"]
    assert one(spark, formats.literal, '"R\\u0024\\x20\\\\n\\n"') == "R$ \\n\n" and one(spark, formats.literal, "'\\1'") is None
    assert one(spark, lambda m, t: formats.fill_mask(m, t), "99-A", "1.2 x!") == "12-x"
    assert one(spark, lambda m, t: formats.fill_mask(m, t), "99-A", "123") is None


def test_values(spark):
    assert one(spark, values.field_label, "#C3#A7a.CampoNovo[0]_2") == "Campo Novo 2" and one(spark, values.field_label, "check box 12") == ""
    assert one(spark, lambda t: values.wrapped(t, 5), "ab cdefghijkl m\nn") == ["ab", "cdefg", "hijkl", "m", "n"]
    assert one(spark, values.der_oid, "1.2.840.113549") == "06062A864886F70D"
    assert one(spark, glyphs.sanitized, "e\u0301 \u2192 \u6f22") == "\u00e9 -> ?"


def test_letters_under_rectangles(spark):
    page = spark.createDataFrame([(1, 0, 0.0, 10.0, "abcdef", "Courier", 10.0, 0.0, 0.0), (2, 0, 0.0, 10.0, "kept", "Courier", 10.0, None, 0.0)], "page_id int, item_no int, x double, y double, text string, font string, size double, rise double, word_spacing double")
    rects = spark.createDataFrame([(1, 0, 0.12, 0.0, 0.24, 1.0, None)], "page_id int, rect_no int, x0 double, y0 double, x1 double, y1 double, text string")
    got = sorted((r.page_id, r.part_no, r.x, r.text) for r in items.redact_texts(page, rects, 100.0, 100.0).collect())
    assert got == [(1, 0, 0.0, "ab"), (1, 1, 24.0, "ef"), (2, 0, 0.0, "kept")]
    assert items.left_under(items.boxes(page, 100.0, 100.0), rects).count() == 1
    assert [r.clean for r in items.clean_texts(page, rects, 100.0, 100.0).collect()] == [True, True]


def test_quads(spark):
    square = [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0]]
    assert one(spark, lambda q: geometry.is_convex(q), square) and one(spark, lambda q: geometry.is_full_frame(q), square)
    assert one(spark, lambda q: geometry.polygon_area(q), square) == 1.0
    assert one(spark, lambda q: F.size(geometry.without_rect(q, F.lit(0.25), F.lit(0.25), F.lit(0.5), F.lit(0.5))), square) == 4


def test_readings_of_documents_take_no_shuffle(spark, tmp_path):
    from pagelathe.plans import trees as plans

    spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(10))), (2, "  "), (3, None)], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    made = plans.flat_words(spark, str(tmp_path))
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    assert [(r.word_no, r.text, r["last"]) for r in made.orderBy("word_no").collect()] == [(i, f"w{i}", i in (7, 9)) for i in range(10)]
