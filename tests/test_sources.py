"""Readers of markup, packages and page-description files, on files built here."""

import io
import random
import zipfile
import zlib

import pytest

from pagelathe.sources import markup, packages, pdf

W = 'xmlns:x="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(body, **parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f"<x:document {W}><x:body>{body}</x:body></x:document>")
        rels = "".join(f'<Relationship Id="r{i}" Target="{n}"/>' for i, n in enumerate(parts.values()))
        z.writestr("word/_rels/document.xml.rels", f"<Relationships>{rels}</Relationships>")
        for n in parts.values():
            z.writestr(f"word/{n}", f"<x:hdr {W}><x:p><x:r><x:t>topo</x:t></x:r></x:p></x:hdr>")
    return out.getvalue()


def make_pdf(text=b"(Ol\\341 \\(x\\)) Tj T* [(a) -300 (b)] TJ", compress=True, rotate=90):
    body = b"BT /F1 12 Tf " + text + b" ET"
    packed = zlib.compress(body) if compress else body
    name = b" /Filter /FlateDecode" if compress else b""
    return b"".join([
        b"%PDF-1.7\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n",
        b"2 0 obj << /Type /Pages /Kids [3 0 R 3 0 R] /Count 1 /MediaBox [0 0 600 800] /Rotate " + str(rotate).encode() + b" >> endobj\n",
        b"3 0 obj << /Type /Page /Parent 2 0 R /CropBox [100 0 900 800] /Contents 4 0 R >> endobj\n",
        b"4 0 obj << /Length 5 0 R" + name + b" >> stream\n" + packed + b"\nendstream endobj\n5 0 obj " + str(len(packed)).encode() + b" endobj\n",
        b"trailer << /Root 1 0 R >>\n%%EOF\n",
    ])


def test_markup():
    root = markup.parse('<?xml version="1.0"?><!-- c --><a xmlns="u" xmlns:q="v"><b q:k="1&amp;2">x<![CDATA[<y>]]>&nbsp; &#0;&#xD800;&#65;</b><q:c/></a>', {"p": "u", "z": ["v"]})
    assert (root.name, root.all()[0].attrs, root.text) == ("p:a", {"z:k": "1&2"}, "x<y>&nbsp; ��A")
    assert root.find("z:c") is not None
    for bad in ("<!DOCTYPE a><a/>", "<a>", "<a></b>", "</a>", "", "text", "<a" + "><a" * 300 + ">", "<a b></a>"):
        with pytest.raises(markup.MarkupError):
            markup.parse(bad)


def test_packages(spark):
    good = docx('<x:p><x:pPr><x:pStyle x:val="T1"/></x:pPr><x:r><x:t>um</x:t><x:tab/><x:t>dois</x:t></x:r></x:p><x:tbl><x:tr><x:tc><x:p><x:r><x:t>c</x:t></x:r></x:p></x:tc></x:tr></x:tbl>', h="header1.xml")
    files = spark.createDataFrame([("a", bytearray(good)), ("b", bytearray(b"no zip")), ("c", None), ("d", bytearray(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"))], "path string, content binary")
    rows = packages.docx_blocks(files).collect()
    assert [(r.place, r.kind, r.style, r.text) for r in rows if r.path == "a"] == [("body", "paragraph", "T1", "um\tdois"), ("body", "cell:0:0", None, "c"), ("header", "paragraph", None, "topo")]
    assert {r.path for r in rows if r.error} == {"b", "c", "d"}
    entries = packages.zip_entries(files.where("path = 'a'")).collect()
    assert [e.name for e in entries] == ["word/document.xml", "word/_rels/document.xml.rels", "word/header1.xml"]
    with pytest.raises(packages.PackageError, match="too big"):
        packages.open_zip(good, most_entry=10)
    with pytest.raises(packages.PackageError, match="too big"):
        packages.inflate(zlib.compress(b"a" * 1000), 999, raw=False)
    assert packages.decode_text("ã".encode("utf-16")) == "ã"


def test_pages(spark):
    files = spark.createDataFrame([("a", bytearray(make_pdf())), ("b", bytearray(b"%PDF-1.4 nothing")), ("c", bytearray(make_pdf(compress=False, rotate=0)))], "path string, content binary")
    rows = {(r.path, r.page_no): r for r in pdf.pdf_pages(files).collect()}
    a = rows["a", 0]
    assert (a.width, a.height, a.rotation, a.text) == (800.0, 500.0, 90, "Olá (x)\na b")
    assert (rows["c", 0].width, rows["c", 0].text) == (500.0, "Olá (x)\na b")
    assert rows["b", None].error == "no catalog" and len(rows) == 3
    kinds = {r.num: r.kind for r in pdf.pdf_objects(files).where("path = 'a'").collect()}
    assert kinds == {1: "dict", 2: "dict", 3: "dict", 4: "stream", 5: "int"}


def test_newest_revision_and_packed_objects():
    newer = make_pdf() + b"3 0 obj << /Type /Page /Parent 2 0 R /MediaBox [0 0 50 60] >> endobj\n"
    assert [p["height"] for p in pdf.Pdf(newer).pages()] == [50.0]
    inner = b"7 0 8 3 [1] << /A (b) >>"
    packed = make_pdf() + b"9 0 obj << /Type /ObjStm /N 2 /First 8 /Length " + str(len(inner)).encode() + b" >> stream\n" + inner + b"\nendstream endobj\n"
    assert pdf.Pdf(packed).get(pdf.Ref(8)) == {"A": b"b"}


def test_row_predictors():
    rng = random.Random(1)
    rows = [[rng.randrange(256) for _ in range(12)] for _ in range(5)]
    coded, before = b"", [0] * 12
    for kind, row in enumerate(rows):
        line = []
        for i, x in enumerate(row):
            a, b, c = (row[i - 3] if i >= 3 else 0), before[i], (before[i - 3] if i >= 3 else 0)
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            line.append((x - [0, a, b, (a + b) // 2, paeth][kind]) % 256)
        coded += bytes([kind, *line])
        before = row
    assert pdf.unpredict(coded, {"Predictor": 15, "Colors": 3, "Columns": 4}) == bytes(x for r in rows for x in r)


@pytest.mark.parametrize("make", [make_pdf, lambda: docx("<x:p/>")])
def test_damaged_files_are_refused_or_read(make):
    whole, outcomes = make(), {"ok": 0, "refused": 0}
    for seed in range(300):
        rng = random.Random(seed)
        data = bytearray(whole)
        for _ in range(rng.randrange(1, 12)):
            at = rng.randrange(len(data))
            if rng.random() < 0.5:
                data[at] = rng.randrange(256)
            else:
                del data[at : at + rng.randrange(1, 40)]
        try:
            (pdf._pages if make is make_pdf else packages.read_docx)(bytes(data))
            outcomes["ok"] += 1
        except (packages.PackageError, markup.MarkupError):
            outcomes["refused"] += 1
    assert min(outcomes.values()) > 3


def test_tokens_of_contents():
    """Plain tokens are read by one pattern, all others by the reader; both see the same strings."""
    shown = [r"BT (plain) Tj ET", r"BT (a\(b\)\101) Tj ET", r"BT [(no) -300 (w)] TJ ET", r"BT <414243> Tj T* (next) ' ET", "BT (in (side)) Tj % (gone) Tj\n ET", r"BT (last) 1 0 R Tj ET", r"BT (true) true Tj ET", r"BT /F#31 1.5 Tf -.5 +7 Td(tight)Tj ET"]
    body = "\n".join(shown).encode()
    data = b"%%PDF-1.7\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n2 0 obj\n<< /Kids [3 0 R] >>\nendobj\n3 0 obj\n<< /Contents 4 0 R >>\nendobj\n4 0 obj\n<< /Length %d >>\nstream\n%b\nendstream\nendobj\ntrailer\n<< /Root 1 0 R >>" % (len(body), body)
    doc = pdf.Pdf(data)
    assert doc.text(doc.pages()[0]).split("\n") == ["plain", "a(b)A", "no w", "ABC", "next", "in (side)", "tight"]


def test_lines_to_write_cross_no_network(spark, tmp_path):
    """Lines of documents are made inside their rows; before, each word of them was shuffled."""
    from pagelathe.plans import files

    spark.createDataFrame([(1, " ".join(str(k) for k in range(20))), (2, " \n"), (3, None)], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    made = files._lines(spark, str(tmp_path))
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    assert [(r.doc_id, r.item_no, r.text) for r in made.orderBy("item_no").collect()] == [(1, 0, "0 1 2 3 4 5 6 7"), (1, 1, "8 9 10 11 12 13 14 15"), (1, 2, "16 17 18 19")]
