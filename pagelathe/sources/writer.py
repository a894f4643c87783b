"""Page-description files written from laid out texts: one file a document, built a document at a time in tasks."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _number(x: float) -> str:
    return f"{x:.2f}".rstrip("0").rstrip(".")


#: Bytes that a literal string writes in another way.
_WRITTEN = {b: f"\\{chr(b)}" if b in b"()\\" else f"\\{b:03o}" for b in range(256) if b in b"()\\" or not 0x20 <= b <= 0x7E}


def _string(text: str) -> str:
    """A literal string in ASCII; what the standard fonts' code lacks becomes a question mark."""
    return f"({text.encode('cp1252', 'replace').decode('latin-1').translate(_WRITTEN)})"


def page_content(items: list[tuple], height: float, fonts: dict[str, str]) -> bytes:
    """Drawing of texts (x, y from the top, text, font, size)."""
    return "\n".join(f"BT {fonts[font]} {_number(size)} Tf {_number(x)} {_number(height - y)} Td {_string(text)} Tj ET" for x, y, text, font, size in items).encode("ascii")


def write_file(pages: list[list[tuple]], width: float, height: float) -> bytes:
    """A file of pages of texts. Objects: 1 catalogue, 2 page tree, then fonts, then a page and its content in turn."""
    names = sorted({item[3] for page in pages for item in page})
    fonts = {name: f"/F{k + 1}" for k, name in enumerate(names)}
    first = 3 + len(names)
    kids = " ".join(f"{first + 2 * k} 0 R" for k in range(len(pages)))
    bodies = ["<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{kids}] /Count {len(pages)} /MediaBox [0 0 {_number(width)} {_number(height)}] >>"]
    bodies += [f"<< /Type /Font /Subtype /Type1 /BaseFont /{name} /Encoding /WinAnsiEncoding >>" for name in names]
    used = " ".join(f"{fonts[name]} {3 + k} 0 R" for k, name in enumerate(names))
    out = [body.encode("ascii") for body in bodies]
    for k, page in enumerate(pages):
        packed = zlib.compress(page_content(page, height, fonts))
        out.append(f"<< /Type /Page /Parent 2 0 R /Resources << /Font << {used} >> >> /Contents {first + 2 * k + 1} 0 R >>".encode("ascii"))
        out.append(b"<< /Length %d /Filter /FlateDecode >>\nstream\n%b\nendstream" % (len(packed), packed))
    parts, at, offsets = [b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"], 15, []
    for k, body in enumerate(out):
        offsets.append(at)
        parts.append(b"%d 0 obj\n%b\nendobj\n" % (k + 1, body))
        at += len(parts[-1])
    table = b"".join(b"%010d 00000 n \n" % x for x in offsets)
    parts.append(b"xref\n0 %d\n0000000000 65535 f \n%btrailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(out) + 1, table, len(out) + 1, at))
    return b"".join(parts)


def write_files(items: DataFrame, width: float, height: float) -> DataFrame:
    """items (doc_id, page_no, item_no, x, y, text, font, size) -> path, content: one shuffle, a file is held at a time."""
    columns = ["page_no", "x", "y", "text", "font", "size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((doc, row) for b in batches for doc, row in zip(b.column(0).to_pylist(), zip(*(b.column(c).to_pylist() for c in columns), strict=True), strict=True))
        for doc, listed in groupby(rows, itemgetter(0)):
            pages = [[item[1:] for item in page] for _, page in groupby((r for _, r in listed), itemgetter(0))]
            yield pa.RecordBatch.from_arrays([pa.array([str(doc)]), pa.array([write_file(pages, width, height)], pa.binary())], names=["path", "content"])

    dealt = items.select(F.col("doc_id").cast("bigint").alias("doc_id"), *columns, "item_no").repartition("doc_id").sortWithinPartitions("doc_id", "page_no", "item_no").drop("item_no")
    return dealt.mapInArrow(run, "path string, content binary")
