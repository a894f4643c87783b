"""ZIP packages and word-processor documents as tables.

Limits hold for what is really unpacked. A file that is refused gives a row with
its error and no others stop.
"""

from __future__ import annotations

import io
import posixpath
import struct
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame

from .markup import MarkupError, Node, parse

MOST_ENTRY, MOST_TOTAL, MOST_ENTRIES = 100 << 20, 300 << 20, 10_000
_OLE = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
_W = {"w": ["http://schemas.openxmlformats.org/wordprocessingml/2006/main", "http://purl.oclc.org/ooxml/wordprocessingml/main"], "r": ["http://schemas.openxmlformats.org/officeDocument/2006/relationships", "http://purl.oclc.org/ooxml/officeDocument/relationships"]}


class PackageError(ValueError):
    pass


def decode_text(data: bytes) -> str:
    """Text by its byte-order mark, else UTF-8."""
    for mark, name in ((b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"), (b"\xef\xbb\xbf", "utf-8")):
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "replace")
    return data.decode("utf-8", "replace")


#: Bytes that are unpacked at a time.
PIECE = 256


def inflate(data: bytes, limit: int, raw: bool = True, lenient: bool = False) -> bytes:
    """Unpacked data; an error as soon as it passes the limit. Lenient: what was readable of damaged data."""
    engine, parts, size = zlib.decompressobj(-15 if raw else 15), [], 0
    try:
        # in pieces, so that what came before the damage is kept
        for at in range(0, len(data), PIECE):
            parts.append(engine.decompress(data[at : at + PIECE], limit + 1 - size))
            size += len(parts[-1])
            if size > limit:
                break
    except zlib.error as e:
        if not lenient:
            raise PackageError("damaged data") from e
    out = b"".join(parts)
    if len(out) > limit:
        raise PackageError("too big")
    if not engine.eof and not lenient:
        raise PackageError("damaged data")
    return out


def open_zip(data: bytes, most_entry: int = MOST_ENTRY, most_total: int = MOST_TOTAL) -> dict[str, bytes]:
    """The entries of a package; encrypted, unknown or damaged ones refuse it."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            listed = z.infolist()
            if len(listed) > MOST_ENTRIES:
                raise PackageError("too many entries")
            out, total = {}, 0
            for e in listed:
                if e.flag_bits & 1:
                    raise PackageError("encrypted")
                if e.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
                    raise PackageError("unknown method")
                with z.open(e) as part:
                    got = part.read(most_entry + 1)
                total += len(got)
                if len(got) > most_entry or total > most_total:
                    raise PackageError("too big")
                if len(got) != e.file_size:
                    raise PackageError("sizes differ")
                out[e.filename] = got
            return out
    except PackageError:
        raise
    except (zipfile.BadZipFile, NotImplementedError, RuntimeError, ValueError, OSError, struct.error, zlib.error, EOFError) as e:
        raise PackageError("damaged package") from e


def relations(entries: dict[str, bytes], part: str) -> dict[str, str]:
    """Relation id -> part; external targets are left out."""
    folder, name = posixpath.split(part)
    source = entries.get(posixpath.join(folder, "_rels", f"{name}.rels"))
    if source is None:
        return {}
    out = {}
    for r in parse(decode_text(source)).all():
        if r.attrs.get("TargetMode") != "External" and "Id" in r.attrs:
            target = unquote(r.attrs.get("Target", ""))
            out[r.attrs["Id"]] = posixpath.normpath(target.lstrip("/") if target.startswith("/") else posixpath.join(folder, target))
    return out


def run_text(node: Node) -> str:
    """Text of a paragraph or run; tabs and breaks as characters, deleted text left out."""
    out = []
    for c in node.all():
        if c.name == "w:t":
            out.append(c.text)
        elif c.name == "w:tab":
            out.append("\t")
        elif c.name in ("w:br", "w:cr"):
            out.append("\n")
        elif c.name not in ("w:del", "w:pPr", "w:rPr", "w:instrText", "w:delText"):
            out.append(run_text(c))
    return "".join(out)


def blocks(body: Node, place: str) -> Iterator[tuple]:
    """(place, kind, style, level, text) of paragraphs, cells in order."""
    for c in body.all():
        if c.name == "w:p":
            props = c.first("w:pPr")
            style = props.first("w:pStyle") if props else None
            number = props.find("w:ilvl") if props else None
            yield place, "paragraph", style.attrs.get("w:val") if style else None, int(number.attrs.get("w:val", 0)) if number else None, run_text(c)
        elif c.name == "w:tbl":
            for r, row in enumerate(c.all("w:tr")):
                for k, cell in enumerate(row.all("w:tc")):
                    for _, kind, style, level, text in blocks(cell, place):
                        yield place, f"cell:{r}:{k}" if kind == "paragraph" else kind, style, level, text
        elif c.name in ("w:sdt", "w:sdtContent", "w:ins", "w:customXml"):
            yield from blocks(c, place)


def read_docx(data: bytes) -> list[tuple]:
    """Blocks of a document: body, then headers, footers and notes in the order of their parts."""
    if data.startswith(_OLE):
        raise PackageError("an old or protected document")
    entries = open_zip(data)
    main = next((p for p in relations(entries, "").values() if p.endswith("document.xml")), "word/document.xml")
    if main not in entries:
        raise PackageError("no document part")
    body = parse(decode_text(entries[main]), _W).first("w:body")
    if body is None:
        raise PackageError("no body")
    out = list(blocks(body, "body"))
    for part in sorted(set(relations(entries, main).values())):
        kind = posixpath.basename(part).rstrip("0123456789.xml") or "part"
        if part in entries and kind in ("header", "footer", "footnotes", "endnotes"):
            root = parse(decode_text(entries[part]), _W)
            for holder in [root] if kind in ("header", "footer") else root.all():
                out += list(blocks(holder, kind))
    return out


def _each(files: DataFrame, read, schema: str) -> DataFrame:
    """files (path, content) -> rows of read(content), or one row with the error."""
    names = [f.split()[0] for f in schema.split(", ")]

    def batch(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows += [(path, i, *r, None) for i, r in enumerate(read(bytes(content) if content is not None else b""))]
                except (PackageError, MarkupError) as e:
                    rows.append((path, None, *[None] * (len(names) - 3), str(e)))
            yield pd.DataFrame(rows, columns=names).astype(object)

    return files.select("path", "content").mapInPandas(batch, schema)


def zip_entries(files: DataFrame) -> DataFrame:
    return _each(files, lambda data: [(name, len(body), zlib.crc32(body)) for name, body in open_zip(data).items()], "path string, entry_no int, name string, size bigint, crc32 bigint, error string")


def docx_blocks(files: DataFrame) -> DataFrame:
    return _each(files, read_docx, "path string, block_no int, place string, kind string, style string, level int, text string, error string")
