"""Page-description files: objects, page tree, text of pages, as tables.

One forward scan finds every `n g obj`; the last one of a number wins, which is
the newest revision of files written by appending. Object streams are unpacked
afterwards. Streams are read by their own end mark when the length is wrong.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from .packages import PackageError, _each, inflate

MOST_STREAM, MOST_DEPTH, MOST_PAGES = 100 << 20, 100, 10_000
A4 = (0.0, 0.0, 595.28, 841.89)
_OBJECT = re.compile(rb"(?<![0-9])(\d{1,10})[\x00\t\n\f\r ]+(\d{1,5})[\x00\t\n\f\r ]+obj\b")
_SPACE = re.compile(rb"(?:[\x00\t\n\f\r ]+|%[^\r\n]*)*")
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)")
_WORD = re.compile(rb"[^\x00\t\n\f\r ()<>\[\]{}/%]+")
_REFERENCE = re.compile(rb"(\d{1,10})[\x00\t\n\f\r ]+(\d{1,5})[\x00\t\n\f\r ]+R(?![A-Za-z0-9])")
#: Tokens of contents that need no reader: a plain string; a reference or number; a name; a word.
_TOKEN = re.compile(rb"[\x00\t\n\f\r ]*(?:\(([^\\()]*)\)|(\d{1,10}[\x00\t\n\f\r ]+\d{1,5}[\x00\t\n\f\r ]+R(?![A-Za-z0-9])|[+-]?(?:\d+\.?\d*|\.\d+))|(/[^\x00\t\n\f\r ()<>\[\]{}/%]*)|([^\x00\t\n\f\r ()<>\[\]{}/%]+))")
_CONSTANTS = {b"true": True, b"false": False, b"null": None}
_PLAIN, _OCTAL = re.compile(rb"[^\\()]+"), re.compile(rb"[0-7]{1,3}")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Name(str):
    pass


@dataclass(frozen=True)
class Ref:
    num: int


@dataclass
class Stream:
    entries: dict
    raw: bytes


class Values:
    """Reads values from bytes, one after another."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def skip(self) -> None:
        self.at = _SPACE.match(self.data, self.at).end()

    def value(self, depth: int = 0):
        if depth > MOST_DEPTH:
            raise PackageError("nested too deeply")
        self.skip()
        data, at = self.data, self.at
        head = data[at : at + 1]
        if data.startswith(b"<<", at):
            return self._entries(depth)
        if head == b"<":
            end = data.find(b">", at)
            if end < 0:
                raise PackageError("damaged string")
            self.at = end + 1
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", data[at + 1 : end])
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if head == b"(":
            return self._literal()
        if head == b"[":
            self.at += 1
            out = []
            while True:
                self.skip()
                if self.data[self.at : self.at + 1] == b"]":
                    self.at += 1
                    return out
                if self.at >= len(data):
                    raise PackageError("damaged list")
                out.append(self.value(depth + 1))
        if head == b"/":
            m = _WORD.match(data, at + 1)
            self.at = m.end() if m else at + 1
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), m[0] if m else b"").decode("latin-1"))
        if m := _REFERENCE.match(data, at):
            self.at = m.end()
            return Ref(int(m[1]))
        if m := _NUMBER.match(data, at):
            self.at = m.end()
            return float(m[0]) if b"." in m[0] else int(m[0])
        if m := _WORD.match(data, at):
            self.at = m.end()
            return _CONSTANTS.get(m[0], m[0])
        raise PackageError("damaged value")

    def _entries(self, depth: int) -> dict:
        self.at += 2
        out = {}
        while True:
            self.skip()
            if self.data.startswith(b">>", self.at):
                self.at += 2
                return out
            key = self.value(depth + 1)
            if not isinstance(key, Name):
                raise PackageError("damaged dictionary")
            out[key] = self.value(depth + 1)

    def _literal(self) -> bytes:
        data, i, level, out = self.data, self.at + 1, 1, bytearray()
        while i < len(data):
            if m := _PLAIN.match(data, i):
                out += m[0]
                i = m.end()
                continue
            c = data[i : i + 1]
            if c == b"\\":
                nxt = data[i + 1 : i + 2]
                if m := _OCTAL.match(data, i + 1):
                    out.append(int(m[0], 8) & 255)
                    i = m.end()
                    continue
                if nxt in (b"\r", b"\n"):
                    i += 3 if data[i + 1 : i + 3] == b"\r\n" else 2
                    continue
                out += _ESCAPES.get(nxt, nxt)
                i += 2
                continue
            level += (c == b"(") - (c == b")")
            i += 1
            if not level:
                self.at = i
                return bytes(out)
            out += c
        raise PackageError("damaged string")


class Pdf:
    def __init__(self, data: bytes):
        if b"%PDF-" not in data[:1024]:
            raise PackageError("no such file")
        self.data, self.where, self.packed, self.cache = data, {}, {}, {}
        trailers = []
        for m in _OBJECT.finditer(data):
            self.where[int(m[1])] = m.end()
        for m in re.finditer(rb"\btrailer\b", data):
            try:
                trailers.append(Values(data, m.end()).value())
            except PackageError:
                continue
        for num in sorted(self.where, key=self.where.__getitem__):
            found = self.get(Ref(num))
            if isinstance(found, Stream) and found.entries.get("Type") == "ObjStm":
                self._unpack(found, self.where[num])
            elif isinstance(found, Stream) and found.entries.get("Type") == "XRef":
                trailers.append(found.entries)
        if any("Encrypt" in t for t in trailers if isinstance(t, dict)):
            raise PackageError("encrypted")
        roots = [t["Root"] for t in trailers if isinstance(t, dict) and "Root" in t]
        self.catalog = self.get(roots[-1]) if roots else None
        if not isinstance(self.catalog, dict):
            self.catalog = next((v for n in [*self.where, *self.packed] if isinstance(v := self.get(Ref(n)), dict) and v.get("Type") == "Catalog"), None)
        if not isinstance(self.catalog, dict):
            raise PackageError("no catalog")

    def _unpack(self, stream: Stream, place: int) -> None:
        try:
            body = self.content(stream)
            first, n = int(self.get(stream.entries["First"])), int(self.get(stream.entries["N"]))
            pairs = Values(body)
            for num, at in [(pairs.value(), pairs.value()) for _ in range(n)]:
                # the later of a plain and a packed object counts
                if num not in self.where or self.where[num] < place:
                    self.packed[num] = (body, first + at)
                    self.cache.pop(num, None)
        except (KeyError, TypeError, PackageError):
            return

    def get(self, value):
        """The value that references lead to."""
        for _ in range(32):
            if not isinstance(value, Ref):
                return value
            if value.num not in self.cache:
                self.cache[value.num] = None
                try:
                    self.cache[value.num] = self._read(value.num)
                except PackageError:
                    pass
            value = self.cache[value.num]
        return None

    def _read(self, num: int):
        if num in self.packed:
            return Values(*self.packed[num]).value()
        if num not in self.where:
            return None
        values = Values(self.data, self.where[num])
        found = values.value()
        values.skip()
        if isinstance(found, dict) and self.data.startswith(b"stream", values.at):
            start = values.at + 6
            start += 2 if self.data.startswith(b"\r\n", start) else 1
            length = self.get(found.get("Length"))
            end = start + length if isinstance(length, int) and length >= 0 else -1
            if end < 0 or not re.compile(rb"\s*endstream").match(self.data, end):
                end = self.data.find(b"endstream", start)
                if end < 0:
                    raise PackageError("damaged stream")
            return Stream(found, self.data[start:end])
        return found

    def content(self, stream: Stream) -> bytes:
        data = stream.raw
        filters = self.get(stream.entries.get("Filter")) or []
        params = self.get(stream.entries.get("DecodeParms")) or {}
        for f in filters if isinstance(filters, list) else [filters]:
            if self.get(f) not in ("FlateDecode", "Fl"):
                raise PackageError("unknown filter")
            data = inflate(data, MOST_STREAM, raw=False, lenient=True)
        p = self.get(params[0] if isinstance(params, list) and params else params)
        return unpredict(data, p) if isinstance(p, dict) else data

    def pages(self) -> list[dict]:
        """Pages in order with what they inherit; boxes clipped, sides swapped when turned."""
        out, seen = [], set()

        def walk(ref, inherited: dict, depth: int) -> None:
            key = ref.num if isinstance(ref, Ref) else id(ref)
            node = self.get(ref)
            if not isinstance(node, dict) or key in seen:
                return
            if depth > MOST_DEPTH or len(out) >= MOST_PAGES:
                raise PackageError("too many pages")
            seen.add(key)
            passed = inherited | {k: node[k] for k in ("Resources", "MediaBox", "CropBox", "Rotate") if k in node}
            kids = self.get(node.get("Kids"))
            if isinstance(kids, list):
                for kid in kids:
                    walk(kid, passed, depth + 1)
            else:
                out.append(passed | {"Contents": node.get("Contents")})

        walk(self.catalog.get("Pages"), {}, 0)
        return [self._page(p) for p in out]

    def box(self, value) -> tuple | None:
        got = self.get(value)
        if not isinstance(got, list) or len(got) != 4 or not all(isinstance(x := self.get(v), (int, float)) for v in got):
            return None
        x0, y0, x1, y1 = (float(self.get(v)) for v in got)
        made = min(x0, x1), min(y0, y1), max(x0, x1), max(y0, y1)
        return made if made[2] > made[0] and made[3] > made[1] else None

    def _page(self, page: dict) -> dict:
        media = self.box(page.get("MediaBox")) or A4
        crop = self.box(page.get("CropBox")) or media
        clip = max(crop[0], media[0]), max(crop[1], media[1]), min(crop[2], media[2]), min(crop[3], media[3])
        x0, y0, x1, y1 = clip if clip[2] > clip[0] and clip[3] > clip[1] else media
        turn = self.get(page.get("Rotate"))
        turn = round((turn if isinstance(turn, (int, float)) else 0) / 90) * 90 % 360
        sides = (x1 - x0, y1 - y0) if turn % 180 == 0 else (y1 - y0, x1 - x0)
        return page | {"rotation": turn, "width": sides[0], "height": sides[1]}

    def text(self, page: dict) -> str:
        """Strings that the page's contents show, one line for each text object or line move. One-byte codes only."""
        parts = self.get(page.get("Contents"))
        body = b"\n".join(self.content(s) for s in (self.get(p) for p in (parts if isinstance(parts, list) else [parts])) if isinstance(s, Stream))
        values, stack, lines, line = Values(body), [], [], []
        while True:
            if m := _TOKEN.match(body, values.at):
                values.at = m.end()
                token = m[m.lastindex]
                # names, numbers and references only separate what is shown
                if m.lastindex < 4 or token in _CONSTANTS:
                    stack.append(token if m.lastindex == 1 else None)
                    continue
            else:
                values.skip()
                if values.at >= len(body):
                    break
                try:
                    token = values.value()
                except PackageError:
                    values.at += 1
                    continue
                if not isinstance(token, bytes) or body[values.at - 1 : values.at] in (b")", b">"):
                    stack.append(token)
                    continue
            if token in (b"Td", b"TD", b"T*", b"Tm", b"ET", b"'", b'"') and line:
                lines.append("".join(line))
                line = []
            if token in (b"Tj", b"'", b'"') and stack and isinstance(stack[-1], bytes):
                line.append(stack[-1].decode("cp1252", "replace"))
            elif token == b"TJ" and stack and isinstance(stack[-1], list):
                line += [x.decode("cp1252", "replace") if isinstance(x, bytes) else " " * (isinstance(x, (int, float)) and x < -200) for x in stack[-1]]
            stack.clear()
        return "\n".join([*lines, *(["".join(line)] if line else [])])


def unpredict(data: bytes, params: dict) -> bytes:
    """Undoes the predictors of rows (10 to 15); others are left as they are."""
    if not isinstance(params.get("Predictor"), int) or params["Predictor"] < 10:
        return data
    colors, bits, columns = (params.get(k, d) for k, d in (("Colors", 1), ("BitsPerComponent", 8), ("Columns", 1)))
    step, width = max(1, colors * bits // 8), (colors * bits * columns + 7) // 8
    rows = np.frombuffer(data, np.uint8)[: len(data) // (width + 1) * (width + 1)].reshape(-1, width + 1)
    out = np.zeros((len(rows), -(-width // step) * step), np.uint8)
    before = np.zeros(out.shape[1], np.uint8)
    for row, done in zip(rows, out, strict=True):
        kind = row[0]
        done[:width] = row[1:]
        if kind == 1:
            done[:] = np.cumsum(done.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)
        elif kind == 2:
            done += before
        elif kind in (3, 4):
            _along(done.reshape(-1, step), before.reshape(-1, step).astype(np.int64), kind == 4)
        before = done
    return out[:, :width].tobytes()


def _along(row: np.ndarray, above: np.ndarray, paeth: bool) -> None:
    """A row whose pixels depend on the one to the left, all channels of a pixel together."""
    left = np.zeros(row.shape[1], np.int64)
    corner = left
    for pixel, up in zip(row, above, strict=True):
        if paeth:
            guess = left + up - corner
            far = [abs(guess - x) for x in (left, up, corner)]
            guess = np.where((far[0] <= far[1]) & (far[0] <= far[2]), left, np.where(far[1] <= far[2], up, corner))
        else:
            guess = (left + up) // 2
        pixel += guess.astype(np.uint8)
        left, corner = pixel.astype(np.int64), up


def _pages(data: bytes) -> list[tuple]:
    doc = Pdf(data)
    return [(p["width"], p["height"], p["rotation"], doc.text(p)) for p in doc.pages()]


def _objects(data: bytes) -> list[tuple]:
    doc = Pdf(data)
    out = []
    for num in sorted({*doc.where, *doc.packed}):
        found = doc.get(Ref(num))
        entries = found.entries if isinstance(found, Stream) else found if isinstance(found, dict) else {}
        out.append((num, type(found).__name__.lower(), str(entries.get("Type") or "") or None, len(found.raw) if isinstance(found, Stream) else None))
    return out


def pdf_pages(files: DataFrame) -> DataFrame:
    return _each(files, _pages, "path string, page_no int, width double, height double, rotation int, text string, error string")


def pdf_objects(files: DataFrame) -> DataFrame:
    return _each(files, _objects, "path string, object_no int, num bigint, kind string, type string, stream_bytes bigint, error string")
