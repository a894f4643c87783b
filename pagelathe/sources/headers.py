"""Sizes of photos from their headers, without decoding them."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .packages import PackageError, _each

#: Markers that stand alone, and those in the range of frame headers that are none.
_ALONE = {0x01, *range(0xD0, 0xD9)}
_NO_FRAME = {0xC4, 0xC8, 0xCC}


def photo_head(data: bytes) -> tuple[int, int, int]:
    """Width, height and number of components by the first frame header."""
    if not data.startswith(b"\xff\xd8"):
        raise PackageError("no photo")
    at = 2
    while (at := data.find(b"\xff", at)) >= 0 and at + 9 < len(data):
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
        elif marker in _ALONE:
            at += 2
        elif 0xC0 <= marker <= 0xCF and marker not in _NO_FRAME:
            return int.from_bytes(data[at + 7 : at + 9]), int.from_bytes(data[at + 5 : at + 7]), data[at + 9]
        else:
            at += 2 + int.from_bytes(data[at + 2 : at + 4])
    raise PackageError("no frame header")


def photo_heads(files: DataFrame) -> DataFrame:
    """files (path, content) -> path, width, height, components, error."""
    return _each(files, lambda data: [photo_head(data)], "path string, head_no int, width int, height int, components int, error string")
