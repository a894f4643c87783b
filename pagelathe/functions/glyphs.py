"""Text for the standard fonts: their one-byte code, stand-ins for what it lacks, font choice and widths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters of the code between 0x80 and 0x9F, in the order of their bytes (None: no character).
HIGH = [
    "€", None, "‚", "ƒ", "„", "…", "†", "‡", "ˆ", "‰", "Š", "‹", "Œ", None, "Ž", None,
    None, "‘", "’", "“", "”", "•", "–", "—", "˜", "™", "š", "›", "œ", None, "ž", "Ÿ",
]
# Stand-ins.
GONE = "­​‌‍⁠﻿"
BLANKS = "             　  "
LIKE = {"‐": "-", "‑": "-", "‒": "-", "−": "-", "―": "—", "′": "'", "″": '"', "⁄": "/", "∕": "/", "≤": "<=", "≥": ">=", "→": "->", "←": "<-", "◦": "o", "○": "o"}
BULLETS = "‣⁃∙▪■●◆►▶➢❖"
FAMILIES = {
    "sans": ["Helvetica", "Helvetica-Bold", "Helvetica-Oblique", "Helvetica-BoldOblique"],
    "serif": ["Times-Roman", "Times-Bold", "Times-Italic", "Times-BoldItalic"],
    "mono": ["Courier", "Courier-Bold", "Courier-Oblique", "Courier-BoldOblique"],
}
FIXED_WIDTH = 600

_COMMON, _RARE = "\\x20-\\x7e\\xa0-\\xff", "".join(c for c in HIGH if c)
#: A character that the code lacks; the common ones are told by two ranges, the others by a list.
OUTSIDE = f"(?![{_COMMON}])[^{_RARE}]"
#: Dropped without a word by the reports: control characters and marks of no width.
SILENT = "[\\x00-\\x1f\\x7f-\\x9f\\u200b-\\u200f\\ufe00-\\ufe0f]"
CONTROL = "[\\x00-\\x1f\\x7f-\\x9f\\ufe00-\\ufe0f]"
SYMBOL = "[\\uf000-\\uf0ff]"


def composed(text: Column) -> Column:
    """Latin letters followed by a combining mark become one letter."""
    return F.when(text.rlike(r"\p{M}"), _compose(text)).otherwise(text)


def _marks() -> dict[str, str]:
    """Letter and mark -> letter, of all letters of the code, by the rule of Unicode."""
    import unicodedata

    letters = [chr(c) for c in range(0xC0, 0x180)]
    return {d: c for c in letters if len(d := unicodedata.normalize("NFD", c)) == 2}


def _compose(text: Column) -> Column:
    """Only pairs that the text holds are looked for; none of them makes or breaks another."""
    letters = F.create_map(*[F.lit(x) for pair in _marks().items() for x in pair])
    pairs = F.array_distinct(F.regexp_extract_all(text, F.lit(r"[A-Za-z]\p{M}"), F.lit(0)))
    return F.aggregate(pairs, text, lambda t, pair: F.coalesce(F.replace(t, pair, F.try_element_at(letters, pair)), t))


def byte_code(character: Column) -> Column:
    """The byte of a character in the standard fonts' code; null if it has none."""
    at = F.ascii(character)
    high = F.create_map(*[F.lit(x) for k, c in enumerate(HIGH) if c for x in (c, 128 + k)])
    return F.when((character != "") & (at.between(0x20, 0x7E) | at.between(0xA0, 0xFF)), at).otherwise(F.element_at(high, character))


def _stood_in(text: Column) -> Column:
    plain = F.regexp_replace(text, f"[{GONE}]", "")
    one = {**{c: " " for c in BLANKS}, **{k: v for k, v in LIKE.items() if len(v) == 1}, **{c: "•" for c in BULLETS}}
    plain = F.translate(plain, "".join(one), "".join(one.values()))
    for k, v in LIKE.items():
        if len(v) > 1:
            plain = F.replace(plain, F.lit(k), F.lit(v))
    return F.regexp_replace(F.regexp_replace(plain, CONTROL, ""), SYMBOL, "•")


def sanitized(text: Column, fallback: str = "?") -> Column:
    """Text of the code's characters only: stand-ins where there are some, else the fallback."""
    return F.regexp_replace(_stood_in(composed(text)), OUTSIDE, fallback)


def missing(text: Column) -> Column:
    """The distinct characters that sanitized() replaced by the fallback, in text order."""
    return F.array_distinct(F.regexp_extract_all(_stood_in(composed(text)), F.lit(OUTSIDE), F.lit(0)))


def filtered(text: Column) -> Column:
    """struct<text, dropped>: line breaks stay, tabs become blanks, what the code lacks is left out and listed once."""
    plain = F.replace(F.regexp_replace(composed(text), "\r\n?", "\n"), F.lit("\t"), F.lit(" "))
    left = F.regexp_replace(plain, f"(?![\\n{_COMMON}])[^{_RARE}]", "")
    told = F.regexp_replace(F.regexp_replace(plain, SILENT, ""), "\n", "")
    return F.struct(left.alias("text"), F.array_distinct(F.regexp_extract_all(told, F.lit(OUTSIDE), F.lit(0))).alias("dropped"))


def font_name(family: Column, bold: Column, italic: Column) -> Column:
    """The standard font of a family, the first family for any other."""
    table = F.create_map(*[x for k, v in FAMILIES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    names = F.coalesce(F.try_element_at(table, family), F.array(*map(F.lit, FAMILIES["sans"])))
    return F.get(names, bold.cast("int") + 2 * italic.cast("int"))


def advances(text: Column, font: Column, size: Column, widths: Column | None = None, word_spacing: Column | None = None) -> Column:
    """The width of each character in points.

    widths: map of font -> array of thousandths by code from 32 on, as the fonts'
    metrics list them; fonts without one count as of fixed width.
    """
    table = F.try_element_at(widths, font) if widths is not None else F.lit(None).cast("array<int>")
    spacing = word_spacing if word_spacing is not None else F.lit(0.0)
    wide = lambda c: F.when(table.isNull(), FIXED_WIDTH).otherwise(F.coalesce(F.get(table, byte_code(c) - 32), F.lit(0)))
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: wide(c) * size / 1000 + F.when(c == " ", spacing).otherwise(0.0))


def text_width(text: Column, font: Column, size: Column, widths: Column | None = None) -> Column:
    return F.aggregate(advances(text, font, size, widths), F.lit(0.0), lambda a, x: a + x)
