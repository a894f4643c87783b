"""Dates as typed into forms, and dates printed by a form's pattern."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .amounts import once

#: Two-digit years from here on are of the last century.
PIVOT = 50
# Month names, full; three letters suffice where they are unique.
MONTHS = ["janeiro", "fevereiro", "marco", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro"]
MONTHS_EN = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
_PARTS = {"d": r"(\d{1,2})", "m": r"(\d{1,2})", "y": r"(\d{4}|\d{2})"}
_TOKENS = {"mmmm": "MMMM", "mmm": "MMM", "mm": "MM", "m": "M", "dddd": "EEEE", "ddd": "EEE", "dd": "dd", "d": "d", "yyyy": "yyyy", "yy": "yy", "HH": "HH", "H": "H", "hh": "hh", "h": "h", "MM": "mm", "ss": "ss", "s": "s", "tt": "a"}


def _named_months(text: Column) -> Column:
    """Month names, whole or from three letters on, as numbers."""
    plain = F.translate(F.lower(text), "çáãé", "caae")
    for names in (MONTHS, MONTHS_EN):
        for k, name in enumerate(names):
            rest = "".join(f"(?:{c}" for c in name[3:]) + ")?" * (len(name) - 3)
            plain = F.regexp_replace(plain, rf"\b{name[:3]}{rest}\b", f" {k + 1} ")
    return F.regexp_replace(plain, r"\b(de|of)\b", " ")


def read_date(text: Column, order: str = "dmy") -> Column:
    """The date of a text, parts in the given order; compact digits too; null if it is none."""

    def built(x: Column) -> Column:
        at = {p: i + 1 for i, p in enumerate(order)}
        loose = r"^\s*" + r"[\s/.,-]+".join(_PARTS[p] for p in order) + r"\s*$"
        tight = [r"^\s*" + "".join(rf"(\d{{{w if p == 'y' else 2}}})" for p in order) + r"\s*$" for w in (4, 2)]
        part = lambda p: F.coalesce(*[F.when(x.rlike(pattern), F.regexp_extract(x, pattern, at[p]).cast("int")) for pattern in (loose, *tight)])
        year = part("y")
        full = F.when(year < PIVOT, year + 2000).when(year < 100, year + 1900).otherwise(year)
        return F.try_to_date(F.format_string("%04d-%02d-%02d", full, part("m"), part("d")), "yyyy-MM-dd")

    return once(_named_months(text), built)


def print_date(date: Column, pattern: str) -> Column:
    """A date or timestamp by a form's pattern (m, d, y, H, h, M, s, tt)."""
    out, i = "", 0
    while i < len(pattern):
        token = next((t for t in sorted(_TOKENS, key=len, reverse=True) if pattern.startswith(t, i)), None)
        out += _TOKENS[token] if token else ("''" if pattern[i] == "'" else f"'{pattern[i]}'" if pattern[i].isalpha() else pattern[i])
        i += len(token or "x")
    shown = F.date_format(date, out)
    return F.lower(shown) if "tt" in pattern and "mmm" not in pattern and "ddd" not in pattern else shown
