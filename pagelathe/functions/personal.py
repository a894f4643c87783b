"""Brazilian personal identifiers: check digits, patterns, spans by priority."""

from __future__ import annotations

import bisect
import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .geometry import bound

# Guards before and after a number, the patterns, and which kind wins.
BEFORE = r"(?<![\p{L}\p{N}./-])"
AFTER = r"(?![\p{L}\p{N}]|[./-]\p{N})"
PATTERNS = {
    "cpf": BEFORE + r"\d{3}\.?\d{3}\.?\d{3}-?\d{2}" + AFTER,
    "cnpj": BEFORE + r"(?:\d{2}\.?\d{3}\.?\d{3}/?\d{4}-?\d{2}|[0-9A-Z]{2}\.[0-9A-Z]{3}\.[0-9A-Z]{3}/[0-9A-Z]{4}-\d{2})" + AFTER,
    "cartao": BEFORE + r"(?:[2-6]\d{3}([ -])\d{4}\1\d{4}\1\d{1,7}|[2-6]\d{12,18})" + AFTER,
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}(?![\p{L}\p{N}])",
    "cep": "(?:" + BEFORE + r"(?:\d{5}-\d{3}|\d{2}\.\d{3}-\d{3})|(?<=\bCEP:?\s{0,3})\d{8})" + AFTER,
    "telefone": BEFORE + r"(?:(?:\+55\s?)?\(\d{2}\)\s?9?\d{4}[\s-]?\d{4}|\+55\s?\d{2}\s?9?\d{4}[\s-]?\d{4}|\d{2}\s9\d{4}-\d{4}|9\d{4}-\d{4}|[2-5]\d{3}-\d{4})" + AFTER,
}
PRIORITY = ("cpf", "cnpj", "cartao", "email", "cep", "telefone")
SPECIAL_SPACES = "   "


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _weighted(text: Column, weights: list[int], base: int = 48) -> Column:
    """Sum of (code of the i-th letter - base) * weight; codes as in ASCII."""
    terms = [(F.ascii(F.substring(text, i + 1, 1)) - base) * w for i, w in enumerate(weights)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def valid_cpf(text: Column) -> Column:
    """Eleven digits, not all equal, both mod-11 check digits right."""
    d = digits(text)
    check = lambda n: _weighted(d, list(range(n + 1, 1, -1))) * 10 % 11 % 10
    digit = lambda i: F.ascii(F.substring(d, i + 1, 1)) - 48
    return F.coalesce((F.length(d) == 11) & ~d.rlike(r"^(\d)\1{10}$") & (check(9) == digit(9)) & (check(10) == digit(10)), F.lit(False))


def valid_cnpj(text: Column) -> Column:
    """Twelve digits or capitals and two check digits; a letter counts as its code less 48."""
    weights = [6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]

    def right(c: Column, n: int) -> Column:
        return bound(_weighted(c, weights[-n:]) % 11, lambda rest: F.when(rest < 2, 0).otherwise(11 - rest)) == F.ascii(F.substring(c, n + 1, 1)) - 48

    # filters write a column out wherever it is used, so what is read letter by letter is bound to a name
    plain = F.regexp_replace(F.upper(text), "[./-]", "")
    return F.coalesce(bound(plain, lambda c: c.rlike("^[0-9A-Z]{12}[0-9]{2}$") & right(c, 12) & right(c, 13) & ~c.rlike(r"^(.)\1{13}$")), F.lit(False))


def valid_card(text: Column) -> Column:
    """13 to 19 digits that pass Luhn."""
    d = digits(text)
    return F.coalesce(F.length(d).between(13, 19) & F.call_function("luhn_check", d), F.lit(False))


def valid_phone(text: Column) -> Column:
    """An area code, where there is one, has no zero."""
    code = F.regexp_extract(text, r"\((\d{2})\)|\+55\s?(\d{2})|^(\d{2})\s", 0)
    return F.coalesce((code == "") | F.substring(digits(F.regexp_replace(code, r"\+55", "")), 1, 2).rlike("^[1-9]{2}$"), F.lit(False))


# --- spans of a text ---------------------------------------------------------
# One pass over Arrow batches: the cost is linear in the text and in its matches.


def _mod11(text: str, weights: list[int]) -> int:
    return sum((ord(c) - 48) * w for c, w in zip(text, weights, strict=False)) % 11


def _cpf(text: str) -> bool:
    d = "".join(c for c in text if c in DIGITS)
    right = lambda n: _mod11(d, list(range(n + 1, 1, -1))) * 10 % 11 % 10 == int(d[n])
    return len(d) == 11 and len(set(d)) > 1 and right(9) and right(10)


def _cnpj(text: str) -> bool:
    c = text.upper().translate({ord(x): None for x in "./-"})
    weights = [6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]

    def right(n: int) -> bool:
        rest = _mod11(c, weights[-n:])
        return int(c[n]) == (0 if rest < 2 else 11 - rest)

    return len(c) == 14 and all(x in DIGITS for x in c[12:]) and len(set(c)) > 1 and right(12) and right(13)


def _card(text: str) -> bool:
    d = [int(c) for c in reversed(text) if c in DIGITS]
    return 13 <= len(d) <= 19 and sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(d)) % 10 == 0


def _phone(text: str) -> bool:
    code = _AREA.search(text)
    return code is None or "0" not in next(x for x in code.groups() if x)


DIGITS = "0123456789"
_AREA = re.compile(r"\((\d{2})\)|\+55\s?(\d{2})|^(\d{2})\s", re.A)
_VALID = {"cpf": _cpf, "cnpj": _cnpj, "cartao": _card, "telefone": _phone}
_SPAN = ArrayType(StructType([StructField("start", IntegerType()), StructField("stop", IntegerType()), StructField("type", StringType()), StructField("value", StringType())]))
_ARROW = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("type", pa.string()), ("value", pa.string())])
_HAS_DIGIT, _HAS_MAIL = re.compile("[0-9]{3}"), re.compile("@")


@functools.cache
def _compiled() -> list[tuple]:
    import regex  # lookbehinds of several lengths

    classes = lambda p: p.replace(r"\d", "[0-9]").replace(r"[\s", r"[ \t\n\x0B\f\r").replace(r"\s", r"[ \t\n\x0B\f\r]")
    return [(k, _HAS_MAIL if k == "email" else _HAS_DIGIT, regex.compile(classes(PATTERNS[k]))) for k in PRIORITY]


def spans_of(text: str) -> list[tuple[int, int, str]]:
    """(start, stop, type) by start: a kind earlier in PRIORITY wins an overlap, one that loses or fails its check blocks nobody."""
    plain = text.translate(_AS_BLANK) if not text.isascii() else text
    starts: list[int] = []
    kept: list[tuple[int, int, str]] = []
    for kind, hint, pattern in _compiled():
        if not hint.search(plain):
            continue
        for m in pattern.finditer(plain):
            a, b = m.span()
            k = bisect.bisect_left(starts, b)  # those before begin ahead of its end
            if k and kept[k - 1][1] > a or kind in _VALID and not _VALID[kind](m[0]):
                continue
            starts.insert(k, a)
            kept.insert(k, (a, b, kind))
    return kept


_AS_BLANK = {ord(c): " " for c in SPECIAL_SPACES}


def find_sensitive(text: Column) -> Column:
    """array<struct<start, stop, type, value>> by start, without overlaps; null of a null text.

    A kind earlier in PRIORITY wins an overlap; a match that loses or fails its
    check blocks nobody.
    """
    return _find(text)


@F.arrow_udf(_SPAN)
def _find(texts: pa.Array) -> pa.Array:
    found = [None if t is None else [(a, b, kind, t[a:b]) for a, b, kind in spans_of(t)] for t in texts.to_pylist()]
    rows = [dict(zip(("start", "stop", "type", "value"), r, strict=True)) for x in found if x for r in x]
    ends = np.concatenate([[0], np.cumsum([len(x or ()) for x in found])]).astype(np.int32)
    gone = pa.array([x is None for x in found])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows, _ARROW), mask=gone)
