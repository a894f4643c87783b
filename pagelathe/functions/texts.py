"""Small text functions: counts, forms, numerals, sizes, payment codes, checksums."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
BLANKS = r"_{5,}|\.{8,}|…{3,}|\(\s?\)|\[\s?\]|[☐□]"
DOT_LEADER = r"\.{8,}(?!\.)\s{0,3}\d"
FORM_WORDS = r"(?i)\b(formul[aá]rio|requerimento|preencha|preencher|ficha|solicita[çc][aã]o)\b"
ROMAN = [(1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")]
PAPERS = {"A4": (595.28, 841.89), "A3": (841.89, 1190.55), "A5": (419.53, 595.28), "Letter": (612.0, 792.0), "Legal": (612.0, 1008.0)}
TWIPS = {"mm": 1440 / 25.4, "cm": 1440 / 2.54, "in": 1440.0, "pt": 20.0, "pc": 240.0, "pi": 240.0}


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def form_blanks(text: Column) -> Column:
    """Blanks to fill in the first 2,000 letters; dot leaders of a table of contents don't count."""
    head = F.substring(text, 1, 2000)
    return F.regexp_count(head, F.lit(BLANKS)) - F.regexp_count(head, F.lit(DOT_LEADER))


def has_form_word(text: Column) -> Column:
    return F.substring(text, 1, 2000).rlike(FORM_WORDS)


def letters(n: Column) -> Column:
    """1 -> A, 27 -> AA, as list numbers."""
    return F.when(n < 1, n.cast("string")).otherwise(F.repeat(F.char(65 + (n - 1) % 26), F.ceil(n / 26).cast("int")))


def roman(n: Column) -> Column:
    """Roman numerals from 1 to 3999, other numbers as they are."""
    places = [F.repeat(F.lit(s), F.floor(_rest(n, i) / v).cast("int")) for i, (v, s) in enumerate(ROMAN)]
    return F.when((n < 1) | (n > 3999), n.cast("string")).otherwise(F.concat(*places))


def _rest(n: Column, i: int) -> Column:
    return reduce(lambda x, v: x % v, [v for v, _ in ROMAN[:i]], n)


def list_number(n: Column, style: str) -> Column:
    made = {
        "upperLetter": letters(n),
        "lowerLetter": F.lower(letters(n)),
        "upperRoman": roman(n),
        "lowerRoman": F.lower(roman(n)),
        "decimalZero": F.when((n >= 0) & (n < 10), F.concat(F.lit("0"), n.cast("string"))).otherwise(n.cast("string")),
        "ordinal": F.concat(n.cast("string"), F.lit("º")),
        "bullet": F.lit(""),
        "none": F.lit(""),
    }
    return made.get(style, n.cast("string"))


def format_bytes(n: Column) -> Column:
    """Whole KB, one at least, below a MiB; else MB with one decimal."""
    return F.when(n < 1048576, F.concat(F.greatest(F.lit(1), F.round(n / 1024)).cast("bigint").cast("string"), F.lit(" KB"))).otherwise(F.concat(F.format_string("%.1f", F.round(n / 1048576.0, 1)), F.lit(" MB")))


def paper_name(width: Column, height: Column) -> Column:
    """The paper within 2 points, upright or sideways."""
    near = lambda a, b: (F.abs(F.least(width, height) - a) <= 2) & (F.abs(F.greatest(width, height) - b) <= 2)
    return F.coalesce(*[F.when(near(*size), F.lit(name)) for name, size in PAPERS.items()])


def twips(value: Column) -> Column:
    """A length with a unit in twips; a bare number is in twips already."""
    number = F.regexp_extract(value, r"^(-?[0-9.]+)", 1).cast("double")
    unit = F.regexp_extract(value, "([a-z]+)$", 1)
    factor = reduce(lambda c, u: c.when(unit == u, F.lit(TWIPS[u])), list(TWIPS)[1:], F.when(unit == "mm", F.lit(TWIPS["mm"])))
    return number * F.coalesce(factor, F.lit(1.0))


def crc16(text: Column) -> Column:
    """CRC-16 with polynomial 0x1021 from 0xFFFF over the letters' codes, four hex capitals."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c))

    def step(crc: Column, code: Column) -> Column:
        crc = crc.bitwiseXOR(F.shiftleft(code, 8).bitwiseAND(F.lit(0xFFFF)))
        bit = lambda c, _: F.when(c.bitwiseAND(F.lit(0x8000)) != 0, F.shiftleft(c, 1).bitwiseXOR(F.lit(0x1021))).otherwise(F.shiftleft(c, 1)).bitwiseAND(F.lit(0xFFFF))
        return F.aggregate(F.sequence(F.lit(1), F.lit(8)), crc, bit)

    return F.lpad(F.hex(F.aggregate(codes, F.lit(0xFFFF), step)), 4, "0")


def field(tag: str, value: Column) -> Column:
    return F.concat(F.lit(tag), F.lpad(F.length(value).cast("string"), 2, "0"), value)


def payment_code(key: Column, name: Column, city: Column) -> Column:
    """The static copy-and-paste payment code of a key: tagged fields and a checksum."""
    account = F.concat(field("00", F.lit("BR.GOV.BCB.PIX")), field("01", key))
    body = F.concat(field("00", F.lit("01")), field("26", account), field("52", F.lit("0000")), field("53", F.lit("986")), field("58", F.lit("BR")), field("59", F.substring(name, 1, 25)), field("60", F.substring(city, 1, 15)), field("62", field("05", F.lit("***"))), F.lit("6304"))
    return F.concat(body, crc16(body))


def remaining_ms(elapsed: Column, done: Column, total: Column) -> Column:
    """Time left at the pace so far; null before the first page and after the last."""
    return F.when((done > 0) & (elapsed > 0) & (total > done), elapsed / done * (total - done))


def reader_count(memory_gb: Column, cores: Column, n_pages: Column) -> Column:
    """Two readers with memory, cores and pages enough for them, else one; unknown counts as too little."""
    return F.when((memory_gb >= 8) & (cores >= 4) & (n_pages >= 3), 2).otherwise(1)


def dpi_hint(dpi: Column) -> Column:
    return F.least(F.greatest(F.round(dpi), F.lit(70)), F.lit(2400)).cast("int")
