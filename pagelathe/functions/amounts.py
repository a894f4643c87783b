"""Amounts and percentages as typed: read in both styles, rounded on digits, printed by style."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thousands and decimal marks of each separator style; digit masks.
SEPARATORS = [(",", "."), ("", "."), (".", ","), ("", ","), ("'", ".")]
MOST_DIGITS = 100
MASKS = {"zip": ["99999"], "zip4": ["99999-9999"], "phone": ["999-9999", "(999) 999-9999"], "ssn": ["999-99-9999"], "cpf": ["999.999.999-99"], "cnpj": ["99.999.999/9999-99"], "cep": ["99999-999"]}


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed a single time, however often it is used."""
    return F.transform(F.array(value), lambda v: use(v))[0]


def read_amount(text: Column, style: int, symbols: list[str]) -> Column:
    """struct<negative, whole, fraction>, null if the text is no amount.

    A lone comma is decimal; so is a lone dot, but for d.ddd in a style with a
    decimal comma. Groups after the first have three digits.
    """
    rest = reduce(lambda c, s: F.replace(c, F.lit(s), F.lit(" ")), sorted([s for s in symbols if s], key=len, reverse=True), text)
    return once(F.trim(rest), lambda r: _unsigned(r, style))


def _unsigned(rest: Column, style: int) -> Column:
    paren = rest.rlike(r"(?s)^\(.*\)$")
    inner = F.when(paren, F.trim(rest.substr(F.lit(2), F.length(rest) - 2))).otherwise(rest)
    sign = F.regexp_extract(inner, r"^([-+−])\s*", 1)
    split = F.struct(sign.alias("sign"), F.regexp_replace(inner, r"^[-+−]\s*", "").alias("body"), paren.alias("paren"))
    return once(split, lambda x: F.when(~(x["paren"] & (x["sign"] != "")), _digits(x["body"], x["paren"] | x["sign"].isin("-", "−"), style)))


def _digits(body: Column, negative: Column, style: int) -> Column:
    ok = (F.length(body) <= MOST_DIGITS) & body.rlike(r"^[\d.,'’\s]*\d[\d.,'’\s]*$")
    dots, commas = F.regexp_count(body, F.lit(r"\.")), F.regexp_count(body, F.lit(","))
    comma_style = F.lit(SEPARATORS[style][1] == ",")
    last = lambda m: F.length(F.substring_index(body, m, -1))
    mark = (
        F.when((dots > 0) & (commas > 0), F.when(last(".") < last(","), F.lit(".")).otherwise(F.lit(",")))
        .when(commas == 1, F.lit(","))
        .when((dots == 1) & ~(comma_style & body.rlike(r"^\d{1,3}\.\d{3}$")), F.lit("."))
    )

    def cut(m: Column) -> Column:
        tail = F.when(m == ".", F.substring_index(body, ".", -1)).when(m == ",", F.substring_index(body, ",", -1)).otherwise(F.lit(""))
        head = F.when(m.isNotNull(), F.regexp_replace(body, r"[.,][^.,]*$", "")).otherwise(body)
        return F.struct(head.alias("head"), tail.alias("tail"))

    def parts(x: Column) -> Column:
        good = x["tail"].rlike(r"^\d*$") & (~x["head"].rlike(r"[.,'’\s]") | x["head"].rlike(r"^\d{1,3}([.,'’\s]\d{3})+$"))
        return F.when(good, F.struct(negative.alias("negative"), F.regexp_replace(x["head"], "[^0-9]", "").alias("whole"), x["tail"].alias("fraction")))

    return F.when(ok, once(once(mark, cut), parts))


def increment(digits: Column) -> Column:
    """digits + 1, on the string."""
    nines = F.regexp_extract(digits, "(9*)$", 1)
    kept = F.regexp_replace(digits, "9*$", "")
    up = F.concat(F.regexp_replace(kept, ".$", ""), (F.right(kept, F.lit(1)).cast("int") + 1).cast("string"))
    return F.concat(F.when(kept == "", F.lit("1")).otherwise(up), F.translate(nines, "9", "0"))


def print_amount(amount: Column, decimals: int, style: int) -> Column:
    """The magnitude, half up on the first dropped digit, with the style's marks."""
    thousands, mark = SEPARATORS[style]

    def rounded(a: Column) -> Column:
        fraction = a["fraction"]
        shown = F.concat(F.when(a["whole"] == "", F.lit("0")).otherwise(a["whole"]), F.substring(F.rpad(fraction, decimals, "0"), 1, decimals) if decimals else F.lit(""))
        return once(shown, lambda d: F.when((F.length(fraction) > decimals) & (F.substring(fraction, decimals + 1, 1) >= "5"), increment(d)).otherwise(d))

    def marked(digits: Column) -> Column:
        whole = digits.substr(F.lit(1), F.length(digits) - decimals)
        whole = F.regexp_replace(F.regexp_replace(whole, r"^0+(?=\d)", ""), r"\B(?=(\d{3})+$)", thousands)
        return F.concat(whole, F.lit(mark), F.right(digits, F.lit(decimals))) if decimals else whole

    return once(once(amount, rounded), marked)


def format_number(text: Column, decimals: int, style: int, negative: int = 0, currency: str = "", prepend: bool = True) -> Column:
    """struct<ok, text, red>: negative styles are minus, red, brackets, red brackets."""

    def shown(x: Column) -> Column:
        below = x["negative"] & x["body"].rlike("[1-9]")
        whole = F.concat(F.lit(currency), x["body"]) if prepend else F.concat(x["body"], F.lit(currency))
        minus = F.concat(F.lit("("), whole, F.lit(")")) if negative >= 2 else F.concat(F.lit("-"), whole) if negative == 0 else whole
        ok = x["body"].isNotNull()
        return F.struct(ok.alias("ok"), F.when(ok, F.when(below, minus).otherwise(whole)).otherwise(text).alias("text"), F.coalesce(ok & below & F.lit(negative % 2 == 1), F.lit(False)).alias("red"))

    read = once(read_amount(text, style, [currency.strip(), "R$"]), lambda a: F.struct(a["negative"].alias("negative"), print_amount(a, decimals, style).alias("body")))
    return once(read, shown)


def format_percent(text: Column, decimals: int, style: int, prepend: bool = False) -> Column:
    """struct<ok, text>: the typed number is the percentage."""

    def shown(x: Column) -> Column:
        body = F.when(x["negative"] & x["body"].rlike("[1-9]"), F.concat(F.lit("-"), x["body"])).otherwise(x["body"])
        marked = F.concat(F.lit("%"), body) if prepend else F.concat(body, F.lit("%"))
        return F.struct(x["body"].isNotNull().alias("ok"), F.coalesce(marked, text).alias("text"))

    read = once(read_amount(text, style, ["%"]), lambda a: F.struct(a["negative"].alias("negative"), print_amount(a, decimals, style).alias("body")))
    return once(read, shown)


def fill_mask(text: Column, kind: str) -> Column:
    """The digits of the text in the mask that takes so many; null if none does."""
    d = F.regexp_replace(text, r"[\s().,/-]", "")

    def filled(mask: str) -> Column:
        parts, at = [], 1
        for c in mask:
            if c == "9":
                parts.append(F.substring(d, at, 1))
                at += 1
            else:
                parts.append(F.lit(c))
        return F.when(d.rlike(f"^[0-9]{{{at - 1}}}$"), F.concat(*parts))

    return F.coalesce(*[filled(m) for m in MASKS[kind]])
