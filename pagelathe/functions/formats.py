"""Form formats recognised from scripts without running them: calls, their arguments, date patterns, masks, hints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .amounts import SEPARATORS, once

# Bounds, the formats that an index stands for, masks of special styles.
MOST_SCRIPT, MOST_DECIMALS, MOST_PATTERN, MOST_CURRENCY = 1000, 15, 64, 8
DATE_FORMATS = ["m/d", "m/d/yy", "mm/dd/yy", "mm/yy", "d-mmm", "d-mmm-yy", "dd-mmm-yy", "yy-mm-dd", "mmm-yy", "mmmm-yy", "mmm d, yyyy", "mmmm d, yyyy", "m/d/yy h:MM tt", "m/d/yy HH:MM"]
TIME_FORMATS = ["HH:MM", "h:MM tt", "HH:MM:ss", "h:MM:ss tt"]
SPECIAL_MASKS = [["99999"], ["99999-9999"], ["999-9999", "(999) 999-9999"], ["999-99-9999"]]
# Date tokens, the longest of a letter first, and the part that each shows.
PARTS = {
    "mmmm": "month", "mmm": "month", "mm": "month", "m": "month", "dddd": "weekday", "ddd": "weekday", "dd": "day", "d": "day", "yyyy": "year", "yy": "year",
    "HH": "hour", "H": "hour", "hh": "hour", "h": "hour", "MM": "minute", "M": "minute", "ss": "second", "s": "second", "tt": "ampm", "t": "ampm",
}
HINTS = {"yy": "aa", "yyyy": "aaaa", "H": "h", "HH": "hh", "M": "m", "MM": "mm", "t": "a/p", "tt": "am/pm"}
SLOTS = {"9": "[0-9]", "A": "[A-Za-z]", "O": "[A-Za-z0-9]", "X": r"\P{Cc}"}
SLOT_HINTS = {"9": "0", "A": "A", "O": "X", "X": "_"}

_ARGUMENT = r"""(?:"(?:[^"\\\n\r]|\\[\s\S])*+"|'(?:[^'\\\n\r]|\\[\s\S])*+'|[+-]?(?:\d+(?:\.\d*)?|\.\d+)|true|false)"""
_CALL = r"(?s)^\s*([A-Za-z_$][\w$]*)\s*\((.*)\)\s*;?\s*$"
_TOKEN = r"\\[\s\S]|" + "|".join(PARTS) + r"|[\s\S]"


def literal(argument: Column) -> Column:
    """The text of a quoted argument with its escapes resolved; null if one is unfinished or octal. Others as they are."""
    inner = F.regexp_replace(argument, r"""(?s)^["'](.*)["']$""", "$1")
    kept = F.replace(inner, F.lit("\\\\"), F.lit("\x01"))  # an escaped backslash stays out of the way
    bad = kept.rlike(r"\\(?:u(?![0-9A-Fa-f]{4})|x(?![0-9A-Fa-f]{2})|[1-9]|0\d)")
    json = F.regexp_replace(kept, r"\\(?:\r\n|[\n\r  ])", "")
    json = F.regexp_replace(json, r"\\x([0-9A-Fa-f]{2})", r"\\u00$1")
    json = F.regexp_replace(F.regexp_replace(json, r"\\v", r"\\u000b"), r"\\0", r"\\u0000")
    json = F.regexp_replace(json, r"\\([^nrtbfu])", "$1")
    json = F.replace(F.replace(json, F.lit('"'), F.lit('\\"')), F.lit("\x01"), F.lit("\\\\"))
    resolved = F.from_json(F.concat(F.lit('["'), json, F.lit('"]')), "array<string>")[0]
    quoted = argument.rlike("""^["']""")
    return F.when(quoted & inner.contains("\\"), F.when(~bad, resolved)).when(quoted, inner).otherwise(argument)


def parse_call(script: Column) -> Column:
    """struct<name, args> of a script that is one call with literal arguments; null for anything else."""
    inner = F.regexp_extract(script, _CALL, 2)
    good = (F.length(script) <= MOST_SCRIPT) & script.rlike(_CALL) & ((F.trim(inner) == "") | inner.rlike(rf"^\s*{_ARGUMENT}\s*(?:,\s*{_ARGUMENT}\s*)*$"))
    args = F.regexp_extract_all(inner, F.lit(_ARGUMENT), F.lit(0))
    return F.when(good & ~F.exists(args, lambda a: literal(a).isNull()), F.struct(F.regexp_extract(script, _CALL, 1).alias("name"), args.alias("args")))


def date_parts(pattern: Column) -> Column:
    """The tokens and literals of a date pattern; null if it is none.

    None: an unknown letter, a part shown twice, a day without month, a weekday
    without the whole date, am or pm without hour.
    """
    table = F.create_map(*[F.lit(x) for k, v in PARTS.items() for x in (k, v)])

    def checked(tokens: Column) -> Column:
        names = F.filter(F.transform(tokens, lambda t: F.try_element_at(table, t)), lambda n: n.isNotNull())
        has = lambda n: F.array_contains(names, n)
        letters = F.exists(tokens, lambda t: t.rlike("^[A-Za-z]+$") & F.try_element_at(table, t).isNull())
        control = F.exists(tokens, lambda t: t.rlike(r"^(?:\p{C}|\\)$"))
        lone = (has("day") & ~has("month")) | (has("weekday") & ~(has("day") & has("year"))) | (has("ampm") & ~has("hour"))
        return F.when((F.size(names) > 0) & (F.size(F.array_distinct(names)) == F.size(names)) & ~letters & ~control & ~lone, tokens)

    return F.when(F.length(pattern).between(1, MOST_PATTERN), once(F.regexp_extract_all(pattern, F.lit(_TOKEN), F.lit(0)), checked))


def date_hint(pattern: Column) -> Column:
    """The pattern as a hint; an example where it holds letters of its own."""
    table = F.create_map(*[F.lit(x) for k, v in HINTS.items() for x in (k, v)])
    sample = F.create_map(*[F.lit(x) for k, v in {"d": "31", "dd": "31", "ddd": "Tue", "dddd": "Tuesday", "m": "12", "mm": "12", "mmm": "Dec", "mmmm": "December", "yy": "24", "yyyy": "2024", "H": "23", "HH": "23", "h": "11", "hh": "11", "M": "59", "MM": "59", "s": "59", "ss": "59", "t": "p", "tt": "pm"}.items() for x in (k, v)])
    plain = lambda t: F.when(t.startswith("\\"), F.substring(t, 2, 1)).otherwise(t)
    own = lambda tokens: F.exists(tokens, lambda t: t.rlike(r"^\\?\p{L}$") & F.try_element_at(sample, t).isNull())
    shown = lambda tokens, by: F.array_join(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(by, t), plain(t))), "")
    return once(date_parts(pattern), lambda tokens: F.when(own(tokens), shown(tokens, sample)).otherwise(shown(tokens, table)))


def valid_mask(mask: Column) -> Column:
    return (F.length(mask) <= MOST_PATTERN) & ~mask.rlike(r"\p{C}") & mask.rlike("[9AOX]")


def mask_hint(mask: Column) -> Column:
    return F.translate(mask, "".join(SLOT_HINTS), "".join(SLOT_HINTS.values()))


def fill_mask(mask: Column, text: Column) -> Column:
    """The text fitted into a mask of 9, A, O and X slots, missing literals added; null if it does not fit.

    Blanks and signs out of place are skipped.
    """
    loose = r"^[\s\p{P}\p{S}]+"
    state = F.struct(text.alias("rest"), F.lit("").alias("out"), F.lit(True).alias("ok"))

    def step(acc: Column, slot: Column) -> Column:
        rest = F.when(slot.isin("9", "A", "O"), F.regexp_replace(acc["rest"], loose, "")).otherwise(acc["rest"])
        first = F.substring(rest, 1, 1)
        fits = F.lit(False)
        for s, pattern in SLOTS.items():
            fits = fits | ((slot == s) & first.rlike(f"^{pattern}$"))
        is_slot = slot.isin(*SLOTS)
        taken = F.when(is_slot | (first == slot), F.substring(rest, 2, MOST_SCRIPT)).otherwise(rest)
        return F.struct(taken.alias("rest"), F.concat(acc["out"], F.when(is_slot, first).otherwise(slot)).alias("out"), (acc["ok"] & (~is_slot | fits)).alias("ok"))

    done = F.aggregate(F.filter(F.split(mask, ""), lambda c: c != ""), state, step)
    return once(done, lambda d: F.when(d["ok"] & (F.regexp_replace(d["rest"], loose, "") == ""), d["out"]))


def _spec(kind: Column, **fields: Column) -> Column:
    none = {"decimals": "int", "separator": "int", "negative": "int", "currency": "string", "prepend": "boolean", "format": "string", "style": "int", "mask": "string"}
    return F.struct(kind.cast("string").alias("kind"), *[fields.get(k, F.lit(None)).cast(t).alias(k) for k, t in none.items()])


def read_script(script: Column, role: str) -> Column:
    """struct<given, spec> of a format or keystroke script: given is false without one; spec is null if it is not recognised."""

    def read(call: Column) -> Column:
        args, name, n = call["args"], call["name"], F.size(call["args"])
        text = lambda i: literal(F.get(args, F.lit(i)))
        quoted = lambda i: F.coalesce(F.get(args, F.lit(i)).rlike("""^["']"""), F.lit(False))
        numeric = lambda i: F.get(args, F.lit(i)).rlike(r"^[+-]?\d+(?:\.0*)?$")
        whole = lambda i: F.when(numeric(i), F.get(args, F.lit(i)).cast("double").cast("int"))
        flag = lambda i: F.when(F.get(args, F.lit(i)).isin("true", "1"), True).when(F.get(args, F.lit(i)).isin("false", "0"), False)
        word = role.capitalize()
        currency = quoted(4) & (F.length(text(4)) <= MOST_CURRENCY) & ~text(4).rlike(r"[\d\p{C}()+\-−]") & ((F.trim(text(4)) == "") | text(4).rlike(r"[^.,'’\s]"))
        number = F.when((n == 6) & whole(0).between(0, MOST_DECIMALS) & whole(1).between(0, 4) & whole(2).between(0, 3) & whole(3).isNotNull() & currency & flag(5).isNotNull(), _spec(F.lit("number"), decimals=whole(0), separator=whole(1), negative=whole(2), currency=text(4), prepend=flag(5)))
        most = 3 if role == "format" else 2
        percent = F.when(n.between(2, most) & whole(0).between(0, MOST_DECIMALS) & whole(1).between(0, 4) & ((n == 2) | flag(2).isNotNull()), _spec(F.lit("percent"), decimals=whole(0), separator=whole(1), prepend=F.coalesce(flag(2), F.lit(False))))
        listed = lambda kind, table: F.when((n == 1) & whole(0).between(0, len(table) - 1), _spec(F.lit(kind), format=F.get(F.array(*map(F.lit, table)), whole(0))))
        pattern = lambda kind: F.when((n == 1) & quoted(0) & date_parts(text(0)).isNotNull(), _spec(F.lit(kind), format=text(0)))
        special = F.when((n == 1) & whole(0).between(0, 3), _spec(F.lit("special"), style=whole(0)))
        found = F.when(name == f"AFNumber_{word}", number).when(name == f"AFPercent_{word}", percent).when(name == f"AFSpecial_{word}", special)
        for stem, kind, table in (("AFDate", "date", DATE_FORMATS), ("AFTime", "time", TIME_FORMATS)):
            found = found.when(name == f"{stem}_{word}Ex", pattern(kind)).when(name == f"{stem}_{word}", listed(kind, table))
        if role == "keystroke":
            found = found.when(name == "AFSpecial_KeystrokeEx", F.when((n == 1) & quoted(0) & valid_mask(text(0)), _spec(F.lit("mask"), mask=text(0))))
        return found

    given = F.coalesce(F.trim(script) != "", F.lit(False))
    return F.struct(given.alias("given"), F.when(given, once(parse_call(script), read)).alias("spec"))


def field_format(shown: Column, typed: Column) -> Column:
    """The format of a field by its two scripts, with `input`, the pattern in which a date is typed; null if there is none, if one is not recognised or if they disagree."""
    family = lambda s: F.when(s["kind"] == "time", "date").otherwise(s["kind"])

    def joined(x: Column) -> Column:
        f, k = x["f"], x["k"]
        lost = (f["given"] & f["spec"].isNull()) | (k["given"] & k["spec"].isNull())
        apart = f["given"] & k["given"] & ((family(f["spec"]) != family(k["spec"])) | ((f["spec"]["kind"] == "special") & (f["spec"]["style"] != k["spec"]["style"])))
        main = F.when(f["given"], f["spec"]).otherwise(k["spec"])
        spec = lambda m: F.struct(*[m[c].alias(c) for c in ("kind", "decimals", "separator", "negative", "currency", "prepend", "format", "style", "mask")], F.when(family(m) == "date", F.coalesce(k["spec"]["format"], m["format"])).alias("input"))
        return F.when(~lost & ~F.coalesce(apart, F.lit(False)), once(main, lambda m: F.when(m.isNotNull(), spec(m))))

    return once(F.struct(read_script(shown, "format").alias("f"), read_script(typed, "keystroke").alias("k")), joined)


def input_hint(spec: Column) -> Column:
    """struct<placeholder, keyboard> of a field's format."""
    return once(spec, _hint)


def _hint(spec: Column) -> Column:
    mark = F.get(F.array(*[F.lit(m) for _, m in SEPARATORS]), spec["separator"])
    zero = F.concat(F.lit("0"), F.when(spec["decimals"] > 0, F.concat(mark, F.repeat(F.lit("0"), spec["decimals"]))).otherwise(""))
    number = F.when(spec["prepend"], F.concat(spec["currency"], zero)).otherwise(F.concat(zero, spec["currency"]))
    percent = F.when(spec["prepend"], F.concat(F.lit("%"), zero)).otherwise(F.concat(zero, F.lit("%")))
    special = F.get(F.array(*[F.lit(m[-1]) for m in SPECIAL_MASKS]), spec["style"])
    named = F.exists(date_parts(spec["input"]), lambda t: t.isin("ddd", "dddd", "mmm", "mmmm", "t", "tt"))
    kind = spec["kind"]
    placeholder = F.when(kind == "number", number).when(kind == "percent", percent).when(kind.isin("date", "time"), date_hint(spec["input"])).when(kind == "special", mask_hint(special)).when(kind == "mask", mask_hint(spec["mask"]))
    keyboard = F.when(kind.isin("number", "percent"), F.when(spec["decimals"] > 0, "decimal").otherwise("numeric")).when(kind.isin("date", "time"), F.when(named, "text").otherwise("numeric")).when(kind == "special", "numeric").when(kind == "mask", F.when(spec["mask"].rlike("[AOX]"), "text").otherwise("numeric"))
    return F.struct(F.coalesce(placeholder, F.lit("")).alias("placeholder"), F.coalesce(keyboard, F.lit("text")).alias("keyboard"))
