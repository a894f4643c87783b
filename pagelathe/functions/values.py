"""Small values of documents: colours, wrapped text, strings and dates of page files, names, numbers in DER."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .amounts import once

# Fixed values.
LIGHT = 0.85
NARROW_SIDE, GAIN = 1000, 1.2
WATERMARK_FILL = 0.8
#: Characters of document strings from byte 0x18 on, and from 0x80 to 0xA0 (�: none).
DOC_LOW = "˘ˇˆ˙˝˛˚˜"
DOC_HIGH = "•†‡…—–ƒ⁄‹›−‰„“”‘’‚™ﬁﬂŁŒŠŸŽıłœšž�€"
#: Names that programs give by themselves, with numbers behind.
GENERIC = [
    "text", "texto", "textfield", "text field", "campo", "campo de texto", "caixa", "caixa de texto", "caixa de seleção", "caixa de selecao", "caixa de verificação",
    "check box", "checkbox", "botão de opção", "radio button", "field", "fill", "untitled", "undefined", "group",
]
#: Kinds of files by ending or media type, first match wins.
KINDS = [
    ("document", r"(?i)\.docx$", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"),
    ("old document", r"(?i)\.doc$", "application/msword"),
    ("image", r"(?i)\.(?:heic|heif)$", "image/"),
    ("pages", r"(?i)\.pdf$", "application/pdf"),
]


def file_kind(name: Column, media: Column) -> Column:
    """What a file is by its name or media type; null if it is nothing known."""
    whole = lambda m: F.coalesce(media.startswith(m) if m.endswith("/") else media == m, F.lit(False))
    return F.coalesce(*[F.when(F.coalesce(name.rlike(pattern), F.lit(False)) | whole(m), kind) for kind, pattern, m in KINDS])


def colour(text: Column) -> Column:
    """RRGGBB as three numbers from 0 to 1; null for anything else."""
    part = lambda i: F.conv(F.substring(text, i, 2), 16, 10).cast("double") / 255
    return F.when(text.rlike("(?i)^[0-9a-f]{6}$"), F.array(part(1), part(3), part(5)))


def is_light(rgb: Column) -> Column:
    """Too light for text without a dark ground."""
    return F.coalesce(0.2126 * rgb[0] + 0.7152 * rgb[1] + 0.0722 * rgb[2] > LIGHT, F.lit(False))


def wrapped(text: Column, width: int) -> Column:
    """Lines of at most width letters, by words; a longer word is cut. For fonts of one width; breaks in the text stay."""
    state = F.struct(F.array().cast("array<string>").alias("lines"), F.lit(None).cast("string").alias("line"))
    pieces = lambda w: F.when(F.length(w) > width, F.regexp_extract_all(w, F.lit(f"(?s).{{1,{width}}}"), F.lit(0))).otherwise(F.array(w))

    def step(acc: Column, word: Column) -> Column:
        joined = F.when(acc["line"].isNull() | (acc["line"] == ""), word).otherwise(F.concat(acc["line"], F.lit(" "), word))
        cut = pieces(word)
        done = F.when(acc["line"].isNull() | (acc["line"] == ""), acc["lines"]).otherwise(F.concat(acc["lines"], F.array(acc["line"])))
        fits = F.length(joined) <= width
        return F.struct(F.when(fits, acc["lines"]).otherwise(F.concat(done, F.slice(cut, F.lit(1), F.size(cut) - 1))).alias("lines"), F.when(fits, joined).otherwise(F.element_at(cut, -1)).alias("line"))

    paragraph = lambda p: F.aggregate(F.split(p, " "), state, step, lambda acc: F.concat(acc["lines"], F.array(acc["line"])))
    return F.flatten(F.transform(F.split(text, "\r\n|\r|\n"), paragraph))


def literal_string(text: Column) -> Column:
    """A text of Latin-1 as a literal string of page files: only ASCII, brackets and backslashes escaped, the rest in octal."""
    escape = lambda c: F.when(c.isin("(", ")", "\\"), F.concat(F.lit("\\"), c)).when(F.ascii(c) > 0x7E, F.concat(F.lit("\\"), F.conv(F.ascii(c).cast("string"), 10, 8))).otherwise(c)
    return F.concat(F.lit("("), F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), escape), ""), F.lit(")"))


def text_string(data: Column) -> Column:
    """The text of a document string: UTF-16 or UTF-8 by its mark, else one byte a character by the table."""
    kind = F.hex(F.substring(data, 1, 3))
    low = "".join(map(chr, range(0x18, 0x20)))
    high = "".join(map(chr, range(0x80, 0xA1)))
    plain = F.translate(F.decode(data, "ISO-8859-1"), low + high, DOC_LOW + DOC_HIGH)
    return F.when(kind.startswith("FEFF"), F.decode(F.substring(data, 3, 1 << 30), "UTF-16BE")).when(kind == "EFBBBF", F.decode(F.substring(data, 4, 1 << 30), "UTF-8")).otherwise(plain)


def _offset(minutes: Column) -> tuple[Column, Column, Column]:
    return F.when(minutes < 0, "-").otherwise("+"), F.floor(F.abs(minutes) / 60), F.abs(minutes) % 60


def page_file_date(when: Column, offset: Column) -> Column:
    """A local time and its offset in minutes as a date of page files."""
    sign, hours, minutes = _offset(offset)
    zone = F.when(offset == 0, "Z").otherwise(F.concat(sign, F.lpad(hours.cast("string"), 2, "0"), F.lit("'"), F.lpad(minutes.cast("string"), 2, "0"), F.lit("'")))
    return F.concat(F.lit("D:"), F.date_format(when, "yyyyMMddHHmmss"), zone)


def zone_label(offset: Column) -> Column:
    sign, hours, minutes = _offset(offset)
    return F.when(offset == 0, "UTC").otherwise(F.concat(F.lit("UTC"), sign, hours.cast("string"), F.when(minutes > 0, F.concat(F.lit(":"), F.lpad(minutes.cast("string"), 2, "0"))).otherwise("")))


def field_label(name: Column) -> Column:
    """A field's name as a label: spelt bytes become letters, the last part counts, words are set apart; empty if a program named it."""
    spelt = F.try_url_decode(F.regexp_replace(F.replace(F.replace(name, F.lit("%"), F.lit("%25")), F.lit("+"), F.lit("%2B")), "#([0-9A-Fa-f]{2})", "%$1"))
    text = F.when(name.rlike("#[0-9A-Fa-f]{2}"), F.coalesce(spelt, name)).otherwise(name)
    last = F.element_at(F.filter(F.split(F.regexp_replace(text, r"\[\d+\]", ""), r"\."), lambda p: p != ""), -1)
    apart = F.regexp_replace(F.regexp_replace(F.coalesce(last, F.lit("")), "([a-zà-ÿ])([A-ZÀ-Þ])", "$1 $2"), "_+", " ")
    label = F.trim(F.regexp_replace(apart, r"\s+", " "))
    given = label.rlike(r"\p{L}") & ~F.lower(label).rlike(f"^(?:{'|'.join(GENERIC)})[\\s\\d._-]*$")
    return F.when(given, F.substring(label, 1, 120)).otherwise("")


def display_name(common: Column, organisation: Column) -> Column:
    """The name of a certificate's holder without the number behind it."""
    return F.trim(F.regexp_replace(F.coalesce(common, organisation, F.lit("")), r":\d{11,14}$", ""))


def interpolated(text: Column, values: Column) -> Column:
    """{name} replaced by the value of that name, where there is one."""
    pattern = r"\{(\w+)\}"
    both = F.arrays_zip(F.split(text, pattern, -1).alias("rest"), F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("name"))
    put = lambda x: F.concat(x["rest"], F.when(x["name"].isNull(), "").otherwise(F.coalesce(F.try_element_at(values, x["name"]), F.concat(F.lit("{"), x["name"], F.lit("}")))))
    return F.array_join(F.transform(both, put), "")


def valid_box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    finite = [F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)) for v in (x0, y0, x1, y1)]
    return finite[0] & finite[1] & finite[2] & finite[3] & F.coalesce((x1 > x0) & (y1 > y0), F.lit(False))


def gains_from_more(width: Column, height: Column, side: int, high_side: int) -> Column:
    """A narrow page that a larger side limit would show much sharper."""
    long, short = F.greatest(width, height), F.least(width, height)
    scale, high = F.least(F.lit(1.0), side / long), F.least(F.lit(1.0), high_side / long)
    return (short * scale < NARROW_SIDE) & (high > scale * GAIN)


def watermark_size(length: Column, width: Column, height: Column, cap: float) -> Column:
    """struct<size, x, y>: the largest letters of a diagonal text of a length (at size 1), and where its baseline begins."""
    angle = F.atan2(height, width)
    cos, sin = F.cos(angle), F.sin(angle)
    size = F.least(WATERMARK_FILL * width / (length * cos + cap * sin), WATERMARK_FILL * height / (length * sin + cap * cos))
    place = lambda s: F.struct(s.alias("size"), (width / 2 - length * s / 2 * cos + cap * s / 2 * sin).alias("x"), (height / 2 + length * s / 2 * sin + cap * s / 2 * cos).alias("y"))
    return once(size, place)


def subset_tag(font: Column, letters: Column) -> Column:
    """Six capitals from the font's name and its letters."""
    digest = F.md5(F.concat_ws(":", font, letters))
    return F.concat(*[F.char(65 + F.conv(F.substring(digest, 2 * i + 1, 2), 16, 10).cast("int") % 26) for i in range(6)])


def der(identifier: str, body: Column) -> Column:
    """Hexadecimal DER of a value: identifier, length, body (all hexadecimal)."""
    n = (F.length(body) / 2).cast("int")
    even = lambda h: F.when(F.length(h) % 2 == 1, F.concat(F.lit("0"), h)).otherwise(h)
    long = even(F.hex(n.cast("bigint")))
    size = F.when(n < 128, F.lpad(F.hex(n.cast("bigint")), 2, "0")).otherwise(F.concat(F.hex((128 + F.length(long) / 2).cast("bigint")), long))
    return F.concat(F.lit(identifier), size, body)


def der_integer(value: Column) -> Column:
    h = F.hex(value.cast("bigint"))
    even = F.when(F.length(h) % 2 == 1, F.concat(F.lit("0"), h)).otherwise(h)
    return der("02", F.when(F.conv(F.substring(even, 1, 1), 16, 10).cast("int") >= 8, F.concat(F.lit("00"), even)).otherwise(even))


def der_oid(text: Column) -> Column:
    arcs = F.transform(F.split(text, r"\."), lambda a: a.cast("bigint"))
    values = F.concat(F.array(arcs[0] * 40 + arcs[1]), F.slice(arcs, F.lit(3), F.size(arcs)))
    group = lambda v, k: (F.floor(v / 128**k) % 128 + (128 if k else 0)).cast("bigint")
    base = lambda v: F.concat(*[F.when(v >= 128**k, F.lpad(F.hex(group(v, k)), 2, "0")).otherwise("") for k in (4, 3, 2, 1)], F.lpad(F.hex(group(v, 0)), 2, "0"))
    return der("06", F.array_join(F.transform(values, base), ""))


def der_set(items: Column) -> Column:
    """Hexadecimal elements in ascending order of their bytes, a prefix first."""
    return der("31", F.array_join(F.array_sort(items), ""))
