"""Queries over form formats: scripts made of each order's numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import formats
from .base import load, query

K = "o_orderkey"


def _scripts(spark, sf_dir):
    """A format and a keystroke script of each order."""
    k = F.col(K)
    yes = F.when(k % 2 == 0, "true").otherwise("false")
    number = lambda role: F.concat(F.lit(f"AFNumber_{role}("), (k % 4).cast("string"), F.lit(", "), (k % 6).cast("string"), F.lit(", "), (k % 3).cast("string"), F.lit(', 0, "R$ ", '), yes, F.lit(");"))
    percent = F.concat(F.lit(" AFPercent_Format ( "), (k % 3).cast("string"), F.lit(","), (k % 5).cast("string"), F.lit(" ) "))
    date = F.concat(F.lit("AFDate_FormatEx('"), F.when(k % 3 == 0, "dd/mm/yyyy").when(k % 3 == 1, "d/yy").otherwise(r"mm\-yy"), F.lit("')"))
    indexed = F.concat(F.lit("AFTime_Format("), (k % 6).cast("string"), F.lit(")"))
    shown = F.when(k % 7 == 0, number("Format")).when(k % 7 == 1, percent).when(k % 7 == 2, date).when(k % 7 == 3, indexed).when(k % 7 == 4, "AFSpecial_Format(2)").when(k % 7 == 5, "app.alert(1)")
    typed = F.when(k % 7 == 0, number("Keystroke")).when(k % 7 == 2, 'AFDate_KeystrokeEx("yyyy-mm-dd")').when(k % 7 == 4, F.concat(F.lit("AFSpecial_Keystroke("), (k % 2 + 1).cast("string"), F.lit(")"))).when(k % 7 == 6, 'AFSpecial_KeystrokeEx("99.999-A")')
    return load(spark, sf_dir, "orders").select(K, shown.alias("shown"), typed.alias("typed"))


@query(
    """SELECT o_orderkey, CASE k WHEN 0 THEN 'AFNumber_Format' WHEN 1 THEN 'AFPercent_Format' WHEN 2 THEN 'AFDate_FormatEx' WHEN 3 THEN 'AFTime_Format' WHEN 4 THEN 'AFSpecial_Format' END AS name,
 CASE k WHEN 0 THEN (o_orderkey % 4) || '|' || (o_orderkey % 6) || '|' || (o_orderkey % 3) || '|0|R$ |' || CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END WHEN 1 THEN (o_orderkey % 3) || '|' || (o_orderkey % 5)
 WHEN 2 THEN CASE o_orderkey % 3 WHEN 0 THEN 'dd/mm/yyyy' WHEN 1 THEN 'd/yy' ELSE 'mm-yy' END WHEN 3 THEN (o_orderkey % 6)::VARCHAR WHEN 4 THEN '2' END AS args
FROM (SELECT o_orderkey, o_orderkey % 7 AS k FROM orders)"""
)
def parse_call(spark, sf_dir):
    call = _scripts(spark, sf_dir).select(K, formats.parse_call(F.col("shown")).alias("c"))
    return call.select(K, "c.name", F.array_join(F.transform("c.args", formats.literal), "|").alias("args"))


_SPEC = """f AS (SELECT o_orderkey, o_orderkey % 7 AS m, o_orderkey % 2 = 0 AS yes FROM orders),
s AS (SELECT o_orderkey, m, CASE WHEN m = 0 AND o_orderkey % 6 < 5 THEN 'number' WHEN m = 1 THEN 'percent' WHEN m = 2 AND o_orderkey % 3 = 0 OR m = 2 AND o_orderkey % 3 = 2 THEN 'date' WHEN m = 3 AND o_orderkey % 6 < 4 THEN 'time' WHEN m = 4 AND o_orderkey % 2 = 1 THEN 'special' WHEN m = 6 THEN 'mask' END AS kind,
 CASE m WHEN 0 THEN o_orderkey % 4 WHEN 1 THEN o_orderkey % 3 END AS d, CASE m WHEN 0 THEN o_orderkey % 6 WHEN 1 THEN o_orderkey % 5 END AS sep, yes,
 CASE m WHEN 2 THEN CASE o_orderkey % 3 WHEN 0 THEN 'dd/mm/yyyy' ELSE 'mm-yy' END WHEN 3 THEN ['HH:MM', 'h:MM tt', 'HH:MM:ss', 'h:MM:ss tt'][(o_orderkey % 6 + 1)::INTEGER] END AS format,
 CASE m WHEN 2 THEN 'yyyy-mm-dd' WHEN 3 THEN ['HH:MM', 'h:MM tt', 'HH:MM:ss', 'h:MM:ss tt'][(o_orderkey % 6 + 1)::INTEGER] END AS input FROM f)"""


@query(f"WITH {_SPEC} SELECT o_orderkey, kind, coalesce(CASE WHEN kind IS NOT NULL THEN d END, -1)::INTEGER AS decimals, coalesce(CASE WHEN kind IS NOT NULL THEN sep END, -1)::INTEGER AS separator, CASE WHEN kind IS NOT NULL THEN format END AS format, CASE WHEN kind IS NOT NULL THEN input END AS input FROM s")
def field_formats(spark, sf_dir):
    spec = _scripts(spark, sf_dir).select(K, formats.field_format(F.col("shown"), F.col("typed")).alias("s"))
    return spec.select(K, "s.kind", F.coalesce("s.decimals", F.lit(-1)).alias("decimals"), F.coalesce("s.separator", F.lit(-1)).alias("separator"), "s.format", "s.input")


@query(
    f"""WITH {_SPEC}, z AS (SELECT *, '0' || CASE WHEN d > 0 THEN CASE WHEN sep IN (2, 3) THEN ',' ELSE '.' END || repeat('0', d::INTEGER) ELSE '' END AS zero FROM s)
SELECT o_orderkey, CASE kind WHEN 'number' THEN CASE WHEN yes THEN 'R$ ' || zero ELSE zero || 'R$ ' END WHEN 'percent' THEN zero || '%' WHEN 'date' THEN 'aaaa-mm-dd' WHEN 'time' THEN ['hh:mm', 'h:mm am/pm', 'hh:mm:ss', 'h:mm:ss am/pm'][(o_orderkey % 6 + 1)::INTEGER]
 WHEN 'special' THEN '(000) 000-0000' WHEN 'mask' THEN '00.000-A' ELSE '' END AS placeholder,
 CASE kind WHEN 'number' THEN CASE WHEN d > 0 THEN 'decimal' ELSE 'numeric' END WHEN 'percent' THEN CASE WHEN d > 0 THEN 'decimal' ELSE 'numeric' END WHEN 'date' THEN 'numeric' WHEN 'time' THEN CASE WHEN input LIKE '%tt' THEN 'text' ELSE 'numeric' END WHEN 'special' THEN 'numeric' ELSE 'text' END AS keyboard FROM z"""
)
def input_hints(spark, sf_dir):
    spec = _scripts(spark, sf_dir).select(K, formats.input_hint(formats.field_format(F.col("shown"), F.col("typed"))).alias("h"))
    return spec.select(K, "h.placeholder", "h.keyboard")


_PATTERNS = ["dd/mm/yyyy", "d mmm, yyyy", "dddd, mmmm d yyyy", "HH:MM", "h:MM tt", "tt", "d/yy", "mm/mm", "q/m", "m-yy", "", "yyyy.mm.dd HH:MM:ss"]


@query(
    f"""WITH p AS (SELECT o_orderkey, [{', '.join(repr(x) for x in _PATTERNS)}][(o_orderkey % {len(_PATTERNS)} + 1)::INTEGER] || CASE WHEN o_orderkey % 5 = 0 THEN ' x' ELSE '' END AS p FROM orders),
t AS (SELECT o_orderkey, regexp_extract_all(p, 'mmmm|mmm|mm|m|dddd|ddd|dd|d|yyyy|yy|HH|H|hh|h|MM|M|ss|s|tt|t|.') AS t FROM p),
n AS (SELECT o_orderkey, t, list_filter(list_transform(t, lambda x: CASE WHEN x LIKE 'm%' THEN 'month' WHEN x IN ('dddd', 'ddd') THEN 'weekday' WHEN x LIKE 'd%' THEN 'day' WHEN x LIKE 'y%' AND len(x) > 1 THEN 'year' WHEN lower(x) IN ('h', 'hh') THEN 'hour' WHEN x LIKE 'M%' THEN 'minute' WHEN x LIKE 's%' THEN 'second' WHEN x LIKE 't%' THEN 'ampm' END), lambda x: x IS NOT NULL) AS n,
 len(list_filter(t, lambda x: regexp_full_match(x, '[A-Za-z]') AND x NOT IN ('m', 'd', 'H', 'h', 'M', 's', 't'))) > 0 AS odd FROM t)
SELECT o_orderkey, CASE WHEN len(n) > 0 AND len(list_distinct(n)) = len(n) AND NOT odd AND NOT (list_contains(n, 'day') AND NOT list_contains(n, 'month')) AND NOT (list_contains(n, 'weekday') AND NOT (list_contains(n, 'day') AND list_contains(n, 'year'))) AND NOT (list_contains(n, 'ampm') AND NOT list_contains(n, 'hour')) THEN array_to_string(t, '|') END AS parts FROM n"""
)
def date_patterns(spark, sf_dir):
    p = F.element_at(F.array(*map(F.lit, _PATTERNS)), (F.col(K) % len(_PATTERNS) + 1).cast("int"))
    text = F.concat(p, F.when(F.col(K) % 5 == 0, " x").otherwise(""))
    return load(spark, sf_dir, "orders").select(K, formats.date_parts(text).alias("d")).select(K, F.when(F.col("d").isNotNull(), F.array_join("d", "|")).alias("parts"))


@query(
    """SELECT c_custkey, CASE WHEN length(d) = 12 AND c_custkey % 5 > 0 THEN '+' || substr(d, 1, 2) || ' (' || substr(d, 3, 3) || ') ' || chr((65 + c_custkey % 26)::INTEGER) || '/' || substr(d, 6, 7) END AS filled
FROM (SELECT c_custkey, lpad((c_custkey * 7919 % 1000000)::VARCHAR, 6, '0') || lpad((c_custkey * 104729 % 1000000)::VARCHAR, 6, '0') AS d FROM customer)"""
)
def mask_fill(spark, sf_dir):
    """Digits with a letter between them, typed with blanks and dots, into a mask; every fifth has a letter too many."""
    k = F.col("c_custkey")
    d = F.concat(F.lpad((k * 7919 % 1000000).cast("string"), 6, "0"), F.lpad((k * 104729 % 1000000).cast("string"), 6, "0"))
    typed = F.concat(F.substring(d, 1, 2), F.lit(" . "), F.substring(d, 3, 3), F.lit("-"), F.char(65 + k % 26), F.substring(d, 6, 7), F.when(k % 5 == 0, "Z").otherwise(" "))
    return load(spark, sf_dir, "customer").select("c_custkey", formats.fill_mask(F.lit("+99 (999) A/9999999"), typed).alias("filled"))
