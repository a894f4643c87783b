"""Phrases of documents replaced by other texts, in fonts whose widths are a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import glyphs
from ..operators import replace
from . import base
from .base import load, query
from .trees import phrases

# widths of the two proportional families, as the parts table makes them
_METRICS = "mt AS (SELECT ['Helvetica', 'Times-Roman'][(p_partkey % 2 + 1)::INTEGER] AS font, 32 + p_partkey // 2 % 224 AS code, min(250 + p_size * 9) AS width FROM part GROUP BY ALL)"


def _metrics(spark, sf_dir):
    k = F.col("p_partkey")
    font = F.when(k % 2 == 0, "Helvetica").otherwise("Times-Roman")
    return load(spark, sf_dir, "part").select(font.alias("font"), (32 + F.floor(k / 2) % 224).cast("int").alias("code"), (250 + F.col("p_size") * 9).alias("width"))


_CODE = "CASE WHEN ord(ch) BETWEEN 32 AND 126 OR ord(ch) BETWEEN 160 AND 255 THEN ord(ch) END"


@query(
    f"""WITH {_METRICS}, ps AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Helvetica' WHEN 1 THEN 'Times-Roman' ELSE 'Courier' END AS font, p_size, p_name AS t FROM part),
ch AS (SELECT *, substr(t, k, 1) AS ch FROM ps, range(1, 200) r(k) WHERE k <= length(t))
SELECT p_partkey, round(sum(CASE WHEN font = 'Courier' THEN 600 ELSE coalesce(width, 0) END) * (6 + p_size % 7) / 1000.0::DOUBLE, 6) AS width FROM ch LEFT JOIN mt USING (font) WHERE mt.code = ({_CODE}) OR font = 'Courier' GROUP BY p_partkey, p_size"""
)
def proportional_widths(spark, sf_dir):
    """Widths of names in three fonts, two of them by table; the third has fixed widths."""
    k = F.col("p_partkey")
    font = F.when(k % 3 == 0, "Helvetica").when(k % 3 == 1, "Times-Roman").otherwise("Courier")
    rows = load(spark, sf_dir, "part").withColumn("font", font).join(replace.width_arrays(_metrics(spark, sf_dir)), "font", "left")
    width = glyphs.text_width(F.col("p_name"), F.col("font"), (6 + F.col("p_size") % 7).cast("double"), F.create_map("font", "widths"))
    return rows.select("p_partkey", F.round(width, 6).alias("width"))


@query(
    f"""WITH {base.WORDS}, o AS (SELECT page_id, word_no // 8 AS line, word_no, text, coalesce(lag(text LIKE '%.') OVER (PARTITION BY page_id, word_no // 8 ORDER BY word_no), true) AS opens FROM words),
s AS (SELECT *, sum(opens::INTEGER) OVER w AS island, length(text) * 0.01::DOUBLE AS wide, coalesce(sum(length(text) * 0.01::DOUBLE + CASE WHEN text LIKE '%.' THEN 0.03::DOUBLE ELSE 0.004::DOUBLE END) OVER (PARTITION BY page_id, line ORDER BY word_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS x FROM o WINDOW w AS (PARTITION BY page_id, line ORDER BY word_no)),
t AS (SELECT page_id, line, row_number() OVER (PARTITION BY page_id ORDER BY line, island) - 1 AS target_no, string_agg(text, ' ' ORDER BY word_no) AS text, min(x) AS x0, line * 0.02::DOUBLE AS y0, max(x + wide) AS x1, line * 0.02::DOUBLE + 0.01::DOUBLE AS y1 FROM s GROUP BY page_id, line, island),
n AS (SELECT *, CASE WHEN target_no % 3 > 0 THEN 0.009::DOUBLE END AS size, CASE target_no % 4 WHEN 0 THEN upper(page_id::VARCHAR || 'abc') WHEN 1 THEN text || chr(10) || 'and more of it' WHEN 2 THEN text || ' ' || text ELSE ' ' END AS txt FROM t),
m AS (SELECT page_id, target_no, size, rtrim(txt) AS txt, least(greatest(x0 - a, 0), 1) AS x0, least(greatest(y0 - p, 0), 1) AS y0, least(greatest(x1 + a, 0), 1) AS x1, least(greatest(y1 + p, 0), 1) AS y1 FROM (SELECT *, 0.12::DOUBLE * (y1 - y0) AS p, CASE WHEN size IS NULL THEN 0.12::DOUBLE * (y1 - y0) ELSE 0.2::DOUBLE * size END * 800 / 600 AS a FROM n)),
u AS (SELECT *, greatest(0.5::DOUBLE, list_max(list_transform(string_split(txt, chr(10)), lambda l: length(l) * 0.6::DOUBLE))) + 0.4::DOUBLE AS bw, len(string_split(txt, chr(10))) * 1.25::DOUBLE + 0.4::DOUBLE AS bh FROM m),
g AS (SELECT *, CASE WHEN size > 0 AND trim(txt) <> '' THEN greatest(x1, least(1, x0 + bw * size * 800 / 600)) ELSE x1 END AS r FROM u),
f AS (SELECT *, least((r - x0) * 600 / bw, CASE WHEN size > 0 THEN size * 800 ELSE (y1 - y0) * 800 / bh END) AS pts FROM g)
SELECT page_id, target_no::INTEGER AS target_no, r > x1 + 1e-9 AS grew, CASE WHEN trim(txt) <> '' AND pts > 0 THEN round(pts, 9) END AS points, CASE WHEN trim(txt) <> '' AND pts > 0 THEN round(y0 + ((y1 - y0) * 800 - pts * bh) / 2 / 800, 9) END AS top, CASE WHEN trim(txt) <> '' AND pts > 0 THEN round(x0 + pts * bw / 600, 9) END AS ends FROM f"""
)
def replaced_texts(spark, sf_dir):
    """Every phrase replaced: by a short text, one of two lines, a longer one, or a blank; every third without a known size."""
    n = F.col("target_no")
    size = F.when(n % 3 > 0, 0.009)
    text = F.when(n % 4 == 0, F.upper(F.concat(F.col("page_id").cast("string"), F.lit("abc")))).when(n % 4 == 1, F.concat("text", F.lit("\nand more of it"))).when(n % 4 == 2, F.concat("text", F.lit(" "), "text")).otherwise(" ")
    found = phrases(spark, sf_dir).withColumns({"size": size, "text": text, "family": F.lit("mono"), "page_width": F.lit(600.0), "page_height": F.lit(800.0)})
    rows = replace.fitted(replace.marks(found))
    return rows.select("page_id", "target_no", "grew", F.round("edit.points", 9).alias("points"), F.round("edit.y0", 9).alias("top"), F.round("edit.x1", 9).alias("ends"))
