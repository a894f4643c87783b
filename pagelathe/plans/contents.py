"""Queries over page contents, copied pages and changed form values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contents, copies, extras
from ..streaming import forms
from . import base
from .base import load, query

_OPS = ["BDC", "BMC", "EMC", "EMC", "q", "Q", "Tr", "Tj", "TJ", "'", '"', "Do", "BI", "f", "S", "B*", "sh", "Td", "T*", "BT", "ET", "re", "l", "Tj", "Td", "Tm"]
_LISTED = "[" + ", ".join("'" + o.replace("'", "''") + "'" for o in _OPS) + "]"


@query(
    f"""WITH RECURSIVE {base.WORDS},
n AS (SELECT page_id * 1000 + word_no // 40 AS content_no, word_no % 40 AS token_no, {_LISTED}[((ascii(text) * 31 + length(text) * 17 + word_no * 7) % {len(_OPS)} + 1)::INTEGER] AS op, length(text) AS l, word_no FROM words),
tk AS (SELECT content_no, token_no, op, CASE WHEN op = 'BDC' THEN CASE (word_no + l) % 3 WHEN 1 THEN true WHEN 2 THEN false END WHEN op = 'Do' THEN CASE (word_no + l) % 5 WHEN 0 THEN false WHEN 1 THEN true END END AS shown, l % 8 AS mode FROM n),
r(content_no, token_no, out, refused, marked, hidden, modes, lost) AS (
 SELECT content_no, -1::BIGINT, NULL::VARCHAR, NULL::VARCHAR, []::BOOLEAN[], false, [0::BIGINT], false FROM (SELECT DISTINCT content_no FROM tk)
 UNION ALL
 SELECT content_no, token_no, CASE WHEN op = 'BDC' AND shown IS NOT NULL THEN '/OC BMC' WHEN op IN ('BDC', 'BMC', 'EMC', 'q', 'Q', 'Tr') THEN op WHEN op = 'Do' AND (hidden OR NOT coalesce(shown, true)) THEN NULL WHEN NOT hidden THEN op
   WHEN op IN ('f', 'S', 'B*') THEN 'n' WHEN op = '''' THEN 'T*' WHEN op = '"' THEN 'Tw Tc T*' WHEN op IN ('Tj', 'TJ', 'sh', 'BI') THEN NULL ELSE op END,
  CASE WHEN hidden AND op IN ('Tj', 'TJ', '''', '"') AND modes[-1] >= 4 THEN 'hidden text clips' WHEN NOT hidden AND op IN ('Tj', 'TJ') AND lost THEN 'visible text goes on after hidden text' END,
  CASE WHEN op IN ('BDC', 'BMC') THEN list_append(marked, hidden) WHEN op = 'EMC' AND len(marked) > 0 THEN marked[:-2] ELSE marked END,
  CASE WHEN op IN ('BDC', 'BMC') THEN hidden OR (op = 'BDC' AND NOT coalesce(shown, true)) WHEN op = 'EMC' AND len(marked) > 0 THEN marked[-1] ELSE hidden END,
  CASE WHEN op = 'q' THEN list_append(modes, modes[-1]) WHEN op = 'Q' AND len(modes) > 1 THEN modes[:-2] WHEN op = 'Tr' THEN list_append(modes[:-2], mode) ELSE modes END,
  CASE WHEN hidden AND op IN ('Tj', 'TJ', '''', '"') THEN true WHEN op IN ('BT', 'ET', 'Td', 'TD', 'T*', 'Tm', '''', '"') THEN false ELSE lost END
 FROM (SELECT tk.*, r.marked, r.hidden, r.modes, r.lost FROM r JOIN tk ON tk.content_no = r.content_no AND tk.token_no = r.token_no + 1)),
bad AS (SELECT content_no, arg_min(refused, token_no) AS refused FROM r WHERE refused IS NOT NULL GROUP BY content_no)
SELECT content_no, token_no, out AS op, NULL AS refused FROM r WHERE out IS NOT NULL AND content_no NOT IN (SELECT content_no FROM bad)
UNION ALL SELECT content_no, NULL, NULL, refused FROM bad"""
)
def hidden_content(spark, sf_dir):
    """What hidden layers leave of contents whose tokens are made from all words."""
    w = base.words(spark, sf_dir)
    n, size = F.col("word_no"), F.length("text")
    op = F.element_at(F.array(*map(F.lit, _OPS)), ((F.ascii("text") * 31 + size * 17 + n * 7) % len(_OPS) + 1).cast("int"))
    shown = F.when(F.col("op") == "BDC", F.when((n + size) % 3 == 1, True).when((n + size) % 3 == 2, False)).when(F.col("op") == "Do", F.when((n + size) % 5 == 0, False).when((n + size) % 5 == 1, True))
    tokens = w.withColumn("op", op).select((F.col("page_id") * 1000 + F.floor(n / 40)).alias("content_no"), (n % 40).cast("bigint").alias("token_no"), "op", shown.alias("shown"), (size % 8).alias("mode"))
    return contents.without_hidden(tokens)


@query(
    """WITH RECURSIVE refs AS (SELECT DISTINCT l_suppkey % 5 AS doc_id, l_partkey AS src, CASE WHEN l_suppkey % 2 = 0 THEN l_partkey // 2 ELSE l_partkey // 3 + 1 END AS dst FROM lineitem),
wanted AS (SELECT DISTINCT o_orderkey % 23 AS file_no, o_custkey % 5 AS doc_id, o_custkey * 7 AS num FROM orders),
o(file_no, doc_id, num) AS (SELECT * FROM wanted UNION SELECT o.file_no, o.doc_id, refs.dst FROM o JOIN refs ON o.doc_id = refs.doc_id AND o.num = refs.src WHERE refs.dst % 7 <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY file_no ORDER BY doc_id, num) AS new_num FROM o),
l AS (SELECT a.file_no, a.new_num, string_agg(b.new_num, ',' ORDER BY b.new_num) AS refs FROM n a JOIN refs r ON a.doc_id = r.doc_id AND a.num = r.src JOIN n b ON b.file_no = a.file_no AND b.doc_id = r.doc_id AND b.num = r.dst GROUP BY ALL)
SELECT n.file_no, n.new_num, n.doc_id, n.num, coalesce(refs, '') AS refs FROM n LEFT JOIN l USING (file_no, new_num)"""
)
def copied_objects(spark, sf_dir):
    """Pages of five documents dealt into 23 new files, with all that they refer to."""
    k, even = F.col("l_partkey"), F.col("l_suppkey") % 2 == 0
    refs = load(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 5).alias("doc_id"), k.alias("src"), F.when(even, F.floor(k / 2)).otherwise(F.floor(k / 3) + 1).alias("dst")).distinct()
    wanted = load(spark, sf_dir, "orders").select((F.col("o_orderkey") % 23).alias("file_no"), (F.col("o_custkey") % 5).alias("doc_id"), (F.col("o_custkey") * 7).alias("num"))
    pages = refs.select("doc_id", F.col("dst").alias("num")).where("num % 7 = 0").union(wanted.select("doc_id", "num")).distinct()
    return copies.copied_pages(wanted, refs, pages).withColumn("refs", F.array_join(F.transform("refs", lambda x: x.cast("string")), ","))


def _changes(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    value = F.when(F.col("event_id") % 11 == 0, None).otherwise(F.floor("value").cast("string"))
    return e.select(F.col("user_id").alias("form_id"), F.col("event_type").alias("field"), "ts", F.col("event_id").alias("seq"), value.alias("value"), F.floor(F.col("user_id") / 4).cast("string").alias("original"))


_CHANGES = "c AS (SELECT user_id AS form_id, event_type AS field, ts, event_id AS seq, CASE WHEN event_id % 11 <> 0 THEN floor(value)::BIGINT::VARCHAR END AS value, (user_id // 4)::VARCHAR AS original FROM events)"


@query(f"WITH {_CHANGES}, l AS (SELECT *, row_number() OVER (PARTITION BY form_id, field ORDER BY ts DESC, seq DESC) AS r, count(*) OVER (PARTITION BY form_id, field) AS n_changes FROM c) SELECT form_id, field, value, value IS DISTINCT FROM original AS overridden, n_changes FROM l WHERE r = 1")
def form_overrides(spark, sf_dir):
    return forms.overrides(_changes(spark, sf_dir))


@query(
    f"""WITH {_CHANGES}, g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY form_id ORDER BY ts) + INTERVAL 10 HOUR THEN 0 ELSE 1 END AS opens FROM c),
i AS (SELECT *, sum(opens) OVER (PARTITION BY form_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS series FROM g)
SELECT form_id, min(ts) AS first_ts, max(ts) AS last_ts, array_to_string(list_sort(list(DISTINCT field)), ',') AS fields, count(*) AS n_changes FROM i GROUP BY form_id, series"""
)
def form_notifications(spark, sf_dir):
    return forms.notifications(_changes(spark, sf_dir), "10 hours").withColumn("fields", F.array_join("fields", ","))


@query(
    """WITH p AS (SELECT o_custkey % 300 AS file_no, o_orderkey AS position, CASE o_orderkey % 4 WHEN 0 THEN 'top' WHEN 1 THEN 'bottom' WHEN 2 THEN 'left' END AS number_spot, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS header,
 CASE WHEN o_orderkey % 5 < 2 THEN o_orderstatus END AS footer, CASE WHEN o_orderkey % 7 = 0 THEN 'copy' END AS watermark, 8.0::DOUBLE + o_orderkey % 3 AS h FROM orders),
n AS (SELECT *, row_number() OVER (PARTITION BY file_no ORDER BY position) AS n, count(*) OVER (PARTITION BY file_no) AS total FROM p)
SELECT file_no, position, number_spot AS spot, 20.0::DOUBLE AS place, n || ' de ' || total AS text FROM n WHERE number_spot IS NOT NULL
UNION ALL SELECT file_no, position, 'top', CASE WHEN number_spot = 'top' THEN 22 + h ELSE 20 END, header FROM n WHERE header IS NOT NULL
UNION ALL SELECT file_no, position, 'bottom', CASE WHEN number_spot = 'bottom' THEN 22 + h ELSE 20 END, footer FROM n WHERE footer IS NOT NULL
UNION ALL SELECT file_no, position, 'middle', 0, watermark FROM n WHERE watermark IS NOT NULL"""
)
def page_extras(spark, sf_dir):
    """Numbers, headers, footers and watermarks of 300 files by a table function in SQL."""
    k = F.col("o_orderkey")
    spot = F.when(k % 4 == 0, "top").when(k % 4 == 1, "bottom").when(k % 4 == 2, "left")
    pages = load(spark, sf_dir, "orders").select((F.col("o_custkey") % 300).alias("file_no"), k.alias("position"), spot.alias("number_spot"), F.when(k % 3 == 0, F.col("o_orderpriority")).alias("header"), F.when(k % 5 < 2, F.col("o_orderstatus")).alias("footer"), F.when(k % 7 == 0, "copy").alias("watermark"), (8.0 + k % 3).cast("double").alias("height"))
    return extras.page_extras(spark, pages)
