"""Queries over trees, links and nested readings derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import bound
from ..operators import pages, targets, trees
from . import base
from .base import load, query


@query(
    """WITH RECURSIVE f AS (SELECT p_partkey AS num, CASE WHEN p_partkey > 3 THEN p_partkey // 3 END AS up, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'n' || p_partkey END AS partial, CASE WHEN p_partkey % 4 = 1 THEN p_brand END AS kind FROM part),
t(num, next, name, kind) AS (SELECT num, up, partial, kind FROM f UNION ALL SELECT t.num, f.up, CASE WHEN f.partial = '' THEN t.name WHEN t.name = '' THEN f.partial ELSE f.partial || '.' || t.name END, coalesce(t.kind, f.kind) FROM t JOIN f ON t.next = f.num)
SELECT num, name, coalesce(kind, '') AS kind FROM t WHERE next IS NULL"""
)
def field_tree(spark, sf_dir):
    k = F.col("p_partkey")
    f = load(spark, sf_dir, "part").select(F.lit(1).alias("doc_id"), k.alias("num"), F.when(k > 3, F.floor(k / 3)).alias("parent"), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("n"), k.cast("string"))).alias("partial"), F.when(k % 4 == 1, F.col("p_brand")).alias("kind"))
    return trees.field_tree(f, ["kind"]).select("num", "name", F.coalesce("kind", F.lit("")).alias("kind"))


@query(
    """WITH RECURSIVE d AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 > 0 THEN s_suppkey + 1 END AS link FROM supplier),
t(id, target, next, n) AS (SELECT id, id, link, 0 FROM d UNION ALL SELECT t.id, d.id, d.link, n + 1 FROM t JOIN d ON t.next = d.id WHERE n < 4)
SELECT id, arg_max(target, n) AS target FROM t GROUP BY id"""
)
def list_links(spark, sf_dir):
    k = F.col("s_suppkey")
    return trees.linked_definitions(load(spark, sf_dir, "supplier").select(k.alias("id"), F.when(k % 4 > 0, k + 1).alias("link")))


@query(
    """WITH RECURSIVE refs AS (SELECT DISTINCT l_suppkey % 5 AS doc_id, l_partkey AS src, l_partkey // 2 AS dst FROM lineitem), r(doc_id, num) AS (SELECT DISTINCT o_custkey % 5, o_custkey + 100 FROM orders UNION SELECT refs.doc_id, dst FROM r JOIN refs ON r.doc_id = refs.doc_id AND r.num = refs.src)
SELECT doc_id, num FROM r"""
)
def glyph_closure(spark, sf_dir):
    """Letters used and the parts that they are made of, until none is new."""
    refs = load(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 5).alias("doc_id"), F.col("l_partkey").alias("src"), F.floor(F.col("l_partkey") / 2).alias("dst")).distinct()
    used = load(spark, sf_dir, "orders").select((F.col("o_custkey") % 5).alias("doc_id"), (F.col("o_custkey") + 100).alias("num"))
    return pages.reachable(used, refs)


@query(
    """WITH l AS (SELECT p_partkey % 20 AS doc_id, p_partkey // 20 AS num, CASE WHEN p_size % 7 = 1 THEN true WHEN p_size % 7 = 2 THEN false WHEN p_size % 3 = 0 THEN false WHEN p_size % 5 = 0 THEN true ELSE p_partkey % 20 % 2 = 0 END AS visible FROM part),
m AS (SELECT DISTINCT l_partkey % 20 AS doc_id, l_orderkey % 50 AS content_no, l_partkey // 20 AS num FROM lineitem),
s AS (SELECT doc_id, content_no, bool_and(visible) AS a, bool_or(visible) AS o FROM m LEFT JOIN l USING (doc_id, num) GROUP BY ALL)
SELECT doc_id, content_no, coalesce(CASE content_no % 4 WHEN 0 THEN a WHEN 1 THEN NOT a WHEN 2 THEN NOT o ELSE o END, true) AS visible FROM s"""
)
def layer_visibility(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size")
    layers = load(spark, sf_dir, "part").select((k % 20).alias("doc_id"), F.floor(k / 20).alias("num"), (k % 20 % 2 == 1).alias("base_off"), (size % 5 == 0).alias("listed_on"), (size % 3 == 0).alias("listed_off"), F.when(size % 7 == 1, "ON").when(size % 7 == 2, "OFF").alias("view"))
    policy = F.element_at(F.array(*map(F.lit, ["AllOn", "AnyOff", "AllOff", "AnyOn"])), (F.col("content_no") % 4 + 1).cast("int"))
    members = load(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 20).alias("doc_id"), (F.col("l_orderkey") % 50).alias("content_no"), F.floor(F.col("l_partkey") / 20).alias("num")).distinct().withColumn("policy", policy)
    return trees.visible_content(members, layers)


@query(
    rf"""WITH {base.WORDS}, k AS (SELECT *, confidence::DOUBLE AS c FROM words WHERE NOT (NOT regexp_matches(text, '[\p{{L}}\p{{N}}§&%$@#]') AND confidence < 50))
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY word_no) - 1)::INTEGER AS word_no, text, x0 * 600 / 600 AS x0, y0 * 800 / 800 AS y0, word_no = max(word_no) OVER (PARTITION BY page_id, word_no // 8) AS last, c AS confidence FROM k"""
)
def flat_words(spark, sf_dir):
    """Nested readings (blocks, paragraphs, lines, words) made inside the rows of documents as base.words has them, flattened again."""
    made = F.filter(F.split("text", "[ \t\n\r]+"), lambda w: w != "")
    sized = lambda x, side: (x * side).alias

    def word(text, line, place):
        x, y = place * 0.125, line * 0.01
        confidence = ((line * 8 + place) * 37 + F.col("doc_id") * 11) % 101
        return F.struct(text.alias("text"), sized(x, 600)("x0"), sized(y, 800)("y0"), sized(x + 0.1, 600)("x1"), sized(y + 0.008, 800)("y1"), confidence.cast("double").alias("confidence"))

    line = lambda w, i: F.struct(F.transform(F.slice(w, i * 8 + 1, F.lit(8)), lambda t, k: word(t, i, k)).alias("words"))
    lines = bound(made, lambda w: F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / 8).cast("int")), lambda i: line(w, i))))
    nested = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.lit(600.0).alias("width"), F.lit(800.0).alias("height"), F.array(F.struct(F.array(F.struct(lines.alias("lines"))).alias("paragraphs"))).alias("blocks"))
    return trees.flat_words(nested).select("page_id", "word_no", "text", "x0", "y0", "last", "confidence")


@query("SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'automatic' WHEN abs(event_id % 31 - 15) < 2 THEN 'plain' WHEN abs(event_id % 31 - 15) < 3 THEN 'plain and automatic' ELSE 'automatic, then measured' END AS turns, CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN least(greatest(event_id % 12, 1), 9) - 1 ELSE 8 END::INTEGER AS page FROM events")
def reading_turns(spark, sf_dir):
    k = F.col("event_id")
    page = F.when(k % 3 == 0, "first").when(k % 3 == 1, (k % 12).cast("string")).otherwise("last")
    return load(spark, sf_dir, "events").select("event_id", trees.reading_turns(F.when(k % 13 != 0, (k % 31 - 15).cast("double"))).alias("turns"), trees.stamp_page(page, F.lit(9)).alias("page"))


@query(
    """WITH e AS (SELECT o_custkey % 50 AS page_id, o_orderkey AS edit_no, (o_orderkey % 40) / 100.0::DOUBLE AS x0, (o_orderkey % 30) / 100.0::DOUBLE AS y0, (o_orderkey % 4 * 90)::INTEGER AS turn FROM orders),
r AS (SELECT s_suppkey % 50 AS page_id, (s_suppkey % 60) / 100.0::DOUBLE AS x0, (s_suppkey % 50) / 100.0::DOUBLE AS y0 FROM supplier),
b AS (SELECT e.page_id, edit_no, turn, (greatest(r.x0, e.x0) - e.x0) / (e.x0 + 0.3::DOUBLE - e.x0) AS u0, (least(r.x0 + 0.2::DOUBLE, e.x0 + 0.3::DOUBLE) - e.x0) / (e.x0 + 0.3::DOUBLE - e.x0) AS u1, (greatest(r.y0, e.y0) - e.y0) / (e.y0 + 0.4::DOUBLE - e.y0) AS v0, (least(r.y0 + 0.1::DOUBLE, e.y0 + 0.4::DOUBLE) - e.y0) / (e.y0 + 0.4::DOUBLE - e.y0) AS v1
 FROM e JOIN r ON e.page_id = r.page_id WHERE least(r.x0 + 0.2::DOUBLE, e.x0 + 0.3::DOUBLE) > greatest(r.x0, e.x0) AND least(r.y0 + 0.1::DOUBLE, e.y0 + 0.4::DOUBLE) > greatest(r.y0, e.y0)),
t AS (SELECT page_id, edit_no, CASE turn WHEN 90 THEN [v0, 1 - u1, v1, 1 - u0] WHEN 180 THEN [1 - u1, 1 - v1, 1 - u0, 1 - v0] WHEN 270 THEN [1 - v1, u0, 1 - v0, u1] ELSE [u0, v0, u1, v1] END AS p FROM b),
s AS (SELECT page_id, edit_no, list_transform(p, lambda x: floor(x * 1e8::DOUBLE + 0.5) / 1e4::DOUBLE) AS p FROM t)
SELECT page_id, edit_no, string_agg(c, ';' ORDER BY c) AS cuts FROM (SELECT page_id, edit_no, printf('%.4f,%.4f,%.4f,%.4f', greatest(0.0::DOUBLE, floor(p[1]) / 1e4::DOUBLE), greatest(0.0::DOUBLE, floor(p[2]) / 1e4::DOUBLE), least(1.0::DOUBLE, ceil(p[3]) / 1e4::DOUBLE), least(1.0::DOUBLE, ceil(p[4]) / 1e4::DOUBLE)) AS c FROM s) GROUP BY ALL"""
)
def image_cuts(spark, sf_dir):
    k, s = F.col("o_orderkey"), F.col("s_suppkey")
    x, y = (k % 40) / F.lit(100.0), (k % 30) / F.lit(100.0)
    edits = load(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("page_id"), k.alias("edit_no"), x.alias("x0"), y.alias("y0"), (x + 0.3).alias("x1"), (y + 0.4).alias("y1"), (k % 4 * 90).cast("int").alias("turn"))
    p, q = (s % 60) / F.lit(100.0), (s % 50) / F.lit(100.0)
    rects = load(spark, sf_dir, "supplier").select((s % 50).alias("page_id"), p.alias("x0"), q.alias("y0"), (p + 0.2).alias("x1"), (q + 0.1).alias("y1"))
    return trees.image_cuts(edits, rects, ";")


@query(
    """WITH RECURSIVE b AS (SELECT user_id AS doc_id, event_id AS block_no, (event_id % 40 + 5)::DOUBLE AS h, event_id % 29 = 0 AS brk, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
f(doc_id, block_no, i, page_no, used) AS (SELECT doc_id, block_no, i, 0, h FROM b WHERE i = 1
 UNION ALL SELECT b.doc_id, b.block_no, b.i, CASE WHEN brk OR used + h > 100 THEN page_no + 1 ELSE page_no END, CASE WHEN brk OR used + h > 100 THEN h ELSE used + h END FROM f JOIN b ON b.doc_id = f.doc_id AND b.i = f.i + 1)
SELECT doc_id, block_no, page_no FROM f"""
)
def page_fill(spark, sf_dir):
    k = F.col("event_id")
    blocks = load(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), k.alias("block_no"), (k % 40 + 5).cast("double").alias("height"), (k % 29 == 0).alias("breaks"))
    return trees.fill_pages(blocks, 100.0)


@query("SELECT user_id, array_to_string(list_sort(list_distinct(flatten(list([event_type, 'Ed' || event_id % 7])))), ',') AS taken FROM events GROUP BY user_id")
def taken_names(spark, sf_dir):
    """All names that the resources of a document's pages use."""
    e = load(spark, sf_dir, "events").select("user_id", F.map_from_arrays(F.array("event_type", F.concat(F.lit("Ed"), (F.col("event_id") % 7).cast("string"))), F.array(F.lit(1), F.lit(2))).alias("resources"))
    dropped = e.select("user_id", F.map_filter("resources", lambda k, v: k != "Metadata").alias("resources"))
    return dropped.groupBy("user_id").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.map_keys("resources"))))), ",").alias("taken"))


def phrases(spark, sf_dir) -> DataFrame:
    """Words set tightly, with a wide gap behind each that ends in a dot: phrases end there and at line ends."""
    w = base.words(spark, sf_dir, True).withColumn("line", F.floor(F.col("word_no") / 8))
    before = Window.partitionBy("page_id", "line").orderBy("word_no").rowsBetween(Window.unboundedPreceding, -1)
    wide = F.length("text") * 0.01
    start = F.coalesce(F.sum(wide + F.when(F.col("text").endswith("."), 0.03).otherwise(0.004)).over(before), F.lit(0.0))
    pieces = w.select("page_id", F.col("word_no").alias("piece_no"), F.col("text").alias("str"), start.alias("x0"), (F.col("line") * 0.02).alias("y0"), (start + wide).alias("x1"), (F.col("line") * 0.02 + 0.01).alias("y1"), "line", F.lit(True).alias("words"), F.lit("sans").alias("family"))
    return targets.text_targets(pieces)


@query(
    f"""WITH {base.WORDS}, o AS (SELECT page_id, word_no // 8 AS line, word_no, text, coalesce(lag(text LIKE '%.') OVER (PARTITION BY page_id, word_no // 8 ORDER BY word_no), true) AS opens FROM words),
i AS (SELECT *, sum(opens::INTEGER) OVER (PARTITION BY page_id, line ORDER BY word_no) AS island FROM o)
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY line, island) - 1)::INTEGER AS target_no, string_agg(text, ' ' ORDER BY word_no) AS text FROM i GROUP BY page_id, line, island"""
)
def text_targets(spark, sf_dir):
    return phrases(spark, sf_dir).select("page_id", "target_no", "text")
