"""Queries over small values, lists and trees derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import values as v
from ..operators import lists
from .base import load, query

K = "o_orderkey"
_PICK = lambda items, key: F.element_at(F.array(*map(F.lit, items)), (key % len(items) + 1).cast("int"))
_SQL = lambda items: "[" + ", ".join("NULL" if x is None else "'" + x.replace("'", "''") + "'" for x in items) + "]"

_NAMES = ["a.DOCX", "b.doc", "photo.heic", "c.pdf", "d.txt", "e"]
_MEDIA = ["", "application/pdf", "image/png", "application/msword", "text/plain"]


@query(
    f"""WITH n AS (SELECT o_orderkey, o_comment || {_SQL(_NAMES)}[(o_orderkey % 6 + 1)::INTEGER] AS name, {_SQL(_MEDIA)}[(o_orderkey % 5 + 1)::INTEGER] AS media FROM (SELECT *, o_orderstatus AS o_comment FROM orders))
SELECT o_orderkey, CASE WHEN lower(name) LIKE '%.docx' THEN 'document' WHEN lower(name) LIKE '%.doc' OR media = 'application/msword' THEN 'old document' WHEN lower(name) LIKE '%.heic' OR media LIKE 'image/%' THEN 'image' WHEN lower(name) LIKE '%.pdf' OR media = 'application/pdf' THEN 'pages' END AS kind FROM n"""
)
def file_kinds(spark, sf_dir):
    k = F.col(K)
    return load(spark, sf_dir, "orders").select(K, v.file_kind(F.concat("o_orderstatus", _PICK(_NAMES, k)), _PICK(_MEDIA, k)).alias("kind"))


_HEX = "lower(lpad(to_hex((o_orderkey * 7919 % 16777216)::BIGINT), 6, '0'))"


@query(
    f"""WITH h AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'auto' ELSE {_HEX} END AS h FROM orders),
c AS (SELECT o_orderkey, CASE WHEN h <> 'auto' THEN [('0x' || h[1:2])::INTEGER / 255.0::DOUBLE, ('0x' || h[3:4])::INTEGER / 255.0::DOUBLE, ('0x' || h[5:6])::INTEGER / 255.0::DOUBLE] END AS c FROM h)
SELECT o_orderkey, c[1] AS r, c[2] AS g, c[3] AS b, coalesce(0.2126::DOUBLE * c[1] + 0.7152::DOUBLE * c[2] + 0.0722::DOUBLE * c[3] > 0.85::DOUBLE, false) AS light FROM c"""
)
def colours(spark, sf_dir):
    k = F.col(K)
    text = F.when(k % 7 == 0, "auto").otherwise(F.lower(F.lpad(F.hex((k * 7919 % 16777216).cast("bigint")), 6, "0")))
    c = v.colour(text)
    return load(spark, sf_dir, "orders").select(K, c[0].alias("r"), c[1].alias("g"), c[2].alias("b"), v.is_light(c).alias("light"))


@query(
    r"""WITH d AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) || ' ' || repeat('x', 95) AS t FROM documents), l AS (SELECT doc_id, regexp_extract_all(t || ' ', '(.{1,40})(?: )|.{40}') AS l FROM d)
SELECT doc_id, len(l)::INTEGER AS n_lines, md5(array_to_string(list_transform(l, lambda x: rtrim(x)), chr(10))) AS lines FROM l"""
)
def wrap_text(spark, sf_dir):
    t = F.concat(F.trim(F.regexp_replace("text", r"\s+", " ")), F.lit(" "), F.lit("x" * 95))
    return load(spark, sf_dir, "documents").select("doc_id", v.wrapped(t, 40).alias("l")).select("doc_id", F.size("l").alias("n_lines"), F.md5(F.array_join("l", "\n")).alias("lines"))


@query("SELECT c_custkey, '(' || replace(replace(replace(c_name, '\\', '\\\\'), '(', '\\('), ')', '\\)') || '\\(\\351\\\\' || ')' AS literal FROM customer")
def literal_strings(spark, sf_dir):
    return load(spark, sf_dir, "customer").select("c_custkey", v.literal_string(F.concat("c_name", F.lit("(é\\"))).alias("literal"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_name || ' é' WHEN 1 THEN c_name || ' €' ELSE c_name || '€Ł˘' END AS text FROM customer")
def text_strings(spark, sf_dir):
    k, name = F.col("c_custkey"), F.col("c_name")
    utf16 = F.concat(F.unhex(F.lit("FEFF")), F.encode(F.concat(name, F.lit(" é")), "UTF-16BE"))
    utf8 = F.concat(F.unhex(F.lit("EFBBBF")), F.encode(F.concat(name, F.lit(" €")), "UTF-8"))
    table = F.concat(F.encode(name, "ISO-8859-1"), F.unhex(F.lit("A09518")))
    return load(spark, sf_dir, "customer").select("c_custkey", v.text_string(F.when(k % 3 == 0, utf16).when(k % 3 == 1, utf8).otherwise(table)).alias("text"))


@query(
    """WITH o AS (SELECT o_orderkey, o_orderdate, (o_orderkey % 53 - 26) * 30 AS m FROM orders)
SELECT o_orderkey, 'D:' || strftime(o_orderdate, '%Y%m%d%H%M%S') || CASE WHEN m = 0 THEN 'Z' ELSE CASE WHEN m < 0 THEN '-' ELSE '+' END || lpad((abs(m) // 60)::VARCHAR, 2, '0') || '''' || lpad((abs(m) % 60)::VARCHAR, 2, '0') || '''' END AS "date",
 CASE WHEN m = 0 THEN 'UTC' ELSE 'UTC' || CASE WHEN m < 0 THEN '-' ELSE '+' END || (abs(m) // 60) || CASE WHEN abs(m) % 60 > 0 THEN ':' || lpad((abs(m) % 60)::VARCHAR, 2, '0') ELSE '' END END AS zone FROM o"""
)
def page_file_dates(spark, sf_dir):
    m = (F.col(K) % 53 - 26) * 30
    return load(spark, sf_dir, "orders").select(K, v.page_file_date(F.col("o_orderdate"), m).alias("date"), v.zone_label(m).alias("zone"))


@query(
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Nome Completo ' || p_partkey WHEN 1 THEN '' WHEN 2 THEN 'Endereço ' || p_partkey ELSE 'lote de ' || lower(p_brand[1:5]) || ' ' || p_partkey END AS label FROM part"""
)
def field_labels(spark, sf_dir):
    k = F.col("p_partkey")
    n = k.cast("string")
    name = F.when(k % 4 == 0, F.concat(F.lit("form1[0].NomeCompleto_"), n)).when(k % 4 == 1, F.concat(F.lit("Text"), n)).when(k % 4 == 2, F.concat(F.lit("a.Endere#C3#A7o_"), n)).otherwise(F.concat(F.lit("lote__de_"), F.lower(F.substring("p_brand", 1, 5)), F.lit("[2] "), n))
    return load(spark, sf_dir, "part").select("p_partkey", v.field_label(name).alias("label"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'ORG ' || s_suppkey WHEN s_suppkey % 3 = 1 THEN s_name ELSE s_name || ':123' END AS name, 'Olá ' || s_name || ', ' || s_suppkey || ' de {total}' AS greeting FROM supplier")
def display_names(spark, sf_dir):
    k = F.col("s_suppkey")
    cn = F.when(k % 3 == 1, F.concat("s_name", F.lit(":12345678901"))).when(k % 3 == 2, F.concat("s_name", F.lit(":123")))
    values = F.create_map(F.lit("name"), F.col("s_name"), F.lit("n"), k.cast("string"))
    return load(spark, sf_dir, "supplier").select("s_suppkey", v.display_name(cn, F.concat(F.lit("ORG "), k.cast("string"))).alias("name"), v.interpolated(F.lit("Olá {name}, {n} de {total}"), values).alias("greeting"))


@query(
    """WITH s AS (SELECT p_partkey, 400.0::DOUBLE + p_partkey * 37 % 3000 AS w, 900.0::DOUBLE + p_partkey * 91 % 5000 AS h FROM part)
SELECT p_partkey, w > h - 500 AS valid, least(w, h) * least(1.0::DOUBLE, 2000 / greatest(w, h)) < 1000 AND least(1.0::DOUBLE, 3500 / greatest(w, h)) > least(1.0::DOUBLE, 2000 / greatest(w, h)) * 1.2::DOUBLE AS gains FROM s"""
)
def page_predicates(spark, sf_dir):
    k = F.col("p_partkey")
    w, h = 400.0 + k * 37 % 3000, 900.0 + k * 91 % 5000
    return load(spark, sf_dir, "part").select("p_partkey", v.valid_box(F.lit(0.0), F.lit(1.0), w - h + 500, F.lit(2.0)).alias("valid"), v.gains_from_more(w, h, 2000, 3500).alias("gains"))


@query(
    """WITH s AS (SELECT p_partkey, 3.0::DOUBLE + p_size / 10 AS l, 300.0::DOUBLE + p_partkey % 400 AS w, 400.0::DOUBLE + p_partkey % 300 AS h FROM part),
a AS (SELECT *, cos(atan2(h, w)) AS c, sin(atan2(h, w)) AS s FROM s), z AS (SELECT *, least(0.8::DOUBLE * w / (l * c + 0.718::DOUBLE * s), 0.8::DOUBLE * h / (l * s + 0.718::DOUBLE * c)) AS size FROM a)
SELECT p_partkey, round(size, 6) AS size, round(w / 2 - l * size / 2 * c + 0.718::DOUBLE * size / 2 * s, 6) AS x, round(h / 2 + l * size / 2 * s + 0.718::DOUBLE * size / 2 * c, 6) AS y FROM z"""
)
def watermark_layout(spark, sf_dir):
    k = F.col("p_partkey")
    place = v.watermark_size(3.0 + F.col("p_size") / 10, 300.0 + k % 400, 400.0 + k % 300, 0.718)
    return load(spark, sf_dir, "part").select("p_partkey", place.alias("m")).select("p_partkey", *[F.round(f"m.{c}", 6).alias(c) for c in ("size", "x", "y")])


_B = lambda i: f"chr((65 + ('0x' || substr(h, {2 * i + 1}, 2))::INTEGER % 26)::INTEGER)"


@query(f"SELECT c_custkey, {' || '.join(map(_B, range(6)))} AS tag FROM (SELECT c_custkey, md5('Helvetica:' || c_name) AS h FROM customer)")
def subset_tags(spark, sf_dir):
    return load(spark, sf_dir, "customer").select("c_custkey", v.subset_tag(F.lit("Helvetica"), F.col("c_name")).alias("tag"))


@query(
    """WITH c AS (SELECT c_custkey, CASE WHEN length(to_hex(c_custkey * 7919)) % 2 = 1 THEN '0' ELSE '' END || to_hex(c_custkey * 7919) AS h FROM customer),
b AS (SELECT c_custkey, upper(CASE WHEN h[1:1] >= '8' THEN '00' || h ELSE h END) AS b FROM c)
SELECT c_custkey, '02' || lpad(to_hex(length(b) // 2), 2, '0') || b AS "integer", '06' || CASE WHEN c_custkey < 128 THEN '03' WHEN c_custkey < 16384 THEN '04' WHEN c_custkey < 2097152 THEN '05' ELSE '06' END || '2A06' ||
 CASE WHEN c_custkey >= 2097152 THEN upper(to_hex(128 + c_custkey // 2097152 % 128)) ELSE '' END || CASE WHEN c_custkey >= 16384 THEN upper(to_hex(128 + c_custkey // 16384 % 128)) ELSE '' END || CASE WHEN c_custkey >= 128 THEN upper(to_hex(128 + c_custkey // 128 % 128)) ELSE '' END || lpad(upper(to_hex(c_custkey % 128)), 2, '0') AS oid,
 '31' || '06' || array_to_string(list_sort([lpad(upper(to_hex(c_custkey % 251)), 2, '0') || '01', lpad(upper(to_hex(c_custkey % 7)), 2, '0') || 'FF', '1002']), '') AS "set" FROM b"""
)
def der_values(spark, sf_dir):
    k = F.col("c_custkey")
    byte = lambda c: F.lpad(F.hex(c.cast("bigint")), 2, "0")
    oid = F.concat(F.lit("1.2.6."), k.cast("string"))
    items = F.array(F.concat(byte(k % 251), F.lit("01")), F.concat(byte(k % 7), F.lit("FF")), F.lit("1002"))
    return load(spark, sf_dir, "customer").select("c_custkey", v.der_integer(k * 7919).alias("integer"), v.der_oid(oid).alias("oid"), v.der_set(items).alias("set"))


# --- lists and trees ---------------------------------------------------------


@query(
    """WITH n AS (SELECT DISTINCT l_orderkey, l_partkey % 40 AS num FROM lineitem), g AS (SELECT *, num - row_number() OVER (PARTITION BY l_orderkey ORDER BY num) AS island FROM n)
SELECT l_orderkey, min(num) AS first, count(*) AS n FROM g GROUP BY l_orderkey, island"""
)
def number_sections(spark, sf_dir):
    nums = load(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") % 40).alias("num"))
    return lists.sections(nums, "l_orderkey", "num")


@query(
    """WITH e AS (SELECT user_id, event_id, (event_id % 3)::INTEGER AS level FROM events),
s AS (SELECT *, count(*) FILTER (level < 1) OVER w AS p1, count(*) FILTER (level < 2) OVER w AS p2 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
c AS (SELECT user_id, event_id, level, count(*) FILTER (level = 0) OVER (PARTITION BY user_id ORDER BY event_id) AS n0, count(*) FILTER (level = 1) OVER (PARTITION BY user_id, p1 ORDER BY event_id) AS n1, count(*) FILTER (level = 2) OVER (PARTITION BY user_id, p2 ORDER BY event_id) AS n2 FROM s)
SELECT user_id, event_id, CASE level WHEN 0 THEN n0::VARCHAR WHEN 1 THEN greatest(n0, 1) || '.' || n1 ELSE greatest(n0, 1) || '.' || greatest(n1, 1) || '.' || n2 END AS label FROM c"""
)
def list_counters(spark, sf_dir):
    items = load(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") % 3).cast("int").alias("level"))
    return lists.counters(items, "user_id", "event_id", 3).select("user_id", "event_id", "label")


@query("SELECT user_id, list_sort(list_distinct(list(event_type)))[1:3] AS names, count(*) AS n FROM events GROUP BY user_id".replace("list_sort(list_distinct(list(event_type)))[1:3]", "array_to_string(list_sort(list_distinct(list(event_type)))[1:3], ',')"))
def top_names(spark, sf_dir):
    """The first three names of a list and how many entries there are."""
    e = load(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.slice(F.array_sort(F.collect_set("event_type")), 1, 3), ",").alias("names"), F.count("*").alias("n"))
    return e


@query("SELECT page_id, item_no, row_number() OVER (PARTITION BY page_id ORDER BY y0, x0, item_no)::INTEGER AS place FROM (SELECT o_custkey AS page_id, o_orderkey AS item_no, (o_orderkey % 11) / 11.0::DOUBLE AS y0, (o_orderkey % 7) / 7.0::DOUBLE AS x0 FROM orders)")
def target_order(spark, sf_dir):
    t = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page_id"), F.col(K).alias("item_no"), ((F.col(K) % 11) / F.lit(11.0)).alias("y0"), ((F.col(K) % 7) / F.lit(7.0)).alias("x0"))
    return t.select("page_id", "item_no", F.row_number().over(Window.partitionBy("page_id").orderBy("y0", "x0", "item_no")).alias("place"))


@query(
    """WITH e AS (SELECT user_id, event_id, event_id % 10 AS page, event_type = 'click' AS undo FROM events), l AS (SELECT user_id, page, arg_max(undo, event_id) AS undone FROM e GROUP BY ALL)
SELECT user_id, page FROM (SELECT DISTINCT user_id, p AS page FROM events, range(10) r(p)) LEFT JOIN l USING (user_id, page) WHERE coalesce(undone, true)"""
)
def pages_left(spark, sf_dir):
    """Pages after their last removal or undo."""
    e = load(spark, sf_dir, "events")
    steps = e.select("user_id", (F.col("event_id") % 10).alias("page"), F.col("event_id").alias("step"), (F.col("event_type") != "click").alias("removed"))
    pages = e.select("user_id").distinct().select("user_id", F.explode(F.sequence(F.lit(0), F.lit(9)).cast("array<bigint>")).alias("page"))
    return lists.not_removed(pages, steps, ["user_id", "page"])


@query(
    """WITH m AS (SELECT o_orderstatus AS status, regexp_replace('bad object ' || o_custkey || ' at ' || (o_orderkey % 97), '[0-9]+', 'N', 'g') || ' ' || (CASE WHEN o_orderkey % 3 = 0 THEN 'again' ELSE '' END) AS message FROM orders)
SELECT status, message, count(*) AS n FROM m GROUP BY ALL"""
)
def status_counts(spark, sf_dir):
    """Results by status and message, numbers in messages made alike."""
    text = F.concat(F.lit("bad object "), F.col("o_custkey").cast("string"), F.lit(" at "), (F.col(K) % 97).cast("string"), F.lit(" "), F.when(F.col(K) % 3 == 0, "again").otherwise(""))
    o = load(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), F.regexp_replace(text, "[0-9]+", "N").alias("message"))
    return o.groupBy("status", "message").agg(F.count("*").alias("n"))


@query(
    """WITH i AS (SELECT l_orderkey AS doc_id, l_partkey % 60 AS num, l_quantity::BIGINT * 30000 AS size, l_linenumber % 3 = 0 AS recodable FROM lineitem), m AS (SELECT DISTINCT l_orderkey AS doc_id, l_suppkey % 60 AS num FROM lineitem),
c AS (SELECT doc_id, coalesce(sum(size) FILTER (recodable AND NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = i.doc_id AND m.num = i.num)), 0)::BIGINT AS bytes, sum(size)::BIGINT AS total FROM i GROUP BY doc_id)
SELECT doc_id, bytes, bytes >= 1048576 AND bytes >= total * 0.4 AS heavy, round((1 - (total - bytes / 2) / total) * 100)::INTEGER AS saved FROM c"""
)
def compressible_bytes(spark, sf_dir):
    """Bytes of images that can be coded again, masks left out; whether they make a file heavy; and what half of them saves."""
    lines = load(spark, sf_dir, "lineitem")
    images = lines.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_partkey") % 60).alias("num"), (F.col("l_quantity").cast("bigint") * 30000).alias("size"), (F.col("l_linenumber") % 3 == 0).alias("recodable"))
    masks = lines.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_suppkey") % 60).alias("num"))
    return lists.compressible(images, masks).select("doc_id", "bytes", lists.heavy(F.col("bytes"), F.col("total")).alias("heavy"), F.round((1 - (F.col("total") - F.col("bytes") / 2) / F.col("total")) * 100).cast("int").alias("saved"))
