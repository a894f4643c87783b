"""Names, types and ranges on inputs that the tables make: what was typed, in many spellings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import names
from ..operators import fields, pages
from .base import load, query

_TITLES = ["Registro Geral", "CARTEIRA   NACIONAL DE HABILITAÇÃO", "Demonstrativo de Pagamento", "DANFE", "boleto bancário", "Faturas", "extrato", "Procuração", "CERTIDAO", "Contrato", "declaração", "Recebemos de", "Currículo", "comprovante", "nada disso", "subcontrato", "Conta"]
_RULES = [
    ("rg", r"REGISTRO\s+GERAL"), ("cnh", r"CARTEIRA\s+NACIONAL\s+DE\s+H"), ("contracheque", r"DEMONSTRATIVO\s+DE\s+PAGAMENTO"), ("nota-fiscal", "DANFE"), ("boleto", "BOLETO"), ("fatura", "FATURA"), ("extrato", "EXTRATO"),
    ("procuracao", "PROCURACAO"), ("certidao", "CERTIDAO"), ("contrato", "CONTRATO"), ("declaracao", "DECLARACAO"), ("recibo", r"RECEBEMOS\s+DE($|[^\p{L}\p{N}])"), ("curriculo", "CURRICULO"), ("comprovante", "COMPROVANTE"),
]
_CASES = " ".join(rf"WHEN regexp_matches(t, '(^|[^\p{{L}}\p{{N}}]){pattern}') THEN '{kind}'" for kind, pattern in _RULES)
_LIST = "[" + ", ".join(f"'{t}'" for t in _TITLES) + "]"


@query(
    f"""WITH d AS (SELECT doc_id, upper(strip_accents(substr(text, 1, 200) || ' ' || {_LIST}[(doc_id % {len(_TITLES)} + 1)::INTEGER] || CASE WHEN doc_id % 2 = 0 THEN ' ' ELSE ', ' END || substr(text, 201))) AS t FROM documents)
SELECT doc_id, CASE {_CASES} END AS type FROM d"""
)
def doc_types(spark, sf_dir):
    """Whole texts with a title in their midst, in any case and with accents."""
    d = load(spark, sf_dir, "documents")
    title = F.element_at(F.array(*map(F.lit, _TITLES)), (F.col("doc_id") % len(_TITLES) + 1).cast("int"))
    text = F.concat(F.substring("text", 1, 200), F.lit(" "), title, F.when(F.col("doc_id") % 2 == 0, " ").otherwise(", "), F.substring(F.col("text"), F.lit(201), F.length("text")))
    return d.select("doc_id", names.document_type(text).alias("type"))


_NAME = """CASE p_partkey % 7 WHEN 0 THEN 'IMG_' || p_partkey || '.jpg' WHEN 1 THEN p_name || '.v' || p_size || '.docx' WHEN 2 THEN (2000 + p_size) || '-10-20 11.' || p_size || '.pdf' WHEN 3 THEN p_name WHEN 4 THEN '  ' || p_name || ' .pdf' WHEN 5 THEN 'WhatsApp Image ' || p_name || '.jpeg' ELSE p_brand || ' ' || p_type || '.' || p_name END"""


@query(
    rf"""WITH n AS (SELECT p_partkey, {_NAME} AS name FROM part), s AS (SELECT p_partkey, trim(regexp_replace(name, '\.[^.]*$', '')) AS stem FROM n)
SELECT p_partkey, CASE WHEN stem <> '' AND NOT regexp_matches(lower(stem), '^(img[_-]|pxl_|dsc|dcim|scan|whatsapp image|screenshot|captura de tela)') AND NOT regexp_matches(stem, '^[\d\s._:-]+$') THEN stem END AS stem FROM s"""
)
def file_stems(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    name = (
        F.when(k % 7 == 0, F.concat(F.lit("IMG_"), k.cast("string"), F.lit(".jpg")))
        .when(k % 7 == 1, F.concat("p_name", F.lit(".v"), size, F.lit(".docx")))
        .when(k % 7 == 2, F.concat((2000 + F.col("p_size")).cast("string"), F.lit("-10-20 11."), size, F.lit(".pdf")))
        .when(k % 7 == 3, F.col("p_name"))
        .when(k % 7 == 4, F.concat(F.lit("  "), "p_name", F.lit(" .pdf")))
        .when(k % 7 == 5, F.concat(F.lit("WhatsApp Image "), "p_name", F.lit(".jpeg")))
        .otherwise(F.concat("p_brand", F.lit(" "), "p_type", F.lit("."), "p_name"))
    )
    return load(spark, sf_dir, "part").select("p_partkey", names.file_stem(name).alias("stem"))


@query(
    """WITH r AS (SELECT o_orderkey, o_custkey % 9 AS a, o_custkey % 9 + o_orderkey % 6 - 1 AS b, o_orderkey % 31 AS c, 12 AS total FROM orders),
g AS (SELECT *, CASE WHEN a < 1 OR b < 1 THEN 'below-1' WHEN greatest(a, b) > total THEN 'beyond:' || greatest(a, b) WHEN a > b THEN 'reversed:' || a || '-' || b END AS one, CASE WHEN c < 1 THEN 'below-1' WHEN c > total THEN 'beyond:' || c END AS two FROM r WHERE b >= 0)
SELECT o_orderkey, CASE WHEN one IS NULL AND two IS NULL THEN array_to_string(range(a - 1, b), ',') || ';' || (c - 1) END AS groups, CASE WHEN one IS NOT NULL OR two IS NOT NULL THEN CASE WHEN one = two OR two IS NULL THEN one WHEN one IS NULL THEN two ELSE one || ';' || two END ELSE '' END AS problems FROM g"""
)
def page_ranges(spark, sf_dir):
    """Two ranges of each order, typed in several ways; b below 0 can't be typed."""
    k, a = F.col("o_orderkey"), F.col("o_custkey") % 9
    b = a + k % 6 - 1
    sign = F.element_at(F.array(*map(F.lit, ["-", " - ", " to ", "–"])), (k % 4 + 1).cast("int"))
    # a problem repeats what was typed, so that is given in one way where there may be one
    text = F.concat(a.cast("string"), F.when(a > b, "-").otherwise(sign), b.cast("string"), F.when(k % 2 == 0, ",").otherwise(" ; "), (k % 31).cast("string"))
    parsed = load(spark, sf_dir, "orders").where(b >= 0).select("o_orderkey", pages.parse_ranges(text, F.lit(12)).alias("p"))
    joined = lambda g: F.array_join(g.cast("array<string>"), ",")
    return parsed.select("o_orderkey", F.when(F.col("p.groups").isNotNull(), F.array_join(F.transform("p.groups", joined), ";")).alias("groups"), F.array_join("p.problems", ";").alias("problems"))


@query(
    r"""SELECT o_orderkey, regexp_replace(c_name || CASE WHEN o_orderkey % 2 = 0 THEN '.PDF' ELSE ':a/b' END, '(?i)\.pdf$', '').replace(':', '-').replace('/', '-') || '-' || lpad((o_orderkey % 50 + 1)::VARCHAR, 3, '0') || CASE WHEN o_orderkey % 3 > 0 THEN '-' || lpad((o_orderkey % 50 + 1 + o_orderkey % 3)::VARCHAR, 3, '0') ELSE '' END AS name
FROM orders JOIN customer ON o_custkey = c_custkey"""
)
def output_file_names(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = load(spark, sf_dir, "orders").join(load(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    base_name = F.concat("c_name", F.when(k % 2 == 0, ".PDF").otherwise(":a/b"))
    return rows.select("o_orderkey", pages.output_name(base_name, k % 50 + 1, k % 50 + 1 + k % 3, F.lit(120)).alias("name"))


@query(
    """WITH w AS (SELECT l_suppkey AS doc_id, l_linenumber AS page_no, l_partkey % 60 AS num FROM lineitem) SELECT doc_id, num, min(page_no) AS page_no FROM w GROUP BY ALL"""
)
def widget_pages(spark, sf_dir):
    w = load(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("doc_id"), F.col("l_linenumber").alias("page_no")).agg(F.collect_set(F.col("l_partkey") % 60).alias("marks"))
    return fields.widget_pages(w)


@query(
    """WITH RECURSIVE f AS (SELECT event_id // 12 AS page_id, event_id AS field_no, (event_id * 37 % 101)::DOUBLE AS x0, (event_id * 53 % 89)::DOUBLE AS y0, event_id * 53 % 89 + 4 + event_id % 9 AS y1 FROM events),
s AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY y0, field_no) AS k, (y0 + y1) / 2 AS middle FROM f),
r(page_id, k, ends, row_at) AS (SELECT page_id, 0::BIGINT, []::DOUBLE[], NULL::BIGINT FROM s WHERE k = 1
 UNION ALL SELECT s.page_id, s.k, CASE WHEN len(list_filter(r.ends, lambda e: e >= s.middle)) > 0 THEN r.ends ELSE list_append(r.ends, s.y1::DOUBLE) END,
  CASE WHEN len(list_filter(r.ends, lambda e: e >= s.middle)) > 0 THEN list_position(list_transform(r.ends, lambda e: e >= s.middle), true) - 1 ELSE len(r.ends) END FROM r JOIN s ON s.page_id = r.page_id AND s.k = r.k + 1)
SELECT page_id, field_no, row_at::INTEGER AS row_no, (row_number() OVER (PARTITION BY page_id ORDER BY row_at, x0, y0, field_no) - 1)::INTEGER AS place FROM r JOIN s USING (page_id, k)"""
)
def field_order(spark, sf_dir):
    k = F.col("event_id")
    y0 = k * 53 % 89
    boxes = load(spark, sf_dir, "events").select(F.floor(k / 12).alias("page_id"), k.alias("field_no"), (k * 37 % 101).cast("double").alias("x0"), y0.cast("double").alias("y0"), (k * 37 % 101 + 9).cast("double").alias("x1"), (y0 + 4 + k % 9).cast("double").alias("y1"))
    return fields.reading_order(boxes)


@query(
    """WITH w AS (SELECT o_custkey AS field_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS position, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN (o_orderkey % 4)::VARCHAR ELSE o_orderstatus END AS state, CASE WHEN o_custkey % 2 = 0 THEN [o_custkey || 'a', 'Yes', ''] END AS labels, CASE WHEN o_custkey % 3 = 0 THEN 'checkbox' ELSE 'radio' END AS kind FROM orders),
s AS (SELECT *, coalesce(state, CASE WHEN kind = 'checkbox' AND labels IS NULL THEN 'Yes' ELSE position::VARCHAR END) AS own FROM w),
u AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY field_id, own ORDER BY position) = 1),
l AS (SELECT *, row_number() OVER (PARTITION BY field_id ORDER BY position) - 1 AS option_no, CASE WHEN try_cast(own AS BIGINT) < len(labels) THEN own::BIGINT ELSE position END AS i FROM u),
n AS (SELECT *, coalesce(nullif(labels[i + 1], ''), own) AS label FROM l),
c AS (SELECT *, count(*) OVER (PARTITION BY field_id, label) > 1 AS again, regexp_matches(lower(trim(label)), '^(\\d+|on|off|yes)$') AS blank FROM n)
SELECT field_id, own AS state, CASE WHEN NOT blank AND NOT again THEN label WHEN option_no = 1 THEN 'near' WHEN blank THEN 'Opção ' || (option_no + 1) ELSE label || ' (' || (option_no + 1) || ')' END AS name FROM c"""
)
def option_names(spark, sf_dir):
    k, own = F.col("o_orderkey"), F.col("o_custkey")
    position = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    state = F.when(k % 5 == 0, None).when(k % 5 == 1, (k % 4).cast("string")).otherwise(F.col("o_orderstatus"))
    labels = F.when(own % 2 == 0, F.array(F.concat(own.cast("string"), F.lit("a")), F.lit("Yes"), F.lit("")))
    widgets = load(spark, sf_dir, "orders").select(own.alias("field_id"), position.alias("position"), F.when(own % 3 == 0, "checkbox").otherwise("radio").alias("kind"), state.alias("state"), labels.alias("labels"))
    options = fields.button_options(widgets).withColumn("near", F.when(F.col("option_no") == 1, "near").otherwise(""))
    return fields.option_names(options)


@query(
    """SELECT o_orderkey, o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 4 < 3 AS still_empty, CASE WHEN o_orderkey % 7 = 0 THEN 'foreign pages' WHEN o_orderkey % 2 = 0 THEN 'password' END AS conflict,
 round((20 + o_orderkey % 10 / 10.0::DOUBLE * 400) / 600, 9) AS x0, round((30 + (o_orderkey % 10 / 10.0::DOUBLE + 0.1::DOUBLE) * 500) / 800, 9) AS y1 FROM orders"""
)
def page_rules(spark, sf_dir):
    """Required fields without a value, options that exclude each other, rectangles of photos on their sheets."""
    k = F.col("o_orderkey")
    value = F.when(k % 4 == 0, None).when(k % 4 == 1, F.array().cast("array<string>")).when(k % 4 == 2, F.array(F.lit("  "), F.lit(None).cast("string"))).otherwise(F.array(F.lit(""), F.col("o_orderstatus")))
    at = (k % 10).cast("double") / 10
    rect = F.struct(at.alias("x0"), at.alias("y0"), (at + 0.1).alias("x1"), (at + 0.1).alias("y1"))
    image = F.struct(F.lit(20.0).alias("x"), F.lit(30.0).alias("y"), F.lit(400.0).alias("w"), F.lit(500.0).alias("h"))
    rows = load(spark, sf_dir, "orders").select("o_orderkey", fields.still_empty(k % 3 != 0, k % 5 != 0, value).alias("still_empty"), fields.archive_conflict(k % 7 == 0, k % 2 == 0).alias("conflict"), fields.sheet_rect(rect, F.lit(600.0), F.lit(800.0), image).alias("r"))
    return rows.select("o_orderkey", "still_empty", "conflict", F.round("r.x0", 9).alias("x0"), F.round("r.y1", 9).alias("y1"))
