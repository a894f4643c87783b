"""Named queries over the driver's tables: name -> (Spark plan, SQL twin or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import amounts, boxes, dates, names, personal, texts
from ..operators import pages, reading, redact, structure
from ..streaming import paper
from ..lineage import dealt
from . import base
from .base import QUERIES, load, query

# --- personal data -----------------------------------------------------------

_LUHN = "list_sum(list_transform(range(len(d)), lambda i: CASE WHEN i % 2 = 0 THEN (substr(d, len(d) - i, 1))::BIGINT ELSE (CASE WHEN (substr(d, len(d) - i, 1))::BIGINT > 4 THEN (substr(d, len(d) - i, 1))::BIGINT * 2 - 9 ELSE (substr(d, len(d) - i, 1))::BIGINT * 2 END) END)) % 10 = 0"
_FOUND = rf"""raw AS (
  SELECT doc_id, 'email' AS type, unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}._%+-]+@[\p{{L}}\p{{N}}-]+(?:\.[\p{{L}}\p{{N}}-]+)*\.\p{{L}}{{2,}}')) AS value FROM documents
  UNION ALL SELECT doc_id, 'cartao', unnest(regexp_extract_all(' ' || regexp_replace(text, '\s', '  ', 'g') || ' ', '[^\p{{L}}\p{{N}}./-]([2-6]\d{{12,18}})[^\p{{L}}\p{{N}}./-]', 1)) FROM documents
  UNION ALL SELECT doc_id, 'cartao', unnest(regexp_extract_all(' ' || text || ' ', '[^\p{{L}}\p{{N}}./-]([2-6]\d{{3}} \d{{4}} \d{{4}} \d{{1,7}}|[2-6]\d{{3}}-\d{{4}}-\d{{4}}-\d{{1,7}})[^\p{{L}}\p{{N}}./-]', 1)) FROM documents),
found AS (SELECT doc_id, type, value FROM (SELECT *, regexp_replace(value, '[^0-9]', '', 'g') AS d FROM raw)
          WHERE type = 'email' OR {_LUHN})"""


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return docs.select("doc_id", F.explode(personal.find_sensitive(F.col("text"))).alias("f")).select("doc_id", "f.*")


@query(f"WITH {_FOUND} SELECT doc_id, type, value, count(*) AS n FROM found GROUP BY ALL")
def pii_values(spark, sf_dir):
    return findings(spark, sf_dir).groupBy("doc_id", "type", "value").agg(F.count("*").alias("n"))


@query(f"WITH {_FOUND} SELECT type, count(*) AS n_found, count(DISTINCT value) AS n_values, count(DISTINCT doc_id) AS n_docs FROM found GROUP BY type")
def pii_summary_by_type(spark, sf_dir):
    once = findings(spark, sf_dir).groupBy("type", "value", "doc_id").agg(F.count("*").alias("n"))
    return once.groupBy("type").agg(F.sum("n").alias("n_found"), F.count_distinct("value").alias("n_values"), F.count_distinct("doc_id").alias("n_docs"))


@query(f"WITH {base.TAXPAYERS} SELECT c_custkey, cpf, {base.CPF_OK} AS valid FROM taxpayers")
def cpf_check_digits(spark, sf_dir):
    return base.taxpayers(spark, sf_dir).select("c_custkey", "cpf", personal.valid_cpf(F.col("cpf")).alias("valid"))


#: Bytes of roots whose endings a task tries.
ROOTS_TOGETHER = 1 << 20


def _company(letters: bool):
    root = F.lpad((F.col("s_suppkey") * 104729).cast("string"), 8, "0")
    head = F.concat(F.char(65 + F.col("s_suppkey") % 26), F.substring(root, 2, 7)) if letters else root
    return F.concat(head, F.lit("0001"))


def _company_sql(letters: bool) -> str:
    root = "lpad((s_suppkey * 104729)::VARCHAR, 8, '0')"
    return f"(chr((65 + s_suppkey % 26)::INTEGER) || substr({root}, 2, 7)) || '0001'" if letters else f"{root} || '0001'"


def _companies(spark, sf_dir, letters):
    """Identifiers with both check digits tried: all 100 endings of a root, one of which is right."""
    roots = load(spark, sf_dir, "supplier").select("s_suppkey", _company(letters).alias("root"))
    # a hundred rows come of each, so a small table is work for every core
    tried = dealt(roots, ROOTS_TOGETHER, "s_suppkey").select("s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(99))).alias("e"), "root").select("s_suppkey", F.concat("root", F.lpad(F.col("e").cast("string"), 2, "0")).alias("cnpj"))
    return tried.where(personal.valid_cnpj(F.col("cnpj")))


def _companies_sql(letters: bool) -> str:
    d = lambda i: f"(ascii(substr(r, {i}, 1)) - 48)"
    one = " + ".join(f"{d(i + 1)} * {w}" for i, w in enumerate([5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]))
    two = " + ".join(f"{d(i + 1)} * {w}" for i, w in enumerate([6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]))
    last = lambda s: f"(CASE WHEN ({s}) % 11 < 2 THEN 0 ELSE 11 - ({s}) % 11 END)::VARCHAR"
    return f"SELECT s_suppkey, r || {last(two)} AS cnpj FROM (SELECT s_suppkey, r || {last(one)} AS r FROM (SELECT s_suppkey, {_company_sql(letters)} AS r FROM supplier))"


@query(_companies_sql(False))
def cnpj_check_digits(spark, sf_dir):
    return _companies(spark, sf_dir, False)


@query(_companies_sql(True))
def cnpj_alnum(spark, sf_dir):
    return _companies(spark, sf_dir, True)


@query(
    """SELECT c_custkey, lpad((c_custkey % 100)::VARCHAR, 2, '0') AS area, (c_custkey % 100) // 10 > 0 AND c_custkey % 10 > 0 AS valid,
 lpad((c_custkey * 613 % 100000)::VARCHAR, 5, '0') || '-' || lpad((c_custkey % 1000)::VARCHAR, 3, '0') AS cep FROM customer"""
)
def cep_phone_derived(spark, sf_dir):
    area = F.lpad((F.col("c_custkey") % 100).cast("string"), 2, "0")
    phone = F.concat(F.lit("("), area, F.lit(") 91234-5678"))
    cep = F.concat(F.lpad((F.col("c_custkey") * 613 % 100000).cast("string"), 5, "0"), F.lit("-"), F.lpad((F.col("c_custkey") % 1000).cast("string"), 3, "0"))
    found = F.filter(personal.find_sensitive(F.concat(F.lit("CEP "), cep, F.lit(" e "), phone)), lambda f: f["type"] == "cep")
    return load(spark, sf_dir, "customer").select("c_custkey", area.alias("area"), personal.valid_phone(phone).alias("valid"), found[0]["value"].alias("cep"))


@query(
    f"""WITH {base.TAXPAYERS}, p AS (SELECT c_custkey, {base.CPF_OK} AS ok, cpf FROM taxpayers)
SELECT c_custkey, CASE WHEN ok THEN 'cpf' END AS type, CASE WHEN ok THEN cpf END AS value FROM p"""
)
def pii_priority_overlap(spark, sf_dir):
    found = personal.find_sensitive(F.concat(F.lit("doc "), F.col("cpf"), F.lit(" fim")))
    one = F.get(found, F.lit(0))
    return base.taxpayers(spark, sf_dir).select("c_custkey", one["type"].alias("type"), one["value"].alias("value"))


# --- names and texts ---------------------------------------------------------

_TITLES = ["Comprovante de pagamento BOLETO", "SUBCONTRATO de obra", "NOTA FISCAL 7", "RECIB0 No 12", "Contrato de locação", "Declaração", "EXTRATO", "nada", "CURRICUL0"]


@query(
    """SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN 'boleto' WHEN 2 THEN 'nota-fiscal' WHEN 3 THEN 'recibo' WHEN 4 THEN 'contrato'
 WHEN 5 THEN 'declaracao' WHEN 6 THEN 'extrato' WHEN 8 THEN 'curriculo' END AS type FROM orders"""
)
def doc_type_titles(spark, sf_dir):
    title = F.element_at(F.array(*map(F.lit, _TITLES)), (F.col("o_orderkey") % 9 + 1).cast("int"))
    return load(spark, sf_dir, "orders").select("o_orderkey", names.document_type(title).alias("type"))


@query(
    """SELECT doc_id, coalesce(nullif(regexp_replace(regexp_replace(substr(regexp_replace(regexp_replace(regexp_replace(
 translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^a-z0-9_-]+', '-', 'g'), '-{2,}', '-', 'g'), '^[-_]+|[-_]+$', '', 'g'), 1, 50),
 '-{2,}', '-', 'g'), '^[-_]+|[-_]+$', '', 'g'), ''), 'documento') AS name FROM documents"""
)
def safe_name(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", names.safe_name(F.col("text")).alias("name"))


_FILES = ["IMG_4521.jpg", "contrato.v2.docx", "2026-11-20 10.10.10.png", "scan01.pdf", "Conta de Luz Março.pdf"]


@query("SELECT o_orderkey, [NULL, 'contrato.v2', NULL, NULL, 'Conta de Luz Março'][(o_orderkey % 5 + 1)::INTEGER] AS stem FROM orders")
def file_stem(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, _FILES)), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return load(spark, sf_dir, "orders").select("o_orderkey", names.file_stem(name).alias("stem"))


@query(
    """SELECT o_orderkey, b || strftime(o_orderdate, '-%Y-%m-%d') AS name, CASE WHEN b IS NULL THEN NULL WHEN o_orderkey % 9 IN (1, 7) THEN 'file' ELSE 'content' END AS origin
FROM (SELECT *, coalesce(CASE o_orderkey % 9 WHEN 0 THEN 'boleto' WHEN 2 THEN 'nota-fiscal' WHEN 3 THEN 'recibo' WHEN 4 THEN 'contrato' WHEN 5 THEN 'declaracao' WHEN 6 THEN 'extrato' WHEN 8 THEN 'curriculo' END,
 [NULL, 'contrato-v2', NULL, NULL, 'conta-de-luz-marco'][(o_orderkey % 5 + 1)::INTEGER]) AS b FROM orders)"""
)
def suggest_name(spark, sf_dir):
    title = F.element_at(F.array(*map(F.lit, _TITLES)), (F.col("o_orderkey") % 9 + 1).cast("int"))
    name = F.element_at(F.array(*map(F.lit, _FILES)), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return load(spark, sf_dir, "orders").select("o_orderkey", names.suggest_name(title, name, F.col("o_orderdate")).alias("s")).select("o_orderkey", "s.*")


@query(r"SELECT doc_id, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''))::INTEGER AS n_words FROM documents")
def word_count(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", texts.word_count(F.col("text")).alias("n_words"))


@query(
    r"""SELECT doc_id, len(regexp_extract_all(substr(t, 1, 2000), '_{5,}|\.{8,}|\(\s?\)|\[\s?\]'))::INTEGER AS blanks,
 regexp_matches(substr(t, 1, 2000), '(?i)\b(formul[aá]rio|ficha)\b') AS form_word
FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'Ficha: _____ [ ] ' ELSE '' END || text AS t FROM documents)"""
)
def looks_like_form(spark, sf_dir):
    t = F.concat(F.when(F.col("doc_id") % 4 == 0, "Ficha: _____ [ ] ").otherwise(""), F.col("text"))
    return load(spark, sf_dir, "documents").select("doc_id", texts.form_blanks(t).alias("blanks"), texts.has_form_word(t).alias("form_word"))


@query(
    """SELECT n_nationkey, o.o_orderkey, chr((65 + (n - 1) % 26)::INTEGER) AS letter, repeat(chr((65 + (n - 1) % 26)::INTEGER), ceil(n / 26.0)::INTEGER) AS letters
FROM (SELECT *, o_orderkey % 120 + 1 AS n FROM orders) o JOIN nation ON o.o_orderkey % 25 = n_nationkey"""
)
def list_letters(spark, sf_dir):
    o = load(spark, sf_dir, "orders").withColumn("n", F.col("o_orderkey") % 120 + 1)
    joined = o.join(load(spark, sf_dir, "nation"), F.col("o_orderkey") % 25 == F.col("n_nationkey"))
    return joined.select("n_nationkey", "o_orderkey", F.char(65 + (F.col("n") - 1) % 26).alias("letter"), texts.letters(F.col("n")).alias("letters"))


_R = lambda s: "[" + ", ".join(f"'{x}'" for x in s) + "]"
_ONES = _R(["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"])
_TENS = _R(["", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"])
_HUNS = _R(["", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"])


@query(f"SELECT c_custkey, repeat('M', (n // 1000)::INTEGER) || {_HUNS}[(n // 100 % 10 + 1)::INTEGER] || {_TENS}[(n // 10 % 10 + 1)::INTEGER] || {_ONES}[(n % 10 + 1)::INTEGER] AS numeral FROM (SELECT c_custkey, c_custkey % 3999 + 1 AS n FROM customer)")
def roman_numerals(spark, sf_dir):
    return load(spark, sf_dir, "customer").select("c_custkey", texts.roman(F.col("c_custkey") % 3999 + 1).alias("numeral"))


@query("SELECT doc_id, CASE WHEN n < 1048576 THEN greatest(1, round(n / 1024))::BIGINT::VARCHAR || ' KB' ELSE printf('%.1f MB', round(n / 1048576.0::DOUBLE, 1)) END AS size FROM (SELECT doc_id, n_chars * (doc_id % 1000 + 1) AS n FROM documents)")
def format_bytes(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", texts.format_bytes(F.col("n_chars") * (F.col("doc_id") % 1000 + 1)).alias("size"))


@query("SELECT o_orderkey, ['A4', 'A4', 'Letter', NULL, 'A5'][(o_orderkey % 5 + 1)::INTEGER] AS paper FROM orders")
def paper_name(spark, sf_dir):
    at = (F.col("o_orderkey") % 5 + 1).cast("int")
    width = F.element_at(F.array(*map(F.lit, [595.0, 842.0, 612.0, 400.0, 420.0])), at)
    height = F.element_at(F.array(*map(F.lit, [842.0, 595.0, 792.0, 400.0, 595.0])), at)
    return load(spark, sf_dir, "orders").select("o_orderkey", texts.paper_name(width, height).alias("paper"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size * 20.0::DOUBLE WHEN 1 THEN p_size * 1440.0::DOUBLE WHEN 2 THEN p_size * 240.0::DOUBLE ELSE p_size::DOUBLE END AS twips FROM part")
def unit_twips(spark, sf_dir):
    unit = F.element_at(F.array(*map(F.lit, ["pt", "in", "pc", ""])), (F.col("p_partkey") % 4 + 1).cast("int"))
    return load(spark, sf_dir, "part").select("p_partkey", texts.twips(F.concat(F.col("p_size").cast("string"), unit)).alias("twips"))


@query("SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256 FROM documents")
def md5_sha2_text(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256"))


_CRC32 = """WITH t AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, [1::BIGINT, 2, 3, 4, 5, 6, 7, 8]), lambda c, u: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
b AS (SELECT doc_id, hex(encode(text)) AS h FROM documents), l AS (SELECT doc_id, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) AS l FROM b)
SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, l), lambda a, x: xor(a >> 8, t[xor(a & 255, x) + 1])), 4294967295::BIGINT) AS crc32 FROM l, t"""


@query(_CRC32)
def crc32_text(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.crc32("text").alias("crc32"))


_CRC = """list_reduce(list_prepend(65535::BIGINT, list_transform(string_split({0}, ''), lambda c: (ascii(c) << 8)::BIGINT)), lambda crc, v:
 list_reduce(list_prepend(xor(crc, v), [1::BIGINT, 2, 3, 4, 5, 6, 7, 8]), lambda c, u: CASE WHEN (c & 32768) <> 0 THEN xor(c << 1, 4129) & 65535 ELSE (c << 1) & 65535 END))"""


@query(f"SELECT c_custkey, lpad(upper(to_hex({_CRC.format('c_name')})), 4, '0') AS crc FROM customer")
def crc16_text(spark, sf_dir):
    return load(spark, sf_dir, "customer").select("c_custkey", texts.crc16(F.col("c_name")).alias("crc"))


@query(
    f"""SELECT c_custkey, p || lpad(upper(to_hex({_CRC.format('p')})), 4, '0') AS code FROM (
 SELECT c_custkey, '000201' || '26' || lpad((22 + length(k))::VARCHAR, 2, '0') || '0014BR.GOV.BCB.PIX01' || lpad(length(k)::VARCHAR, 2, '0') || k || '5204000053039865802BR59'
 || lpad(length(c_name)::VARCHAR, 2, '0') || c_name || '6006CUIABA62070503***6304' AS p FROM (SELECT c_custkey, c_name, 'k' || c_custkey AS k FROM customer))"""
)
def pix_payload(spark, sf_dir):
    key = F.concat(F.lit("k"), F.col("c_custkey").cast("string"))
    return load(spark, sf_dir, "customer").select("c_custkey", texts.payment_code(key, F.col("c_name"), F.lit("CUIABA")).alias("code"))


# --- amounts -----------------------------------------------------------------

_BR = "replace(replace(replace(printf('%,.2f', v), ',', '_'), '.', ','), '_', '.')"


@query(f"SELECT o_orderkey, printf('%,.2f', v) AS us, {_BR} AS br, CASE WHEN o_orderkey % 2 = 1 THEN '(R$ ' || {_BR} || ')' ELSE 'R$ ' || {_BR} END AS money FROM (SELECT o_orderkey, o_totalprice::DECIMAL(18,2)::DOUBLE AS v FROM orders)")
def format_number_styles(spark, sf_dir):
    plain = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    signed = F.concat(F.when(F.col("o_orderkey") % 2 == 1, "-").otherwise(""), F.replace(plain, F.lit("."), F.lit(",")))
    return load(spark, sf_dir, "orders").select(
        "o_orderkey",
        amounts.format_number(plain, 2, 0)["text"].alias("us"),
        amounts.format_number(plain, 2, 2)["text"].alias("br"),
        amounts.format_number(signed, 2, 2, 2, "R$ ")["text"].alias("money"),
    )


@query("SELECT l_orderkey, l_linenumber, printf('%.2f%%', round(l_discount::DECIMAL(18,4) * 100, 2)::DOUBLE) AS percent FROM lineitem")
def format_percent(spark, sf_dir):
    text = (F.col("l_discount").cast("decimal(18,4)") * 100).cast("decimal(18,2)").cast("string")
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", amounts.format_percent(text, 2, 0)["text"].alias("percent"))


@query(f"WITH {base.TAXPAYERS} SELECT c_custkey, substr(cpf, 1, 3) || '.' || substr(cpf, 4, 3) || '.' || substr(cpf, 7, 3) || '-' || substr(cpf, 10, 2) AS masked FROM taxpayers")
def format_mask_digits(spark, sf_dir):
    return base.taxpayers(spark, sf_dir).select("c_custkey", amounts.fill_mask(F.col("cpf"), "cpf").alias("masked"))


# --- recognised words --------------------------------------------------------


@query(f"WITH {base.WORDS} SELECT page_id, sum(length(text) * confidence)::DOUBLE / sum(length(text))::DOUBLE AS mean, sum(CASE WHEN confidence < 70 THEN length(text) ELSE 0 END)::DOUBLE / sum(length(text))::DOUBLE AS weak FROM words GROUP BY page_id")
def ocr_quality(spark, sf_dir):
    return reading.quality(base.words(spark, sf_dir))


@query(f"WITH {base.WORDS}, q AS (SELECT page_id, sum(length(text) * confidence)::DOUBLE / sum(length(text))::DOUBLE AS mean, sum(CASE WHEN confidence < 70 THEN length(text) ELSE 0 END)::DOUBLE / sum(length(text))::DOUBLE AS weak FROM words GROUP BY page_id) SELECT * FROM q WHERE mean < 82 OR weak > 0.2")
def ocr_low_confidence(spark, sf_dir):
    return reading.low_confidence(base.words(spark, sf_dir))


@query(rf"WITH {base.WORDS} SELECT page_id, count(*) AS n FROM words WHERE NOT (NOT regexp_matches(text, '[\p{{L}}\p{{N}}§&%$@#]') AND confidence < 50) GROUP BY page_id")
def ocr_noise_filter(spark, sf_dir):
    return reading.without_noise(base.words(spark, sf_dir)).groupBy("page_id").agg(F.count("*").alias("n"))


@query(
    f"""WITH {base.WORDS}, g AS (SELECT page_id, word_no % 3 AS reading, sum(CASE WHEN confidence >= 70 THEN length(text) ELSE 0 END)::BIGINT AS good FROM words GROUP BY ALL)
SELECT page_id, reading::INTEGER AS reading, good FROM g QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY good DESC, reading) = 1"""
)
def ocr_best_reading(spark, sf_dir):
    return reading.best_reading(base.words(spark, sf_dir).withColumn("reading", F.col("word_no") % 3))


@query(f"WITH {base.WORDS}, l AS (SELECT page_id, word_no // 8 AS line_no, string_agg(text, ' ' ORDER BY word_no) AS line FROM words GROUP BY ALL) SELECT page_id, string_agg(line, chr(10) ORDER BY line_no) AS text FROM l GROUP BY page_id")
def plain_text_lines(spark, sf_dir):
    return reading.plain_text(base.words(spark, sf_dir))


@query(f"WITH {base.WORDS}, l AS (SELECT page_id, word_no // 8 AS line_no, string_agg(text, ' ' ORDER BY word_no) AS line FROM words GROUP BY ALL) SELECT page_id, string_agg(line, chr(10) ORDER BY line_no) AS text FROM l GROUP BY page_id")
def lines_text(spark, sf_dir):
    w = base.words(spark, sf_dir, True).select("page_id", F.col("word_no").alias("box_no"), F.col("text").alias("str"), "x0", "y0", "x1", "y1", F.lit(600.0).alias("page_width"), F.lit(800.0).alias("page_height"))
    return reading.lines_text(w)


_OVER = "{a}.x0 < {b}.x1 AND {b}.x0 < {a}.x1 AND {a}.y0 < {b}.y1 AND {b}.y0 < {a}.y1"


@query(
    f"""WITH {base.WORDS}, {base.RECTS},
m AS (SELECT *, EXISTS (SELECT 1 FROM rects r WHERE r.page_id = w.page_id AND {_OVER.format(a='w', b='r')}) AS gone FROM words w),
c AS (SELECT *, coalesce(lead(gone) OVER (PARTITION BY page_id ORDER BY word_no), false) AS cut FROM m),
k AS (SELECT *, lead(x0) OVER o AS nx0, lead(y0) OVER o AS ny0, lead(x1) OVER o AS nx1, lead(y1) OVER o AS ny1 FROM c WHERE NOT gone WINDOW o AS (PARTITION BY page_id ORDER BY word_no))
SELECT page_id, word_no::INTEGER AS word_no, text, last OR cut OR (nx0 IS NOT NULL AND EXISTS (SELECT 1 FROM rects r WHERE r.page_id = k.page_id
  AND least(k.x0, nx0) < r.x1 AND r.x0 < greatest(k.x1, nx1) AND least(k.y0, ny0) < r.y1 AND r.y0 < greatest(k.y1, ny1))) AS last FROM k"""
)
def redact_words_anti(spark, sf_dir):
    return redact.drop_words(base.words(spark, sf_dir, True), base.rects(spark, sf_dir))


@query(
    f"""WITH {base.WORDS}, {base.RECTS}
SELECT w.page_id, w.word_no::INTEGER AS box_no, w.text AS str FROM words w JOIN rects r ON w.page_id = r.page_id
 AND least(w.x1, r.x1) - greatest(w.x0, r.x0) > 0.001 AND least(w.y1, r.y1) - greatest(w.y0, r.y0) > (w.y1 - w.y0) * 0.3
GROUP BY ALL HAVING NOT bool_or(coalesce(contains(r.text, w.text), false))"""
)
def redact_leak_check(spark, sf_dir):
    w = base.words(spark, sf_dir).withColumnsRenamed({"word_no": "box_no", "text": "str"})
    return redact.leaks(w, base.rects(spark, sf_dir))


def _word_findings(spark, sf_dir):
    return base.words(spark, sf_dir).where(F.col("text").rlike("@|[0-9]{4}")).select("page_id", "word_no", F.when(F.col("text").contains("@"), "email").otherwise("number").alias("type"), F.col("text").alias("value"), "x0", "y0", "x1", "y1")


_WF = "wf AS (SELECT page_id, word_no, CASE WHEN contains(text, '@') THEN 'email' ELSE 'number' END AS type, text AS value, x0, y0, x1, y1 FROM words WHERE regexp_matches(text, '@|[0-9]{4}'))"


@query(f"WITH {base.WORDS}, {base.RECTS}, {_WF} SELECT page_id, word_no::INTEGER AS word_no, type, value FROM wf WHERE NOT EXISTS (SELECT 1 FROM rects r WHERE r.page_id = wf.page_id AND wf.x0 >= r.x0 AND wf.x1 <= r.x1 AND wf.y0 >= r.y0 AND wf.y1 <= r.y1)")
def redact_skip_contained(spark, sf_dir):
    return redact.new_findings(_word_findings(spark, sf_dir), base.rects(spark, sf_dir)).select("page_id", "word_no", "type", "value")


@query(f"WITH {base.WORDS}, {_WF} SELECT page_id, type, value, count(*) AS n_rects, string_agg(round(y0 * 1000)::BIGINT || ':' || round(x0 * 1000)::BIGINT, ',' ORDER BY y0, x0) AS rects, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM wf GROUP BY ALL")
def redact_group_rects(spark, sf_dir):
    whole = lambda c: F.round(c * 1000).cast("bigint").cast("string")
    listed = F.array_join(F.transform("rects", lambda r: F.concat_ws(":", whole(r["y0"]), whole(r["x0"]))), ",")
    return redact.grouped_findings(_word_findings(spark, sf_dir)).withColumn("rects", listed)


@query(
    f"""WITH {base.WORDS}, f AS (SELECT * FROM words WHERE text LIKE '%.'),
j AS (SELECT f.page_id, f.word_no AS field_no, p.text, p.word_no, (p.y0 + p.y1) / 2 > f.y0 AND (p.y0 + p.y1) / 2 < f.y1 AND p.x1 <= f.x0 AND f.x0 - p.x1 <= 0.25 AS isleft, f.x0 - p.x1 AS dx, f.y0 - p.y1 AS dy,
 p.y1 <= f.y0 AND f.y0 - p.y1 <= 0.25 AND p.x0 < f.x1 AND f.x0 < p.x1 AS isabove FROM f JOIN words p USING (page_id))
SELECT page_id, field_no::INTEGER AS field_no, arg_min(text, [CASE WHEN isleft THEN 0 ELSE 1 END, CASE WHEN isleft THEN dx ELSE dy END, word_no]) AS label FROM j WHERE isleft OR isabove GROUP BY ALL"""
)
def nearest_label(spark, sf_dir):
    w = base.words(spark, sf_dir)
    return reading.nearest_label(w.where("text LIKE '%.'").withColumnRenamed("word_no", "field_no"), w.withColumnsRenamed({"word_no": "piece_no", "text": "str"}))


# --- rectangles --------------------------------------------------------------


def _boxes(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderkey", *[((F.col("o_orderkey") * m % 997) / 900.0).alias(c) for c, m in (("x0", 7), ("y0", 13), ("x1", 29), ("y1", 31))])
    return o.select("o_orderkey", boxes.box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("r"))


_BOXES = "b AS (SELECT o_orderkey, " + ", ".join(f"(o_orderkey * {m} % 997)::DOUBLE / 900.0::DOUBLE AS {c}" for c, m in (("x0", 7), ("y0", 13), ("x1", 29), ("y1", 31))) + " FROM orders)"
_NORM = "n AS (SELECT o_orderkey, least(1.0, greatest(0.0, least(x0, x1))) AS x0, least(1.0, greatest(0.0, least(y0, y1))) AS y0, least(1.0, greatest(0.0, greatest(x0, x1))) AS x1, least(1.0, greatest(0.0, greatest(y0, y1))) AS y1 FROM b)"
_FITS = "x1 - x0 >= 0.005 AND y1 - y0 >= 0.005"


@query(f"WITH {_BOXES}, {_NORM} SELECT o_orderkey, x0, y0, x1, y1 FROM n WHERE {_FITS}")
def rect_normalize(spark, sf_dir):
    return _boxes(spark, sf_dir).select("o_orderkey", boxes.normalize(F.col("r")).alias("r")).where("r IS NOT NULL").select("o_orderkey", "r.*")


@query(
    f"""WITH {_BOXES}, {_NORM} SELECT o_orderkey, CASE o_orderkey % 4 WHEN 1 THEN 1 - y1 WHEN 2 THEN 1 - x1 WHEN 3 THEN y0 ELSE x0 END AS x0, CASE o_orderkey % 4 WHEN 1 THEN x0 WHEN 2 THEN 1 - y1 WHEN 3 THEN 1 - x1 ELSE y0 END AS y0,
 CASE o_orderkey % 4 WHEN 1 THEN 1 - y0 WHEN 2 THEN 1 - x0 WHEN 3 THEN y1 ELSE x1 END AS x1, CASE o_orderkey % 4 WHEN 1 THEN x1 WHEN 2 THEN 1 - y0 WHEN 3 THEN 1 - x0 ELSE y1 END AS y1 FROM n WHERE {_FITS}"""
)
def rect_rotate(spark, sf_dir):
    r = _boxes(spark, sf_dir).select("o_orderkey", boxes.normalize(F.col("r")).alias("r")).where("r IS NOT NULL")
    return r.select("o_orderkey", boxes.rotate(F.col("r"), F.col("o_orderkey") % 4 * 90).alias("r")).select("o_orderkey", "r.*")


@query(
    f"""WITH {_BOXES}, {_NORM} SELECT o_orderkey, greatest(0.0, x0 - (y1 - y0) * 0.15::DOUBLE * 800.0::DOUBLE / 600.0::DOUBLE) AS x0, greatest(0.0, y0 - (y1 - y0) * 0.15::DOUBLE) AS y0,
 least(1.0, x1 + (y1 - y0) * 0.15::DOUBLE * 800.0::DOUBLE / 600.0::DOUBLE) AS x1, least(1.0, y1 + (y1 - y0) * 0.15::DOUBLE) AS y1 FROM n WHERE {_FITS}"""
)
def rect_pad(spark, sf_dir):
    r = _boxes(spark, sf_dir).select("o_orderkey", boxes.normalize(F.col("r")).alias("r")).where("r IS NOT NULL")
    return r.select("o_orderkey", boxes.pad(F.col("r"), F.lit(600.0), F.lit(800.0)).alias("r")).select("o_orderkey", "r.*")


_SCALE = "least((pw - 40.0::DOUBLE) / w, (ph - 40.0::DOUBLE) / h)"


@query(
    f"""SELECT o_orderkey, pw AS width, ph AS height, (pw - w * {_SCALE}) / 2 AS x, (ph - h * {_SCALE}) / 2 AS y, w * {_SCALE} AS w, h * {_SCALE} AS h
FROM (SELECT *, CASE WHEN w > h THEN 841.89 ELSE 595.28 END::DOUBLE AS pw, CASE WHEN w > h THEN 595.28 ELSE 841.89 END::DOUBLE AS ph
 FROM (SELECT o_orderkey, (o_orderkey % 3000 + 100)::DOUBLE AS w, (o_orderkey * 7 % 3000 + 100)::DOUBLE AS h FROM orders))"""
)
def layout_page(spark, sf_dir):
    key = F.col("o_orderkey")
    made = boxes.layout_page((key % 3000 + 100).cast("double"), (key * 7 % 3000 + 100).cast("double"), "a4", 20.0)
    return load(spark, sf_dir, "orders").select("o_orderkey", made.alias("p")).select("o_orderkey", "p.*")


@query("SELECT p_partkey, CASE WHEN p_size >= 8 AND p_partkey % 8 >= 4 AND p_partkey % 5 >= 3 THEN 2 ELSE 1 END AS readers, least(greatest(round(p_size * 60.0), 70), 2400)::INTEGER AS dpi FROM part")
def reading_plan(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    return p.select("p_partkey", texts.reader_count(F.col("p_size"), F.col("p_partkey") % 8, F.col("p_partkey") % 5).alias("readers"), texts.dpi_hint(F.col("p_size") * 60.0).alias("dpi"))


# --- pages -------------------------------------------------------------------


def _requests(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 9 + 3).cast("int").alias("total"))
    kinds = ["1-3, 2", "2-", " 2 ; 3 ", "9-2, x", "1 a 2", "0", "3 to 99", ""]
    return docs.withColumn("ranges", F.element_at(F.array(*map(F.lit, kinds)), (F.col("doc_id") % 8 + 1).cast("int")))


def _pages(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), (F.col("doc_id") % 9 + 2).cast("int"))).alias("page_no"))


_FILES_SQL = """d AS (SELECT doc_id, doc_id % 8 AS k, doc_id % 9 + 3 AS total FROM documents),
g AS (SELECT doc_id, 0 AS file_no, 1 AS a, 3 AS b FROM d WHERE k = 0 UNION ALL SELECT doc_id, 1, 2, 2 FROM d WHERE k = 0 UNION ALL SELECT doc_id, 0, 2, total FROM d WHERE k = 1
 UNION ALL SELECT doc_id, 0, 2, 2 FROM d WHERE k = 2 UNION ALL SELECT doc_id, 1, 3, 3 FROM d WHERE k = 2 UNION ALL SELECT doc_id, 0, 1, 2 FROM d WHERE k = 4),
files AS (SELECT doc_id, file_no, a, b, unnest(range(0, b - a + 1)) AS position FROM g)"""


@query(
    """SELECT doc_id, CASE k WHEN 3 THEN CASE WHEN total < 9 THEN 'beyond:9' ELSE 'reversed:9-2' END || '|syntax:x' WHEN 5 THEN 'below-1' WHEN 6 THEN 'beyond:99' WHEN 7 THEN 'empty' ELSE '' END AS problems,
 CASE k WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 4 THEN 1 ELSE 0 END AS n_groups FROM (SELECT doc_id, doc_id % 8 AS k, doc_id % 9 + 3 AS total FROM documents)"""
)
def parse_ranges(spark, sf_dir):
    p = _requests(spark, sf_dir).select("doc_id", pages.parse_ranges(F.col("ranges"), F.col("total")).alias("p"))
    return p.select("doc_id", F.array_join("p.problems", "|").alias("problems"), F.coalesce(F.size("p.groups"), F.lit(0)).alias("n_groups")).withColumn("n_groups", F.greatest("n_groups", F.lit(0)))


@query(f"WITH {_FILES_SQL} SELECT doc_id, file_no, position::INTEGER AS position, (a - 1 + position)::INTEGER AS page_no FROM files")
def split_pages(spark, sf_dir):
    return pages.split_pages(_requests(spark, sf_dir), _pages(spark, sf_dir)).select("doc_id", "file_no", "position", "page_no")


@query("SELECT doc_id % 10 AS out_id, doc_id AS file_no, page_no::INTEGER AS page_no, (row_number() OVER (PARTITION BY doc_id % 10 ORDER BY doc_id, page_no) - 1)::INTEGER AS position FROM (SELECT doc_id, unnest(range(0, doc_id % 9 + 3)) AS page_no FROM documents)")
def merge_pages(spark, sf_dir):
    p = _pages(spark, sf_dir).select((F.col("doc_id") % 10).alias("out_id"), F.col("doc_id").alias("file_no"), "page_no")
    return pages.merge_pages(p)


@query("SELECT file_no, position::INTEGER AS position, n::INTEGER AS n, total, n || ' de ' || total AS label FROM (SELECT *, row_number() OVER (PARTITION BY file_no ORDER BY position) AS n, count(*) OVER (PARTITION BY file_no) AS total FROM (SELECT doc_id AS file_no, unnest(range(0, doc_id % 9 + 3)) AS position FROM documents))")
def page_numbering(spark, sf_dir):
    return pages.number_pages(_pages(spark, sf_dir).select(F.col("doc_id").alias("file_no"), F.col("page_no").alias("position")))


@query(
    """SELECT doc_id, 'a-b-c-' || lpad(first::VARCHAR, length(total::VARCHAR)::INTEGER, '0') || CASE WHEN last <> first THEN '-' || lpad(last::VARCHAR, length(total::VARCHAR)::INTEGER, '0') ELSE '' END AS name
FROM (SELECT doc_id, doc_id % 7 + 1 AS first, doc_id % 7 + 1 + doc_id % 2 AS last, 9 + doc_id % 2 AS total FROM documents)"""
)
def output_names(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    return d.select("doc_id", pages.output_name(F.lit("a/b:c.pdf"), F.col("doc_id") % 7 + 1, F.col("doc_id") % 7 + 1 + F.col("doc_id") % 2, 9 + F.col("doc_id") % 2).alias("name"))


@query("SELECT l_orderkey AS doc_id, l_partkey % 5 AS num, max(l_linenumber) AS revision, max(l_suppkey) AS \"offset\" FROM lineitem l WHERE l_linenumber = (SELECT max(l_linenumber) FROM lineitem m WHERE m.l_orderkey = l.l_orderkey AND m.l_partkey % 5 = l.l_partkey % 5) GROUP BY ALL")
def xref_newest_wins(spark, sf_dir):
    e = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_partkey") % 5).alias("num"), F.col("l_linenumber").alias("revision"), F.col("l_suppkey").alias("offset"))
    return pages.newest_objects(e)


@query("SELECT user_id, event_id, last_value(CASE WHEN event_id % 5 = 0 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS header FROM events")
def header_inheritance(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_id") % 5 == 0, F.col("event_type")).alias("header"))
    return pages.carried(e, "user_id", "event_id", "header")


# --- detector states ---------------------------------------------------------


def _frames(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    ms = F.col("event_id").cast("bigint") * 400
    return e.select((F.col("user_id") % 20).cast("string").alias("device"), ms.alias("ts_ms"), (F.floor(F.col("event_id") / 97) % 2 == 0).alias("found"), F.lit(None).cast("bigint").alias("busy_until"), (F.col("event_id") * 31 % 200).cast("double").alias("brightness"))


_FRAMES = "f AS (SELECT (user_id % 20)::VARCHAR AS device, event_id * 400 AS ts_ms, event_id // 97 % 2 = 0 AS found, (event_id * 31 % 200)::DOUBLE AS brightness FROM events)"


@query(
    f"""WITH RECURSIVE {_FRAMES}, n AS (SELECT *, row_number() OVER (PARTITION BY device ORDER BY ts_ms, found) AS i FROM f),
s(device, i, ts_ms, announced, pending, since, last_at, said) AS (
 SELECT DISTINCT device, 0::BIGINT, 0::BIGINT, NULL::BOOLEAN, NULL::BOOLEAN, 0::BIGINT, (-1000000000000)::BIGINT, false FROM n
 UNION ALL SELECT device, i, ts_ms, CASE WHEN quiet THEN announced ELSE pending END, pending, since, CASE WHEN quiet THEN last_at ELSE ts_ms END, NOT quiet FROM (
  SELECT *, pending IS NOT DISTINCT FROM announced OR ts_ms - since < 1000 OR ts_ms - last_at < 2500 AS quiet FROM (
   SELECT n.device, n.i, n.ts_ms, s.announced, n.found AS pending, CASE WHEN n.found IS DISTINCT FROM s.pending THEN n.ts_ms ELSE s.since END AS since, s.last_at FROM s JOIN n ON n.device = s.device AND n.i = s.i + 1)))
SELECT device, ts_ms, announced FROM s WHERE said"""
)
def paper_announcement(spark, sf_dir):
    return paper.announce(_frames(spark, sf_dir))




@query(f"WITH {_FRAMES} SELECT device, ts_ms, coalesce(last_value(CASE WHEN brightness < 60 THEN true WHEN brightness >= 80 THEN false END IGNORE NULLS) OVER (PARTITION BY device ORDER BY ts_ms ROWS UNBOUNDED PRECEDING), false) AS dark FROM f")
def light_hysteresis(spark, sf_dir):
    return paper.light_warning(_frames(spark, sf_dir)).select("device", "ts_ms", "dark")


@query(f"WITH {_FRAMES} SELECT device, ts_ms, bool_or(found) OVER (PARTITION BY device ORDER BY ts_ms ROWS 2 PRECEDING) AS steady FROM f")
def miss_tolerance(spark, sf_dir):
    return paper.tolerant_found(_frames(spark, sf_dir)).select("device", "ts_ms", "steady")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 > 0 THEN o_totalprice::DOUBLE / (o_orderkey % 10) * (20 - o_orderkey % 10) END AS left_ms FROM orders")
def remaining_time(spark, sf_dir):
    return load(spark, sf_dir, "orders").select("o_orderkey", texts.remaining_ms(F.col("o_totalprice").cast("double"), F.col("o_orderkey") % 10, F.lit(20)).alias("left_ms"))


# --- images ------------------------------------------------------------------


def _grey(spark, sf_dir):
    """Embeddings as small grey images: image_id, and one value a pixel."""
    v = F.transform("embedding", lambda x: F.least(F.greatest(F.floor((x.cast("double") + 1) * 128), F.lit(0)), F.lit(255)).cast("int"))
    return load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), v.alias("grey"))


_GREY = "p AS (SELECT vec_id AS image_id, unnest(list_transform(embedding, lambda x: least(greatest(floor((x::DOUBLE + 1) * 128), 0), 255)::INTEGER)) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)"


@query(
    f"""WITH {_GREY}, h AS (SELECT image_id, v, count(*) AS n FROM p GROUP BY ALL),
c AS (SELECT image_id, v, sum(n) OVER o AS nb, sum(v * n) OVER o AS sb, sum(n) OVER (PARTITION BY image_id) AS nt, sum(v * n) OVER (PARTITION BY image_id) AS st FROM h WINDOW o AS (PARTITION BY image_id ORDER BY v)),
s AS (SELECT image_id, v, nb::DOUBLE * (nt - nb)::DOUBLE * (sb::DOUBLE / nb - (st - sb)::DOUBLE / (nt - nb)) * (sb::DOUBLE / nb - (st - sb)::DOUBLE / (nt - nb)) AS score FROM c WHERE nt > nb)
SELECT image_id, v AS threshold FROM s QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY score DESC, v) = 1"""
)
def otsu_threshold(spark, sf_dir):
    h = _grey(spark, sf_dir).select("image_id", F.explode("grey").alias("v")).groupBy("image_id", "v").agg(F.count("*").alias("n"))
    own = Window.partitionBy("image_id")
    below = own.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    c = h.select("image_id", "v", F.sum("n").over(below).alias("nb"), F.sum(F.col("v") * F.col("n")).over(below).alias("sb"), F.sum("n").over(own).alias("nt"), F.sum(F.col("v") * F.col("n")).over(own).alias("st")).where("nt > nb")
    apart = F.col("sb") / F.col("nb") - (F.col("st") - F.col("sb")) / (F.col("nt") - F.col("nb"))
    score = F.col("nb").cast("double") * (F.col("nt") - F.col("nb")).cast("double") * apart * apart
    return c.groupBy("image_id").agg(F.max_by("v", F.struct(score, -F.col("v"))).alias("threshold"))


@query(f"WITH {_GREY} SELECT image_id, i::INTEGER AS i, avg(v) OVER (PARTITION BY image_id, i // 8 ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS mean FROM p")
def box_blur(spark, sf_dir):
    p = _grey(spark, sf_dir).select("image_id", F.posexplode("grey").alias("i", "v"))
    row = Window.partitionBy("image_id", F.floor(F.col("i") / 8)).orderBy("i").rowsBetween(-1, 1)
    return p.select("image_id", "i", F.avg("v").over(row).alias("mean"))


@query(f"WITH {_GREY} SELECT image_id, list_sort(list(v))[(count(*) // 2 + 1)::INTEGER] AS median FROM p GROUP BY image_id")
def median_upper(spark, sf_dir):
    g = F.array_sort("grey")
    return _grey(spark, sf_dir).select("image_id", F.element_at(g, (F.floor(F.size(g) / 2) + 1).cast("int")).alias("median"))


# --- structure ---------------------------------------------------------------


@query(
    """WITH RECURSIVE s AS (SELECT p_partkey AS id, p_partkey // 2 AS up, CASE WHEN p_partkey % 3 = 0 THEN p_size END AS size, CASE WHEN p_partkey % 7 = 0 THEN p_brand END AS font FROM part),
a(id, up, depth, size, font) AS (SELECT id, up, 0, size, font FROM s UNION ALL SELECT a.id, s.up, depth + 1, s.size, s.font FROM a JOIN s ON a.up = s.id WHERE depth < 64)
SELECT id, arg_min(size, depth) FILTER (size IS NOT NULL) AS size, arg_min(font, depth) FILTER (font IS NOT NULL) AS font FROM a GROUP BY id"""
)
def style_inheritance(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    styles = p.select(F.col("p_partkey").alias("id"), F.floor(F.col("p_partkey") / 2).alias("up"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_size")).alias("size"), F.when(F.col("p_partkey") % 7 == 0, F.col("p_brand")).alias("font"))
    return structure.inherit(styles, "id", "up", ["size", "font"])


@query(
    """WITH RECURSIVE refs AS (SELECT c_nationkey AS doc_id, c_custkey AS src, c_custkey * 7 % 1000 + 1 AS dst FROM customer UNION ALL SELECT c_nationkey, c_custkey, c_custkey + 25 FROM customer),
r(doc_id, num) AS (SELECT c_nationkey, c_custkey FROM customer WHERE c_custkey % 100 = 0 UNION SELECT refs.doc_id, dst FROM r JOIN refs ON r.doc_id = refs.doc_id AND r.num = refs.src)
SELECT doc_id, num FROM r"""
)
def reachable_objects(spark, sf_dir):
    c = load(spark, sf_dir, "customer")
    refs = c.select(F.col("c_nationkey").alias("doc_id"), F.col("c_custkey").alias("src"), F.explode(F.array(F.col("c_custkey") * 7 % 1000 + 1, F.col("c_custkey") + 25)).alias("dst"))
    return pages.reachable(c.where("c_custkey % 100 = 0").select(F.col("c_nationkey").alias("doc_id"), F.col("c_custkey").alias("num")), refs)


@query(
    """WITH f AS (SELECT p_partkey % 10 AS doc_id, p_brand || '.' || p_partkey AS name, p_brand AS b FROM part)
SELECT doc_id, name FROM f WHERE CASE doc_id % 3 WHEN 0 THEN true WHEN 1 THEN b IN ('Brand#11', 'Brand#12', 'Brand#21') ELSE b NOT IN ('Brand#11', 'Brand#12', 'Brand#21') END"""
)
def locked_fields(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    fields = p.select((F.col("p_partkey") % 10).alias("doc_id"), F.concat_ws(".", "p_brand", F.col("p_partkey").cast("string")).alias("name"))
    action = F.element_at(F.array(*map(F.lit, ["All", "Include", "Exclude"])), (F.col("id") % 3 + 1).cast("int"))
    rules = spark.range(10).select(F.col("id").alias("doc_id"), action.alias("action"), F.array(*map(F.lit, ["Brand#11", "Brand#12", "Brand#21"])).alias("names"))
    return structure.locked_fields(fields, rules)


@query(
    f"""WITH {base.WORDS}, p AS (SELECT page_id, word_no AS point_no, x1 + 0.001::DOUBLE AS x, y0 + 0.001::DOUBLE AS y FROM words WHERE text LIKE '%,'),
d AS (SELECT p.page_id, p.point_no, w.word_no, greatest(w.x0 - p.x, p.x - w.x1, 0.0) AS dx, greatest(w.y0 - p.y, p.y - w.y1, 0.0) AS dy, w.y1 - w.y0 AS h FROM p JOIN words w USING (page_id))
SELECT page_id, point_no::INTEGER AS point_no, arg_min(word_no, [dx * dx + dy * dy, word_no])::INTEGER AS box_no FROM d WHERE greatest(dx, dy) <= 0.35::DOUBLE * h GROUP BY ALL"""
)
def target_at_point(spark, sf_dir):
    w = base.words(spark, sf_dir)
    points = w.where("text LIKE '%,'").select("page_id", F.col("word_no").alias("point_no"), (F.col("x1") + 0.001).alias("x"), (F.col("y0") + 0.001).alias("y"))
    return structure.target_at(points, w.withColumnRenamed("word_no", "box_no"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS shown, strftime(o_orderdate, '%Y-%m-%d') AS read FROM orders")
def form_dates(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    typed = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "d.M.yyyy")).otherwise(F.date_format("o_orderdate", "ddMMyyyy"))
    return o.select("o_orderkey", dates.print_date(F.col("o_orderdate"), "dd/mm/yyyy").alias("shown"), F.date_format(dates.read_date(typed), "yyyy-MM-dd").alias("read"))


@query(
    f"""WITH {base.WORDS}, lines AS (SELECT page_id * 1000000 + word_no // 8 AS doc_id, string_agg(text, ' ' ORDER BY word_no) AS text FROM words GROUP BY ALL), {_FOUND.replace("FROM documents", "FROM lines")}
SELECT doc_id // 1000000 AS page_id, (doc_id % 1000000)::INTEGER AS line_no, type, value, count(*) AS n FROM found GROUP BY ALL"""
)
def find_in_pieces(spark, sf_dir):
    n = F.length("text")
    xs = F.transform(F.sequence(F.lit(0), n), lambda i: F.col("x0") + (F.col("x1") - F.col("x0")) * i / n)
    pieces = base.words(spark, sf_dir, True).select("page_id", F.col("text").alias("str"), xs.alias("xs"), "y0", "y1", F.lit(None).cast("int").alias("line"), F.lit(600.0).alias("width"), F.lit(800.0).alias("height"))
    return structure.find_in_pieces(pieces).groupBy("page_id", "line_no", "type", "value").agg(F.count("*").alias("n"))


from . import contents, drawings, files, forms, geometry, inputs, layout, marks, records, trees  # noqa: E402, F401  they add their queries


def queries() -> dict:
    return {name: f for name, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
