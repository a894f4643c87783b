"""Golden values of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from pagelathe.functions import amounts, boxes, names, personal, texts
from pagelathe.operators import pages


def one(spark, make, *values, kinds=None):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kinds or 'string'}")
    return [r[0] for r in rows.orderBy("i").select(make(F.col("v"))).collect()]


def test_check_digits(spark):
    assert one(spark, personal.valid_cpf, "529.982.247-25", "52998224725", "529.982.247-26", "111.111.111-11", None) == [True, True, False, False, False]
    good = ["11.222.333/0001-81", "12.ABC.345/01DE-35"]
    assert one(spark, personal.valid_cnpj, *good, "11.222.333/0001-82", "12.ABC.345/01DE-36", "00.000.000/0000-00") == [True, True, False, False, False]
    assert one(spark, personal.valid_card, "4111 1111 1111 1111", "4111111111111112") == [True, False]
    assert one(spark, personal.valid_phone, "(01) 91234-5678", "(11) 91234-5678", "3333-4444") == [False, True, True]


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("CPF 529.982.247-25 e 52998224725", [("cpf", "529.982.247-25"), ("cpf", "52998224725")]),
        ("código 12ABC34501DE35", []),
        ("(11) 91234-5678, +55 21 3333-4444, 11 98765-4321, 3333-4444 e 91234-5678", [("telefone", x) for x in ("(11) 91234-5678", "+55 21 3333-4444", "11 98765-4321", "3333-4444", "91234-5678")]),
        ("(01) 91234-5678 e (10) 3333-4444", []),
        ("CEP 01310-100, CEP: 01310100 e 01.310-100", [("cep", "01310-100"), ("cep", "01310100"), ("cep", "01.310-100")]),
        ("4111 1111 1111 1111, 5555-5555-5555-4444 e 4111111111111112", [("cartao", "4111 1111 1111 1111"), ("cartao", "5555-5555-5555-4444")]),
        ("fala com joão.x@exemplo.com.br hoje", [("email", "joão.x@exemplo.com.br")]),
        ("", []),
    ],
)
def test_find_sensitive(spark, text, found):
    (got,) = one(spark, personal.find_sensitive, text)
    assert [(g.type, g.value) for g in got] == found
    assert all(text[g.start : g.stop] == g.value for g in got)


def test_names(spark):
    texts_ = ["Comprovante de pagamento ... BOLETO", "SUBCONTRATO de obra", "NOTA\nFISCAL", "RECIB0 N° 12", "RXCIBO", "CONTRATO DE LOCAÇÃO", None]
    assert one(spark, names.document_type, *texts_) == ["boleto", None, "nota-fiscal", "recibo", None, "contrato", None]
    raw = ["Conta de Luz Março", "Ação Çedilha Ñandu", "a--b__c", "-_-nome-_-", "", "a" * 49 + " b"]
    assert one(spark, names.safe_name, *raw) == ["conta-de-luz-marco", "acao-cedilha-nandu", "a-b__c", "nome", "documento", "a" * 49]
    assert one(spark, names.file_stem, "IMG_4521.jpg", "2026-11-20 10.10.10.png", "contrato.v2.docx", None) == [None, None, "contrato.v2", None]


def test_amounts(spark):
    two = lambda style, **k: lambda v: amounts.format_number(v, 2, style, **k)["text"]
    shown = [one(spark, two(s), "1234567,891")[0] for s in range(5)]
    assert shown == ["1,234,567.89", "1234567.89", "1.234.567,89", "1234567,89", "1'234'567.89"]
    money = [one(spark, lambda v, n=n: amounts.format_number(v, 2, 2, n, "R$ "), "-1234,56")[0] for n in range(4)]
    assert [(m.text, m.red) for m in money] == [("-R$ 1.234,56", False), ("R$ 1.234,56", True), ("(R$ 1.234,56)", False), ("(R$ 1.234,56)", True)]
    assert one(spark, two(2), "1.234", "1.5", "9,999", "1,005", "99999999999999999999,995") == ["1.234,00", "1,50", "10,00", "1,01", "100.000.000.000.000.000.000,00"]
    assert one(spark, lambda v: amounts.format_number(v, 2, 2)["ok"], "1e3", "(-1)", "1.23.4", "-0,001") == [False, False, False, True]
    assert one(spark, two(0), "1.234", "1,234,567") == ["1.23", "1,234,567.00"]
    assert one(spark, lambda v: amounts.format_percent(v, 2, 0)["text"], "15,5%") == ["15.50%"]
    assert one(spark, lambda v: amounts.format_percent(v, 0, 0)["text"], "99,5") == ["100%"]
    assert one(spark, lambda v: amounts.fill_mask(v, "cnpj"), "11 222 333 0001 81") == ["11.222.333/0001-81"]
    assert one(spark, lambda v: amounts.fill_mask(v, "phone"), "5551234567", "123") == ["(555) 123-4567", None]


def test_small_texts(spark):
    assert one(spark, texts.crc16, "123456789") == ["29B1"]
    assert one(spark, texts.word_count, "Olá, mundo\nsegunda  linha ", "") == [4, 0]
    assert one(spark, texts.roman, 1, 4, 9, 14, 40, 4000, kinds="int") == ["I", "IV", "IX", "XIV", "XL", "4000"]
    assert one(spark, lambda n: texts.list_number(n, "lowerLetter"), 1, 26, 27, 28, kinds="int") == ["a", "z", "aa", "bb"]
    assert one(spark, lambda n: texts.list_number(n, "decimalZero"), 7, kinds="int") == ["07"]
    (code,) = one(spark, lambda k: texts.payment_code(k, F.lit("Fulano"), F.lit("Cuiaba")), "123e4567-e89b-12d3-a456-426655440000")
    assert code.startswith("00020126") and "0014BR.GOV.BCB.PIX0136" in code


def test_reading_plans(spark):
    rows = spark.createDataFrame([(20000, 2, 10), (5000, 0, 10), (5000, 10, 10)], "e long, d int, t int")
    assert [r[0] for r in rows.select(texts.remaining_ms(F.col("e"), F.col("d"), F.col("t"))).collect()] == [80000.0, None, None]
    devices = spark.createDataFrame([(8, 8, 3), (8, 8, 2), (None, 8, 9)], "m int, c int, p int")
    assert [r[0] for r in devices.select(texts.reader_count(F.col("m"), F.col("c"), F.col("p"))).collect()] == [2, 1, 1]


def test_ranges(spark):
    parse = lambda total: lambda v: pages.parse_ranges(v, F.lit(total))
    get = lambda total, *v: [r.groups for r in one(spark, parse(total), *v)]
    assert get(6, "1-3, 4-5", " 2 ; 6 ", "1 a 2,3–4") == [[[0, 1, 2], [3, 4]], [[1], [5]], [[0, 1], [2, 3]]]
    assert get(6, "5-") == [[[4, 5]]]
    (bad,) = one(spark, parse(3), "9-2, x")
    assert bad.groups is None and len(bad.problems) == 2


def test_boxes(spark):
    row = spark.range(1).select(boxes.normalize(boxes.box(*map(F.lit, (0.8, 0.6, 0.2, 0.4)))).alias("n"), boxes.normalize(boxes.box(*map(F.lit, (0.1, 0.1, 0.101, 0.5)))).alias("none"), boxes.rotate(boxes.box(*map(F.lit, (0.1, 0.2, 0.4, 0.3))), F.lit(90)).alias("r")).first()
    assert tuple(row.n) == (0.2, 0.4, 0.8, 0.6)
    assert row.none is None
    assert tuple(row.r) == pytest.approx((0.7, 0.1, 0.8, 0.4))


def test_size_of_sheets_at_limits(spark):
    """Sides whose depth is the least one that counts, up to rounding, as the formula with determinants has them."""
    from pagelathe.functions import geometry

    part = lambda k, m: (k % m) / 100.0
    corners = lambda k: [(part(k, 7), part(k, 11)), (1 - part(k, 13), part(k, 5)), (1 - part(k, 9), 1 - part(k, 8)), (part(k, 12), 1 - part(k, 6))]
    rows = spark.createDataFrame([(k, [[x * 1200, y * 1600] for x, y in corners(k)]) for k in (92253, 116119)], "k int, q array<array<double>>")
    size = rows.select("k", geometry.quad_size(F.col("q"), F.lit(1200.0), F.lit(1600.0)).alias("s"))
    assert [(round(r.s.width, 4), round(r.s.height, 4)) for r in size.orderBy("k").collect()] == [(1141.7951, 1521.903), (1197.9584, 1536.7498)]
