"""Numerals, label grammar and identifiers: hand-derived cases and round trips."""

import pytest
from pyspark.sql import functions as F

from normloom.functions import labels as L
from normloom.functions import norms as N
from normloom.functions import text as X
from normloom.functions.levels import LEVELS, closure, direct

CASES = [
    ("Art. 1º Esta Lei dispõe.", "art1", "Art. 1º", "esta lei dispoe."),
    ("Art. 5º-A. O prazo", "art5-1", "Art. 5º-A.", "o prazo"),
    ("Artigo único. Fica aprovado.", "art1u", "Artigo único. ", "fica aprovado."),
    ("Art. 1.234. Texto", "art1234", "Art. 1.234.", "texto"),
    ("Parágrafo único. Texto", "par1u", "Parágrafo único.", "texto"),
    ("§ 10. Texto", "par10", "§ 10.", "texto"),
    ("§ 3º-B Texto", "par3-2", "§ 3º-B.", "texto"),
    ("IV – texto", "inc4", "IV –", "texto"),
    ("I-A - texto", "inc1-1", "I-A –", "texto"),
    ("c) texto", "ali3", "c)", "texto"),
    ("l-A) texto", "ali12-1", "l-A)", "texto"),
    ("1) texto", "ali1", "a)", "texto"),
    ("2001 foi um ano", "ite2001", "2001.", "foi um ano"),
    ("d - texto", "inc500", "D –", "texto"),
    ("Pena – reclusão", "pena", "Pena –", "reclusao"),
    ("Multa - leve", "dpg0", "Multa –", "leve"),
    ("LIVRO III", "liv3", "LIVRO III", ""),
    ("TÍTULO II-A", "tit2-1", "TÍTULO II-A", ""),
    ("Seção Única", "sec1u", "Seção Única", ""),
    ("O presente artigo", None, None, "o presente artigo"),
    ("Mil reais", None, None, "mil reais"),
]


def test_labels(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, t string").withColumn("n", X.normalize(F.col("t"))).withColumn("p", L.parse(F.col("n")))
    c = [F.col(f"p.label.{x}") for x in ("kind", "num", "comp", "is_unique", "name")]
    rows = df.select("t", L.label_id(*c[:4]).alias("id"), L.display(*c).alias("d"), L.rest(F.col("n"), F.col("p")).alias("r")).orderBy("i").collect()
    assert [tuple(r) for r in rows] == CASES


def test_compatible_subchapter(spark):
    df = spark.createDataFrame([("subcapitulo i",)], "n string")
    assert df.select(L.parse(F.col("n"))["label"]["kind"]).first()[0] == "subchapter"
    assert df.select(L.parse(F.col("n"), compatible=True)["label"]["kind"]).first()[0] == "chapter"


def test_numeral_round_trips(spark):
    n = spark.range(1, 4000)
    assert n.where(X.roman_value(X.roman(F.col("id"))) != F.col("id")).count() == 0
    assert spark.range(1, 18279).where(X.letters_value(X.letters(F.col("id"))) != F.col("id")).count() == 0
    assert n.where(X.integer(X.numeral(F.col("id"))) != F.col("id")).count() == 0
    got = spark.range(1).select(X.roman(F.lit(1994)), X.letters(F.lit(27)), X.numeral(F.lit(1000)), X.numeral(F.lit(1001)), X.ordinal_words(F.lit(82)), X.long_date(F.to_date(F.lit("2001-02-03")))).first()
    assert tuple(got) == ("MCMXCIV", "aa", "1000", "1.001", "octogésimo segundo", "3 de fevereiro de 2001")
    assert spark.createDataFrame([("iiii",), ("",), ("vx",)], "t string").where(X.roman_value(F.col("t")).isNotNull()).count() == 0


def test_normalize(spark):
    df = spark.createDataFrame([("  SEÇÃO  –  Ação ",), ("e\u0301 \u00a0 x",), (None,)], "t string")
    assert [r[0] for r in df.select(X.normalize(F.col("t"))).collect()] == ["secao - acao", "e x", None]


@pytest.mark.parametrize("text, closes, note", [("novo texto.” (nr)", True, "nr"), ("x (ac)\"", True, "ac"), ("fim''", True, None), ("fim.", False, None)])
def test_closing(spark, text, closes, note):
    row = spark.createDataFrame([(text,)], "t string").select(X.closes_quote(F.col("t")), X.closing_note(F.col("t"))).first()
    assert tuple(row) == (closes, note)


def test_identifiers(spark):
    urn = "urn:lex:br:federal:lei:2001-02-03;10!art5"
    row = spark.createDataFrame([(urn,)], "u string").select(N.urn_parts(F.col("u")).alias("p")).first().p
    assert (row.base, row.year, row.month, row.day, row.fragment) == ("urn:lex:br:federal:lei:2001-02-03;10", 2001, 2, 3, "art5")
    assert spark.createDataFrame([("nothing",)], "u string").select(N.urn_parts(F.col("u"))).first()[0] is None
    ids = spark.createDataFrame([("1998;1.234-2@v1",), ("2001-02-03;7",), ("x",)], "i string").select(N.norm_id(F.col("i")).alias("n")).collect()
    assert (ids[0].n.year, ids[0].n.number, ids[0].n.comp, ids[0].n.version) == (1998, 1234, 2, "v1")
    assert str(ids[1].n.date) == "2001-02-03" and ids[2].n is None


def test_containment():
    pairs = closure()
    assert direct() <= pairs and (10, 120) in pairs and (50, 150) in pairs and (110, 1000) in pairs
    assert not any(a >= b for a, b in pairs if a != 1000)
    assert len({x.kind for x in LEVELS}) == 16
