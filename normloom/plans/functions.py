"""Queries over the scalar functions: numerals, labels, dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normloom.functions import labels as L
from normloom.functions import text as X
from normloom.plans.corpus import table
from normloom.plans.registry import query

_ROMAN_SQL = """list_extract(['','M','MM','MMM','MMMM','MMMMM','MMMMMM','MMMMMMM','MMMMMMMM','MMMMMMMMM'], CAST(n // 1000 AS INT) + 1)
 || list_extract(['','C','CC','CCC','CD','D','DC','DCC','DCCC','CM'], CAST(n // 100 % 10 AS INT) + 1)
 || list_extract(['','X','XX','XXX','XL','L','LX','LXX','LXXX','XC'], CAST(n // 10 % 10 AS INT) + 1)
 || list_extract(['','I','II','III','IV','V','VI','VII','VIII','IX'], CAST(n % 10 AS INT) + 1)"""


@query(f"SELECT DISTINCT n, {_ROMAN_SQL} AS roman, n AS back FROM (SELECT 1 + p_partkey % 3999 AS n FROM part)")
def fn_roman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """roman numerals and back."""
    n = table(spark, sf_dir, "part").select((1 + F.col("p_partkey") % 3999).alias("n")).distinct()
    return n.withColumn("roman", X.roman(F.col("n"))).withColumn("back", X.roman_value(F.col("roman")).cast("long"))


@query("""SELECT DISTINCT n, CASE WHEN n <= 26 THEN chr(CAST(96 + n AS INT)) WHEN n <= 702 THEN chr(CAST(96 + (n - 1) // 26 AS INT)) || chr(CAST(97 + (n - 1) % 26 AS INT))
  ELSE chr(CAST(96 + ((n - 1) // 26 - 1) // 26 AS INT)) || chr(CAST(97 + ((n - 1) // 26 - 1) % 26 AS INT)) || chr(CAST(97 + (n - 1) % 26 AS INT)) END AS letters, n AS back
FROM (SELECT 1 + p_partkey % 18278 AS n FROM part)""")
def fn_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """letter sequences and back."""
    n = table(spark, sf_dir, "part").select((1 + F.col("p_partkey") % 18278).alias("n")).distinct()
    return n.withColumn("letters", X.letters(F.col("n"))).withColumn("back", X.letters_value(F.col("letters")).cast("long"))


@query("""SELECT o_orderkey AS n, CASE WHEN o_orderkey > 1000 THEN replace(format('{:,}', o_orderkey), ',', '.') ELSE CAST(o_orderkey AS VARCHAR) END AS numeral,
 CASE WHEN o_orderkey > 1000 THEN replace(format('{:,}', o_orderkey), ',', '.') ELSE CAST(o_orderkey AS VARCHAR) END || CASE WHEN o_orderkey < 10 THEN 'º' ELSE '' END AS ordinal,
 '-' || chr(CAST(65 + o_orderkey % 26 AS INT)) AS complement, o_orderkey AS back FROM orders""")
def fn_numerals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composed integers, numerals, ordinals, complements."""
    n = F.col("o_orderkey")
    df = table(spark, sf_dir, "orders").select(n.alias("n"), X.numeral(n).alias("numeral"), X.ordinal(n).alias("ordinal"), X.complement(n % 26).alias("complement"))
    return df.withColumn("back", X.integer(F.col("numeral")).cast("long"))


_ORDINALS = "['primeiro','segundo','terceiro','quarto','quinto','sexto','sétimo','oitavo','nono']"
_TENS = "['décimo','vigésimo','trigésimo','quadragésimo','quinquagésimo','sexagésimo','septuagésimo','octogésimo','nonagésimo']"


@query(f"""SELECT n, m AS masculine, upper(regexp_replace(replace(m, ' ', '_ ') || '_', 'o_', 'a', 'g')) AS feminine, CASE WHEN n <= 10 THEN n END AS back
FROM (SELECT n, trim(coalesce(list_extract({_TENS}, CAST(n // 10 AS INT)), '') || ' ' || coalesce(list_extract({_ORDINALS}, CAST(n % 10 AS INT)), '')) AS m FROM (SELECT DISTINCT 1 + p_partkey % 99 AS n FROM part))""")
def fn_ordinal_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ordinals in words and back."""
    n = table(spark, sf_dir, "part").select((1 + F.col("p_partkey") % 99).alias("n")).distinct()
    df = n.select("n", X.ordinal_words(F.col("n")).alias("masculine"), X.ordinal_words(F.col("n"), True, "upper").alias("feminine"))
    return df.withColumn("back", X.ordinal_word_value(X.normalize(F.col("masculine"))).cast("long"))


_LABELS = """labels AS (
  SELECT n, c, text, kind, level, id, shown FROM (SELECT DISTINCT 1 + l_partkey % 40 AS n, l_suppkey % 3 AS c FROM lineitem),
  LATERAL (SELECT """ + _ROMAN_SQL + """ AS r, CASE WHEN n <= 26 THEN chr(CAST(96 + n AS INT)) ELSE 'a' || chr(CAST(96 + n - 26 AS INT)) END AS l,
           CASE WHEN c > 0 THEN '-' || chr(CAST(64 + c AS INT)) ELSE '' END AS s, CASE WHEN c > 0 THEN '-' || c ELSE '' END AS i, CASE WHEN n < 10 THEN n || 'º' ELSE CAST(n AS VARCHAR) END AS o, CASE WHEN n < 10 AND c = 0 THEN '' ELSE '.' END AS d),
  LATERAL (SELECT * FROM (VALUES
    ('Art. ' || o || s || d || ' Texto', 'article', 110, 'art' || n || i, 'Art. ' || o || s || d),
    ('§ ' || o || s || d || ' Texto', 'paragraph', 120, 'par' || n || i, '§ ' || o || s || d),
    (r || s || ' – texto', 'clause', 130, 'inc' || n || i, r || s || ' –'),
    (l || s || ') texto', 'letter', 140, 'ali' || n || i, l || s || ')'),
    (n || s || '. texto', 'item', 150, 'ite' || n || i, n || s || '.'),
    ('TÍTULO ' || r || s, 'title', 30, 'tit' || n || i, 'TÍTULO ' || r || s),
    ('CAPÍTULO ' || r || s, 'chapter', 50, 'cap' || n || i, 'CAPÍTULO ' || r || s),
    ('Seção ' || r || s, 'section', 70, 'sec' || n || i, 'Seção ' || r || s),
    ('LIVRO ' || r || s, 'book', 20, 'liv' || n || i, 'LIVRO ' || r || s)) AS t(text, kind, level, id, shown)))"""


@query(f"WITH {_LABELS} SELECT text, kind, level, n AS num, CASE WHEN c > 0 THEN c - 1 END AS comp, id, shown FROM labels")
def fn_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F02, F08, F09, F14, F15, 2.6: texts of labels parsed, identified and shown again."""
    c, n = F.col("c"), F.col("n")
    base = table(spark, sf_dir, "lineitem").select((1 + F.col("l_partkey") % 40).alias("n"), (F.col("l_suppkey") % 3).alias("c")).distinct()
    comp = X.complement(F.when(c > 0, c - 1))
    stop = F.when((n < 10) & (c == 0), F.lit("")).otherwise(F.lit("."))
    roman, number = F.concat(X.roman(n), comp), F.concat(X.ordinal(n), comp, stop)
    texts = F.array(
        F.concat(F.lit("Art. "), number, F.lit(" Texto")), F.concat(F.lit("§ "), number, F.lit(" Texto")), F.concat(roman, F.lit(" – texto")),
        F.concat(X.letters(n), comp, F.lit(") texto")), F.concat(n.cast("string"), comp, F.lit(". texto")), F.concat(F.lit("TÍTULO "), roman),
        F.concat(F.lit("CAPÍTULO "), roman), F.concat(F.lit("Seção "), roman), F.concat(F.lit("LIVRO "), roman),
    )
    label = L.parse(X.normalize(F.col("text")))["label"]
    df = base.select(F.explode(texts).alias("text")).withColumn("l", label)
    return df.select("text", "l.kind", "l.level", F.col("l.num").cast("long").alias("num"), F.col("l.comp").cast("long").alias("comp"), L.label_id(F.col("l.kind"), F.col("l.num"), F.col("l.comp"), F.col("l.is_unique")).alias("id"), L.display(F.col("l.kind"), F.col("l.num"), F.col("l.comp"), F.col("l.is_unique"), F.col("l.name")).alias("shown"))


#: Texts with their labels, ids and rests, derived by hand (fixed values).
CASES = [
    ("Artigo único. Fica aprovado.", "article", "art1u", "fica aprovado."), ("Art. 1.234. Texto", "article", "art1234", "texto"), ("Parágrafo único. Texto", "paragraph", "par1u", "texto"),
    ("I-A - texto", "clause", "inc1-1", "texto"), ("1) texto", "letter", "ali1", "texto"), ("2001 foi um ano", "item", "ite2001", "foi um ano"), ("d - texto", "clause", "inc500", "texto"),
    ("Pena – reclusão", "penalty", "pena", "reclusao"), ("Multa - leve", "generic", "dpg0", "leve"), ("Seção Única", "section", "sec1u", ""), ("SUBCAPÍTULO I", "subchapter", "sct1", ""),
    ("TÍTULO II-A", "title", "tit2-1", ""), ("O presente artigo", None, None, "o presente artigo"), ("Mil reais", None, None, "mil reais"), ("Parágrafo primeiro. Texto", "paragraph", "par1", "texto"), ("PARTE GERAL", "part", "prt", ""),
]


def _sql_text(x: str | None) -> str:
    return "CAST(NULL AS VARCHAR)" if x is None else "'" + x.replace("'", "''") + "'"


@query("SELECT * FROM (VALUES " + ", ".join(f"({', '.join(map(_sql_text, c))})" for c in CASES) + ") AS t(text, kind, id, rest)")
def fn_label_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.6: the rules of the grammar that numbers alone do not reach."""
    df = spark.createDataFrame([(c[0],) for c in CASES], "text string").withColumn("norm", X.normalize(F.col("text"))).withColumn("p", L.parse(F.col("norm")))
    kind = F.col("p.label.kind")
    return df.select("text", kind.alias("kind"), L.label_id(kind, F.col("p.label.num"), F.col("p.label.comp"), F.col("p.label.is_unique")).alias("id"), L.rest(F.col("norm"), F.col("p")).alias("rest"))


_ELEMENTS = ", ".join(f"('{k}', '{v}')" for k, v in L.ELEMENTS.items())


@query(f"SELECT kind, num, CASE WHEN kind = 'paragraph' THEN CASE WHEN num IS NULL THEN 'Caput' ELSE 'Paragrafo' END ELSE element END AS element FROM (SELECT * FROM (VALUES {_ELEMENTS}, ('paragraph', NULL)) AS t(kind, element)), (VALUES (1), (NULL)) AS u(num)")
def fn_element_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """element names of labels."""
    kinds = spark.createDataFrame([(k, n) for k in [*L.ELEMENTS, "paragraph"] for n in (1, None)], "kind string, num int")
    return kinds.select("kind", "num", L.element_name(F.col("kind"), F.col("num")).alias("element"))


@query("""SELECT level, n, CASE level WHEN 110 THEN 'par' WHEN 120 THEN 'inc' WHEN 130 THEN 'ali' WHEN 140 THEN 'ite' END || n AS id
FROM (SELECT DISTINCT l_linenumber AS n FROM lineitem), (VALUES (110), (120), (130), (140), (150)) AS t(level)""")
def fn_child_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1.3: labels of list elements by position."""
    n = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("n")).distinct().withColumn("level", F.explode(F.array(*map(F.lit, (110, 120, 130, 140, 150))))).withColumn("l", L.child_label(F.col("level"), F.col("n")))
    return n.select("level", "n", L.label_id(F.col("l.kind"), F.col("l.num"), F.col("l.comp"), F.col("l.is_unique")).alias("id"))


_MONTHS = "['" + "','".join(X.MONTHS) + "']"


@query(f"""SELECT o_orderkey, day(o_orderdate) || ' de ' || list_extract({_MONTHS}, CAST(month(o_orderdate) AS INT)) || ' de ' || year(o_orderdate) AS long_date,
 strftime(o_orderdate, '%Y-%m-%d') AS iso, strftime(o_orderdate, '%Y-%m-%dt%H.%M') AS moment, CAST(o_orderdate AS DATE) AS back, date_trunc('minute', o_orderdate) AS moment_back FROM orders""")
def fn_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dates and moments written and read."""
    d = F.col("o_orderdate")
    df = table(spark, sf_dir, "orders").select("o_orderkey", X.long_date(d).alias("long_date"), X.render_date(d).alias("iso"), X.render_timestamp(d).alias("moment"))
    return df.withColumn("back", X.parse_date(F.col("iso"))).withColumn("moment_back", X.parse_timestamp(F.col("moment")))
