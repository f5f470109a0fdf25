"""Synthetic norms as expressions over the driver tables: an order is a norm, its line items are articles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from normloom.functions import text as X


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: the lines of every norm that has an article, those of its chapter and of each article in a row, in order.

    Orders and line items are dealt by norm once, before there are any texts.
    """
    c = F.col
    orders = table(spark, sf_dir, "orders").where("o_orderkey is not null").select(c("o_orderkey").alias("doc_id"), F.lit(0).alias("item"), c("o_orderpriority").alias("priority"))
    items = table(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("doc_id"), F.lit(1).alias("item"), c("l_linenumber").alias("n"), c("l_partkey").alias("part"), c("l_suppkey").alias("supplier"), c("l_extendedprice").alias("price"),
        (c("l_quantity").cast("int") % 4).alias("clauses"), c("l_returnflag").alias("flag"),
        (c("l_linestatus") == "O").alias("open"), (F.round(c("l_discount") * 100) >= 8).alias("amended"),
    )
    norm = W.partitionBy("doc_id").orderBy("item", "n", "part", "supplier", "price")
    held = orders.unionByName(items, allowMissingColumns=True).withColumn("held", F.max("item").over(norm.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    chapter = F.concat(F.lit("CAPÍTULO "), X.roman(1 + c("doc_id") % 9)), F.concat(F.lit("DISPOSIÇÕES "), F.translate("priority", "\n", " "))
    article = [
        F.concat(F.lit("Art. "), X.ordinal(c("n")), F.lit(" Fornecer parte "), c("part").cast("string"), F.lit(":")),
        *(F.when(c("clauses") >= k, F.lit(f"{r} – entrega {k};")) for k, r in ((1, "I"), (2, "II"), (3, "III"))),
        F.when(c("open") & (c("clauses") > 0), F.lit("a) aberta;")),
        F.when(c("flag") == "A", F.lit("§ 1º Aceito.")).when(c("flag") == "R", F.lit("Parágrafo único. Recusado.")),
        F.when(c("amended"), F.lit("“Art. 9º Nova redação.” (NR)")),
    ]
    return held.where("held = 1").select("doc_id", F.when(c("item") == 0, F.concat_ws("\n", *chapter)).otherwise(F.concat_ws("\n", *article)).alias("text"))


#: The same articles in SQL.
ARTICLES_SQL = """
articles AS (
  SELECT l_orderkey AS doc_id,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq,
         l_linenumber AS n, l_partkey AS part, CAST(l_quantity AS INT) % 4 AS clauses, l_returnflag AS flag,
         l_linestatus = 'O' AS open, round(l_discount * 100) >= 8 AS amended
  FROM lineitem)"""

#: Nodes as they must come out, from the articles and not by reading lines.
NODES_SQL = (
    "WITH "
    + ARTICLES_SQL
    + """,
roman AS (SELECT * FROM (VALUES (1, 'I'), (2, 'II'), (3, 'III'), (4, 'IV'), (5, 'V'), (6, 'VI'), (7, 'VII'), (8, 'VIII'), (9, 'IX')) AS t(i, r)),
norms AS (SELECT o_orderkey AS doc_id, o_orderpriority AS priority FROM orders WHERE o_orderkey IN (SELECT doc_id FROM articles)),
own AS (
  SELECT *, 'art' || n AS a,
         CASE WHEN flag = 'A' THEN 'art' || n || '_par1' WHEN flag = 'R' THEN 'art' || n || '_par1u'
              WHEN open AND clauses > 0 THEN 'art' || n || '_cpt_inc' || clauses || '_ali1'
              WHEN clauses > 0 THEN 'art' || n || '_cpt_inc' || clauses ELSE 'art' || n || '_cpt' END AS last_id,
         CASE WHEN flag IN ('A', 'R') THEN 120 WHEN open AND clauses > 0 THEN 140 WHEN clauses > 0 THEN 130 ELSE 120 END AS last_level
  FROM articles),
nodes AS (
  SELECT doc_id, 0 AS seq, 0 AS sub, 'chapter' AS kind, 50 AS level, CAST(1 + doc_id % 9 AS INT) AS num, false AS is_unique, CAST(NULL AS INT) AS parent_level,
         'cap' || (1 + doc_id % 9) AS id, '' AS content, 'DISPOSIÇÕES ' || priority AS name, 0 AS ctx FROM norms
  UNION ALL SELECT doc_id, seq, 0, 'article', 110, n, false, 50, a, '', NULL, 0 FROM own
  UNION ALL SELECT doc_id, seq, 1, 'paragraph', 120, NULL, false, 110, a || '_cpt', 'Fornecer parte ' || part || ':', NULL, 0 FROM own
  UNION ALL SELECT doc_id, seq, 1 + i, 'clause', 130, i, false, 120, a || '_cpt_inc' || i, 'entrega ' || i || ';', NULL, 0
            FROM own, (VALUES (1), (2), (3)) AS t(i) WHERE i <= clauses
  UNION ALL SELECT doc_id, seq, 50, 'letter', 140, 1, false, 130, a || '_cpt_inc' || clauses || '_ali1', 'aberta;', NULL, 0 FROM own WHERE open AND clauses > 0
  UNION ALL SELECT doc_id, seq, 60, 'paragraph', 120, 1, flag = 'R', 110, a || CASE flag WHEN 'R' THEN '_par1u' ELSE '_par1' END,
            CASE flag WHEN 'R' THEN 'Recusado.' ELSE 'Aceito.' END, NULL, 0 FROM own WHERE flag IN ('A', 'R')
  UNION ALL SELECT doc_id, seq, 70, 'amendment', 1000, 1, false, last_level, last_id || '_alt1', '', NULL, 0 FROM own WHERE amended
  UNION ALL SELECT doc_id, seq, 71, 'article', 110, 9, false, 1000, last_id || '_alt1_art9', '', NULL, 1 FROM own WHERE amended
  UNION ALL SELECT doc_id, seq, 72, 'paragraph', 120, NULL, false, 110, last_id || '_alt1_art9_cpt', 'Nova redação.', NULL, 1 FROM own WHERE amended)
"""
)


def varied_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: a norm for each order with what the articles above never have.

    Parts, unsorted clauses, generic provisions, titles, amendments of several
    lines with omitted text, omissions and stray paragraphs, some only in some.
    """
    k = F.col("doc_id")
    line = lambda text, where=None: F.when(F.lit(True) if where is None else where, text if not isinstance(text, str) else F.lit(text))
    lines_ = [
        line("PARTE GERAL", k % 2 == 0), line(F.concat(F.lit("Art. 1º Texto "), k.cast("string"), F.lit(":"))), line("II – segundo;"), line("I – primeiro;"), line("Multa - leve;"), line("Multa - grave."),
        line("Do prazo"), line("Art. 2º O art. 5º muda:"), line("“Art. 5º Novo texto,"), line("continua aqui:"), line("I – ....."), line("II – fim.” (NR)"), line("...", k % 3 == 0),
        line("Art. 3º Fim."), line("Solto. Fim.", k % 5 == 0), line("§ 1º Depois."),
    ]
    return norms(spark, sf_dir).select(k, F.concat_ws("\n", *lines_).alias("text"))


def norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id of each order, dealt evenly before there are texts: bare keys are small, so without a number few tasks would get all."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")


#: The nodes of these norms written out: where each is, and its values.
VARIED_SQL = """WITH v(n, held, kind, level, num, above, id, content, name, title, ctx, omitted, note) AS (VALUES
  (1, 'part', 'part', 10, 1, NULL, 'prt1', '', 'GERAL', NULL, 0, false, NULL),
  (2, 'all', 'article', 110, 1, 10, 'art1', '', NULL, NULL, 0, false, NULL),
  (3, 'all', 'paragraph', 120, NULL, 110, 'art1_cpt', 'Texto', NULL, NULL, 0, false, NULL),
  (4, 'all', 'clause', 130, 2, 120, 'art1_cpt_inc2', 'segundo;', NULL, NULL, 0, false, NULL),
  (5, 'all', 'clause', 130, 1, 120, 'art1_cpt_inc1', 'primeiro;', NULL, NULL, 0, false, NULL),
  (6, 'all', 'generic', 160, 1, 130, 'art1_cpt_inc1_dpg1', 'leve;', 'Multa', NULL, 0, false, NULL),
  (7, 'all', 'generic', 160, 2, 130, 'art1_cpt_inc1_dpg2', 'grave.', 'Multa', NULL, 0, false, NULL),
  (8, 'all', 'article', 110, 2, 10, 'art2', '', NULL, 'Do prazo', 0, false, NULL),
  (9, 'all', 'paragraph', 120, NULL, 110, 'art2_cpt', 'O art. 5º muda:', NULL, NULL, 0, false, NULL),
  (10, 'all', 'amendment', 1000, 1, 120, 'art2_cpt_alt1', '', NULL, NULL, 0, false, NULL),
  (11, 'all', 'article', 110, 5, 1000, 'art2_cpt_alt1_art5', '', NULL, NULL, 1, false, NULL),
  (12, 'all', 'paragraph', 120, NULL, 110, 'art2_cpt_alt1_art5_cpt', 'Novo texto, continua aqui:', NULL, NULL, 1, false, NULL),
  (13, 'all', 'clause', 130, 1, 120, 'art2_cpt_alt1_art5_cpt_inc1', '....', NULL, NULL, 1, true, NULL),
  (14, 'all', 'clause', 130, 2, 120, 'art2_cpt_alt1_art5_cpt_inc2', 'fim.', NULL, NULL, 1, false, 'NR'),
  (15, 'omission', 'omission', NULL, NULL, 110, 'art2_omi1', '...', NULL, NULL, 0, true, NULL),
  (16, 'all', 'article', 110, 3, 10, 'art3', '', NULL, NULL, 0, false, NULL),
  (17, 'all', 'paragraph', 120, NULL, 110, 'art3_cpt', 'Fim.', NULL, NULL, 0, false, NULL),
  (18, 'stray', 'paragraph', NULL, NULL, NULL, NULL, 'Solto. Fim.', NULL, NULL, 0, false, NULL),
  (19, 'all', 'paragraph', 120, 1, 110, 'art3_par1', 'Depois.', NULL, NULL, 0, false, NULL)),
o AS (SELECT o_orderkey AS k FROM orders),
nodes AS (
  SELECT k AS doc_id, n, kind, CAST(level AS INT) AS level, CAST(num AS INT) AS num,
         CAST(CASE WHEN above = 10 AND k % 2 <> 0 OR n = 19 AND k % 5 = 0 THEN NULL ELSE above END AS INT) AS parent_level,
         CASE WHEN n = 19 AND k % 5 = 0 THEN 'par1' ELSE id END AS id, CASE WHEN n = 3 THEN 'Texto ' || k || ':' ELSE content END AS content, name, title, CAST(ctx AS INT) AS ctx, omitted, note
  FROM o, v WHERE CASE held WHEN 'part' THEN k % 2 = 0 WHEN 'omission' THEN k % 3 = 0 WHEN 'stray' THEN k % 5 = 0 ELSE true END)
"""
