"""Queries over the text and markup passes, on documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from normloom.functions import labels as L
from normloom.functions import text as X
from normloom.operators import runs as U
from normloom.plans.corpus import table
from normloom.plans.registry import query
from normloom.sources import markup as M
from normloom.sources import readers as S

_DASHES = X.DASHES


@query(f"SELECT doc_id, trim(regexp_replace(translate(strip_accents(lower(text)), '{_DASHES}', '{'-' * len(_DASHES)}'), '\\s+', ' ', 'g')) AS norm FROM documents")
def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """normalised texts."""
    return table(spark, sf_dir, "documents").select("doc_id", X.normalize(F.col("text")).alias("norm"))


@query("""SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS squeezed, md5(text) AS digest, replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), 'the', '<b>the</b>') AS bold FROM documents""")
def text_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned texts, digests, emphasis."""
    clean = X.squeeze(X.clean_source(F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", clean.alias("squeezed"), F.md5(F.col("text").cast("binary")).alias("digest"), X.embolden(clean, "the").alias("bold"))


_LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)"


_PARAGRAPHS = f"""WITH {_LINES}, p AS (SELECT *, sum(CASE WHEN trim(line) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS par FROM l),
 j AS (SELECT doc_id, par, string_agg(trim(line), ' ' ORDER BY n) AS raw FROM p WHERE trim(line) <> '' GROUP BY doc_id, par)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY par) - 1 AS pos, raw FROM j"""


@query(_PARAGRAPHS)
def ingest_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of plain texts."""
    return S.paragraphs(table(spark, sf_dir, "documents"))


@query(f"WITH {_LINES} SELECT doc_id, n - 1 AS pos, line AS raw FROM l")
def ingest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A paragraph for each line."""
    return S.listed(table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("lines")))


@query("SELECT doc_id, sentence AS raw, n - 1 AS pos FROM (SELECT doc_id, unnest(x) AS sentence, generate_subscripts(x, 1) AS n FROM (SELECT doc_id, [lang, source] AS x FROM documents))")
def ingest_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct p children of an XML root."""
    xml = F.concat(F.lit("<a><p>"), F.col("lang"), F.lit("</p><p>"), F.col("source"), F.lit("</p><q><p>no</p></q></a>"))
    return S.xml_paragraphs(table(spark, sf_dir, "documents").select("doc_id", xml.alias("xml")))


@query("SELECT doc_id, 0 AS pos, coalesce(text, '') AS raw FROM documents UNION ALL SELECT doc_id, 1, coalesce(lang, '') FROM documents")
def ingest_xml_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as direct p children with inline elements."""
    escaped = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    text = F.coalesce("text", F.lit(""))
    a, b, c, d = (escaped(text.substr(F.lit(at), F.lit(n) if n else F.length(text))) for at, n in ((1, 9), (10, 20), (30, 10), (40, 0)))
    p = F.concat(F.lit("<p>"), a, F.lit("<b>"), b, F.lit("<i>"), c, F.lit("</i></b>"), d, F.lit("</p><p><a href='x'>"), escaped(F.coalesce("lang", F.lit(""))), F.lit("</a></p>"))
    xml = F.concat(F.lit("<a>"), p, F.lit("<q><p>no</p></q></a>"))
    return S.xml_paragraphs(table(spark, sf_dir, "documents").select("doc_id", xml.alias("xml")))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return M.blocks(p.select(F.col("page_id").alias("doc_id"), F.lit(M.HTML).alias("mime"), F.col("html").cast("binary").alias("content")))


@query("""SELECT page_id AS doc_id, len(regexp_extract_all(html, '<li>')) AS n_items, html_title AS heading FROM (
 SELECT page_id, html, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_extract(html, '<h1>(.*?)</h1>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&'), '\\s+', ' ', 'g')) AS html_title FROM pages)""")
def ingest_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of pages; list items, and the block after them and the advert."""
    blocks = _pages(spark, sf_dir)
    linked = F.exists("runs", lambda r: r["href"].isNotNull()) & (F.size("runs") == 1)
    nth = F.row_number().over(W.partitionBy("doc_id", "linked").orderBy("pos"))
    df = blocks.withColumn("linked", linked).withColumn("nth", nth)
    return df.groupBy("doc_id").agg(F.count_if("linked").alias("n_items"), F.max(F.when(~F.col("linked") & (F.col("nth") == 2), F.col("raw"))).alias("heading"))


@query("""SELECT 3 * page_id AS doc_id, true AS has_blocks, 0 AS problems FROM pages UNION ALL SELECT 3 * doc_id + 1, false, 1 FROM documents
UNION ALL SELECT 3 * doc_id + 2, true, 0 FROM documents WHERE regexp_matches(text, '\\S')""")
def ingest_all_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, and every document both as plain text and as an unknown type."""
    pages = table(spark, sf_dir, "pages").select((3 * F.col("page_id")).alias("doc_id"), F.lit(M.HTML).alias("mime"), F.col("html").cast("binary").alias("content"))
    texts = table(spark, sf_dir, "documents")
    odd, plain = (texts.select((3 * F.col("doc_id") + k).alias("doc_id"), F.lit(mime).alias("mime"), F.col("text").cast("binary").alias("content")) for k, mime in ((1, "image/png"), (2, M.TEXT)))
    found = S.documents(pages.unionByName(odd).unionByName(plain))
    return found.groupBy("doc_id").agg((F.count("raw") > 0).alias("has_blocks"), F.count_if(F.col("problem") == 15).alias("problems"))


@query(f"""WITH {_LINES} SELECT doc_id, count(*) AS n, sum(CASE WHEN regexp_matches(line, '[;.:]') THEN 0 ELSE 1 END) AS n_titles, sum(CASE WHEN regexp_matches(lower(line), '("|”|“|'''')\\s*$') THEN 1 ELSE 0 END) AS n_closing,
 sum(CASE WHEN regexp_matches(line, '^\\s*("|“|”|'''')') THEN 1 ELSE 0 END) AS n_opening FROM l GROUP BY doc_id""")
def text_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles, quotes."""
    lines = S.listed(table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("lines"))).withColumn("norm", X.normalize(F.col("raw")))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(X.may_be_title(F.col("raw")).cast("int")).alias("n_titles"), F.sum(X.closes_quote(F.col("norm")).cast("int")).alias("n_closing"), F.sum(X.opens_quote(F.col("norm")).cast("int")).alias("n_opening"))


_RULES = ["# a comment", "/(?i)^the /,article first", "", "!([0-9])[0-9]{3}!, number ", "not a rule", r"|\bidiot\b|,insult", "/open,none"]


@query("SELECT message, count(*) AS n FROM documents, (VALUES ('(?i)^the ', 'article first'), ('[0-9][0-9]{3}', 'number'), ('\\bidiot\\b', 'insult')) AS r(pattern, message) WHERE regexp_matches(text, pattern) GROUP BY message")
def text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule that a text matches."""
    rules = S.rules_of(spark.createDataFrame([(x,) for x in _RULES], "value string"))
    return S.classified(table(spark, sf_dir, "documents").select("text"), rules).groupBy("message").agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n FROM conversations)
SELECT conv_id, n - 1 AS pos, role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY n) AS starts,
 max(CASE WHEN role = 'assistant' THEN n END) OVER (PARTITION BY conv_id ORDER BY n) AS last_assistant FROM t""")
def ordered_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours, positions and running state in ordered documents."""
    w = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    t = table(spark, sf_dir, "conversations").withColumn("n", F.row_number().over(w))
    o = W.partitionBy("conv_id").orderBy("n")
    return t.select("conv_id", (F.col("n") - 1).alias("pos"), (~F.col("role").eqNullSafe(F.lag("role").over(o))).alias("starts"), F.max(F.when(F.col("role") == "assistant", F.col("n"))).over(o).alias("last_assistant"))


@query("""WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n FROM conversations),
 s AS (SELECT *, CASE WHEN role = lag(role) OVER (PARTITION BY conv_id ORDER BY n) THEN 0 ELSE 1 END AS new FROM t), g AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY n) AS g FROM s)
SELECT conv_id, g AS island, role, string_agg(text, ' ' ORDER BY n) AS joined, count(*) AS n FROM g GROUP BY conv_id, g, role""")
def merged_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring rows of one style joined with spaces."""
    w = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    t = table(spark, sf_dir, "conversations").withColumn("n", F.row_number().over(w)).select(F.col("conv_id").alias("doc_id"), F.col("n").alias("pos"), "role", "text")
    return U.join_islands(t, "role", "text").select(F.col("doc_id").alias("conv_id"), "island", "role", "joined", "n")


@query("""SELECT doc_id, substr(text, 1, 40) AS head, substr(text, 41) AS tail, CASE WHEN length(text) > 0 THEN 1 ELSE 0 END AS n_runs FROM documents""")
def split_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Styled runs split at a character and merged again."""
    d = table(spark, sf_dir, "documents")
    runs = F.array(*(U.run(F.col("text").substr(F.lit(a), F.lit(n) if n else F.length("text"))) for a, n in ((1, 15), (16, 30), (46, 0))))
    df = d.select("doc_id", U.merge(runs).alias("runs"))
    return df.select("doc_id", U.text(U.cut_right(F.col("runs"), F.lit(40))).alias("head"), U.text(U.cut_left(F.col("runs"), F.lit(40))).alias("tail"), F.size(U.merge(F.col("runs"))).alias("n_runs"))


@query(f"""WITH {_LINES}, e AS (SELECT doc_id, n, line, lag(line) OVER (PARTITION BY doc_id ORDER BY n) AS prev FROM (SELECT doc_id, n, CASE WHEN n % 3 = 0 OR n % 3 = 1 THEN '' ELSE line END AS line FROM l))
SELECT doc_id, count(*) AS n, count(*) FILTER (line = '') AS n_empty FROM e WHERE NOT (line = '' AND prev IS NOT DISTINCT FROM '') GROUP BY doc_id""")
def collapsed_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of empty paragraphs become one."""
    lines = S.listed(table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("lines"))).withColumn("raw", F.when((F.col("pos") + 1) % 3 == 2, F.col("raw")).otherwise(""))
    return U.collapse_empty(lines).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("raw") == "").alias("n_empty"))


@query(f"WITH {_LINES} SELECT doc_id, bool_or(contains(line, 'the ')) AS any_, min(CASE WHEN contains(line, 'the ') THEN n - 1 END) AS first_pos FROM l GROUP BY doc_id")
def block_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Existence and first match over the blocks of every document, of which some match."""
    lines = S.listed(table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("lines")))
    return U.exists_first(lines, F.col("raw").contains("the "))


@query("SELECT doc_id, count(*) FILTER (regexp_matches(lower(line), '^[0-9]')) AS n_items FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id")
def text_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.6: lines of documents that start with a digit are items, as the grammar has it."""
    lines = S.listed(table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("lines")))
    kind = L.parse(X.normalize(F.col("raw")))["label"]["kind"]
    return lines.groupBy("doc_id").agg(F.count_if((kind == "item") | ((kind == "letter") & X.normalize(F.col("raw")).rlike("^[0-9]"))).alias("n_items"))


@query(_PARAGRAPHS)
def incremental_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """7.3 step 10: documents read as a stream of files, each batch's paragraphs appended once."""
    from normloom.streaming.ingest import ingest_once

    return ingest_once(spark, f"{sf_dir}/documents.parquet")
