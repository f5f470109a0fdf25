"""Queries over the outline of the synthetic norms."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normloom.functions.levels import containment, follows, levels, may_be_first
from normloom.operators import matching as M
from normloom.operators import outline as O
from normloom.operators import render as R
from normloom.operators import validate as V
from normloom.plans.corpus import NODES_SQL, VARIED_SQL, lines, norms, table, varied_lines
from normloom.plans.registry import query

_ORD = "row_number() OVER (PARTITION BY doc_id ORDER BY seq, sub)"


def _nodes(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    return O.outline(lines(spark, sf_dir), columns=columns)


@query(NODES_SQL + f"SELECT doc_id, {_ORD} AS ord, kind, level, num, is_unique, parent_level, id, content, name FROM nodes")
def outline_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of every norm with its level, parent level, id and text."""
    return _nodes(spark, sf_dir, ["ord", "kind", "level", "num", "is_unique", "parent_level", "id", "content", "name"])


@query(NODES_SQL + "SELECT kind, ctx > 0 AS quoted, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM nodes GROUP BY ALL")
def outline_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of kinds inside and outside quoted runs."""
    return O.kinds(lines(spark, sf_dir))


@query(
    NODES_SQL
    + """SELECT doc_id, count(*) FILTER (level >= 110) AS provisions, bool_or(kind = 'amendment') AS has_amendment, false AS has_title,
       bool_or(kind = 'penalty') AS has_penalty FROM nodes GROUP BY doc_id"""
)
def outline_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provision count and feature flags of each norm."""
    flags = O.document_features(lines(spark, sf_dir))
    return flags.select("doc_id", "provisions", F.col("amendment").alias("has_amendment"), F.col("title").alias("has_title"), F.col("penalty").alias("has_penalty"))


@query(VARIED_SQL + "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS ord, kind, level, num, parent_level, id, content, name, title, ctx, omitted, note FROM nodes")
def outline_varied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts, generics, titles, omissions, stray text and amendments of several lines."""
    return O.outline(varied_lines(spark, sf_dir), columns=["ord", "kind", "level", "num", "parent_level", "id", "content", "name", "title", "ctx", "omitted", "note"])


@query(
    VARIED_SQL
    + """SELECT doc_id, 2 AS code, 'inverted_order' AS rule, id AS position FROM nodes WHERE n = 5
UNION ALL SELECT doc_id, 4, 'bad_first', id FROM nodes WHERE n = 4 OR n = 19 AND doc_id % 5 = 0
UNION ALL SELECT doc_id, 16, 'stray_text', '' FROM nodes WHERE n = 18
UNION ALL SELECT doc_id, 20, 'omission_outside', id FROM nodes WHERE n = 15"""
)
def validation_varied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that sorted norms never break."""
    return V.problems(varied_lines(spark, sf_dir)).select("doc_id", "code", "rule", "position")


#: Bodies of a norm that break a rule each, by the last digit of its order.
_FAULTS = [
    "Art. 1º Um.\nArtigo único. Dois.", "Art. 1º Um:\n§ 1º a.\nParágrafo único. b.\n§ 3º c.", "Art. 1º Um:\na) b.", "Art. 1º Muda:\n“Art. 2º Um:\na) b.” (NR)",
    "Art. 1º Um.\nArt. 3º Dois.", "Art. 2º Um.\nArt. 1º Dois.", "Art. 1º Um:\nI - a;\na) b;\nj) c;\nl) d.", "Art. 1º Um.\nArt. 1º Dois.", "CAPÍTULO II\nDO PRAZO\nArt. 1º Um.", "Art. 1º Um.\nArt. 1º-A. Dois.\nArt. 2º Três.",
]


@query("""SELECT o_orderkey AS doc_id, unnest(CASE o_orderkey % 10 WHEN 0 THEN ['repeated_label', 'repeated_path', 'discontinuity', 'unique_not_alone'] WHEN 1 THEN ['repeated_label', 'repeated_path', 'discontinuity', 'unique_not_alone']
 WHEN 2 THEN ['bad_position', 'letter_not_under_clause'] WHEN 3 THEN ['letter_not_under_clause'] WHEN 4 THEN ['discontinuity'] WHEN 5 THEN ['inverted_order']
 WHEN 6 THEN ['discontinuity'] WHEN 7 THEN ['repeated_label', 'discontinuity', 'repeated_path'] WHEN 8 THEN ['bad_first'] ELSE []::VARCHAR[] END) AS rule FROM orders""")
def validation_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fault a norm, ten kinds of them."""
    bodies = F.array(*map(F.lit, _FAULTS))
    given = norms(spark, sf_dir).select("doc_id", F.element_at(bodies, (F.col("doc_id") % 10).cast("int") + 1).alias("text"))
    return V.problems(given).select("doc_id", "rule").distinct()


_PAGE = """<p>PROJETO DE LEI DO SENADO</p><p>N&ordm; 5, DE 1998</p><p>Disp&otilde;e sobre x.</p><p>O Congresso Nacional decreta:</p>
<p>CAP&Iacute;TULO I</p><p>DO <b>PRAZO</b></p><p>Art. 1&ordm; Um <b>forte</b> e <i>leve</i>, x<sup>2</sup> &amp; <a href="urn:x">elo</a>:</p><ol><li>primeiro;</li><li>segundo.</li></ol>
<table><tr><td>c1</td><td>c2</td></tr></table><p>Art. 2&ordm; <b>Tudo forte.</b></p><p>Art. 3&ordm; Muda:</p><p>“CAP&Iacute;TULO II</p><p>DO FIM</p><p>Art. 5&ordm; <span style="font-weight: bold">Novo</span> texto.</p><p>Art. 6&ordm; Fim.” (NR)</p>"""


@query("""SELECT page_id AS doc_id, '<Capitulo id="cap1"><Rotulo>CAPÍTULO I</Rotulo><NomeAgrupador>DO <b>PRAZO</b></NomeAgrupador>'
 || '<Artigo id="art1"><Rotulo>Art. 1º</Rotulo><Caput id="art1_cpt"><p>Um <b>forte</b> e <i>leve</i>, x<sup>2</sup> &amp; <span xlink:href="urn:x">elo</span>:</p>'
 || '<Inciso id="art1_cpt_inc1"><Rotulo>I –</Rotulo><p>primeiro;</p></Inciso><Inciso id="art1_cpt_inc2"><Rotulo>II –</Rotulo><p>segundo.</p></Inciso></Caput></Artigo></Capitulo>'
 || '<table><tr><td>c1 c2</td></tr></table>' AS part_one,
 '<Alteracao id="art3_cpt_alt1"><Capitulo id="art3_cpt_alt1_cap2" abreAspas="s"><Rotulo>CAPÍTULO II</Rotulo><NomeAgrupador>DO FIM</NomeAgrupador>'
 || '<Artigo id="art3_cpt_alt1_art5"><Rotulo>Art. 5º</Rotulo><Caput id="art3_cpt_alt1_art5_cpt"><p><b>Novo</b> texto.</p></Caput></Artigo>'
 || '<Artigo id="art3_cpt_alt1_art6"><Rotulo>Art. 6º</Rotulo><Caput id="art3_cpt_alt1_art6_cpt" fechaAspas="s" notaAlteracao="NR"><p>Fim.</p></Caput></Artigo></Capitulo></Alteracao>' AS amended,
 '<Caput id="art2_cpt"><p>Tudo forte.</p></Caput>' AS bold FROM pages""")
def parse_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page with styles, a list, a table and a quoted chapter, to XML."""
    from normloom.operators import segment as S
    from normloom.sources import markup, profiles, readers

    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.lit(markup.HTML).alias("mime"), F.lit(_PAGE).cast("binary").alias("content"))
    parts = S.parts(readers.lines(readers.documents(pages)), profiles.find("br", "senado.federal", "projeto.lei;pls"))
    body = R.xml_body(O.outline(S.body(parts)))
    piece = lambda pattern: F.regexp_extract("body", pattern, 0)
    return body.select("doc_id", piece("^<Capitulo.*</table>").alias("part_one"), piece("<Alteracao.*</Alteracao>").alias("amended"), piece('<Caput id="art2_cpt">.*?</Caput>').alias("bold"))


_PROBLEMS = """,
sib AS (SELECT *, lag(n) OVER (PARTITION BY doc_id ORDER BY seq) AS prev FROM own),
problems AS (
  SELECT doc_id, 5 AS code, 'repeated_label' AS rule, a AS position FROM sib WHERE prev = n
  UNION ALL SELECT doc_id, 4, 'bad_first', id FROM nodes WHERE kind = 'chapter' AND num <> 1
  UNION ALL SELECT doc_id, 3, 'discontinuity', a FROM sib WHERE prev IS NOT NULL AND n <> prev + 1 AND n >= prev
  UNION ALL SELECT doc_id, 7, 'bad_position', last_id || '_alt1' FROM own WHERE amended AND last_level > 120
  UNION ALL SELECT doc_id, 19, 'repeated_path', arg_min(id, seq * 100 + sub) FROM (
            SELECT *, regexp_replace(id, '1u(_|$)', '1\\1') AS k FROM nodes WHERE kind <> 'amendment')
            GROUP BY doc_id, k HAVING count(*) > 1
                 AND NOT (max(ctx) > 0 AND count(*) = 2 AND count(DISTINCT id) = 2 AND max(kind) = 'paragraph'))
"""


@query(NODES_SQL + _PROBLEMS + "SELECT doc_id, code, rule, position FROM problems")
def validation_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule over every norm."""
    return V.problems(lines(spark, sf_dir)).select("doc_id", "code", "rule", "position")


@query(NODES_SQL + _PROBLEMS + "SELECT code, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM problems GROUP BY code")
def validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems by code."""
    return V.problems(lines(spark, sf_dir)).groupBy("code").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


_XML = """,
amend AS (SELECT *, CASE WHEN amended THEN '<Alteracao id="' || last_id || '_alt1"><Artigo id="' || last_id || '_alt1_art9" abreAspas="s"><Rotulo>Art. 9º</Rotulo><Caput id="' || last_id || '_alt1_art9_cpt" fechaAspas="s" notaAlteracao="NR"><p>Nova redação.</p></Caput></Artigo></Alteracao>' ELSE '' END AS alt FROM own),
parts AS (
  SELECT doc_id, seq, a, n, part, flag, alt, last_level, last_id,
         coalesce((SELECT string_agg('<Inciso id="' || a || '_cpt_inc' || i || '"><Rotulo>' || r || ' –</Rotulo><p>entrega ' || i || ';</p>'
                 || CASE WHEN open AND i = clauses THEN '<Alinea id="' || a || '_cpt_inc' || i || '_ali1"><Rotulo>a)</Rotulo><p>aberta;</p>' || CASE WHEN last_level = 140 THEN alt ELSE '' END || '</Alinea>' ELSE '' END
                 || CASE WHEN i = clauses AND last_level = 130 THEN alt ELSE '' END || '</Inciso>', '' ORDER BY i) FROM roman WHERE i <= clauses), '') AS clauses_xml
  FROM amend),
arts AS (
  SELECT doc_id, seq, '<Artigo id="' || a || '"><Rotulo>Art. ' || n || 'º</Rotulo><Caput id="' || a || '_cpt"><p>Fornecer parte ' || part || ':</p>' || clauses_xml
         || CASE WHEN last_id = a || '_cpt' THEN alt ELSE '' END || '</Caput>'
         || CASE flag WHEN 'A' THEN '<Paragrafo id="' || a || '_par1"><Rotulo>§ 1º</Rotulo><p>Aceito.</p>' || alt || '</Paragrafo>'
                      WHEN 'R' THEN '<Paragrafo id="' || a || '_par1u"><Rotulo>Parágrafo único.</Rotulo><p>Recusado.</p>' || alt || '</Paragrafo>' ELSE '' END || '</Artigo>' AS x FROM parts)
SELECT doc_id, '<Capitulo id="cap' || any_value(i) || '"><Rotulo>CAPÍTULO ' || any_value(r) || '</Rotulo><NomeAgrupador>DISPOSIÇÕES ' || any_value(priority) || '</NomeAgrupador>'
       || string_agg(x, '' ORDER BY seq) || '</Capitulo>' AS body
FROM arts JOIN norms USING (doc_id) JOIN roman ON i = 1 + doc_id % 9 GROUP BY doc_id
"""


@query(NODES_SQL + _XML)
def render_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The body of every norm as nested XML."""
    return R.bodies(lines(spark, sf_dir))


_HTML = """,
amend AS (SELECT *, CASE WHEN amended THEN '<div class="amendment" id="' || last_id || '_alt1"><div class="article" id="' || last_id || '_alt1_art9"><p><span class="label">Art. 9º</span> “</p><div class="paragraph" id="' || last_id || '_alt1_art9_cpt"><p>Nova redação.” (NR)</p></div></div></div>' ELSE '' END AS alt FROM own),
parts AS (
  SELECT doc_id, seq, a, n, part, flag, alt, last_level, last_id,
         coalesce((SELECT string_agg('<div class="clause" id="' || a || '_cpt_inc' || i || '"><p><span class="label">' || r || ' –</span> entrega ' || i || ';</p>'
                 || CASE WHEN open AND i = clauses THEN '<div class="letter" id="' || a || '_cpt_inc' || i || '_ali1"><p><span class="label">a)</span> aberta;</p>' || CASE WHEN last_level = 140 THEN alt ELSE '' END || '</div>' ELSE '' END
                 || CASE WHEN i = clauses AND last_level = 130 THEN alt ELSE '' END || '</div>', '' ORDER BY i) FROM roman WHERE i <= clauses), '') AS clauses_html
  FROM amend),
arts AS (
  SELECT doc_id, seq, '<div class="article" id="' || a || '"><span class="label">Art. ' || n || 'º</span> <div class="paragraph" id="' || a || '_cpt"><p>Fornecer parte ' || part || ':</p>' || clauses_html
         || CASE WHEN last_id = a || '_cpt' THEN alt ELSE '' END || '</div>'
         || CASE flag WHEN 'A' THEN '<div class="paragraph" id="' || a || '_par1"><p><span class="label">§ 1º</span> Aceito.</p>' || alt || '</div>'
                      WHEN 'R' THEN '<div class="paragraph" id="' || a || '_par1u"><p><span class="label">Parágrafo único.</span> Recusado.</p>' || alt || '</div>' ELSE '' END || '</div>' AS x FROM parts)
SELECT doc_id, '<div class="chapter" id="cap' || any_value(i) || '"><p><span class="label">CAPÍTULO ' || any_value(r) || '</span> DISPOSIÇÕES ' || any_value(priority) || '</p>'
       || string_agg(x, '' ORDER BY seq) || '</div>' AS body
FROM arts JOIN norms USING (doc_id) JOIN roman ON i = 1 + doc_id % 9 GROUP BY doc_id
"""


@query(NODES_SQL + _HTML)
def render_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The body of every norm as nested HTML."""
    return R.bodies(lines(spark, sf_dir), html=True)


@query(NODES_SQL + "SELECT doc_id, count(*) AS n_nodes, sum(CASE WHEN kind = 'article' THEN 1 ELSE 0 END) AS n_articles FROM nodes GROUP BY doc_id")
def debug_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes as JSON, read back and counted."""
    nodes = R.node_json(lines(spark, sf_dir), {"kind": pa.string()})
    return nodes.groupBy("doc_id").agg(F.count("*").alias("n_nodes"), F.sum(F.when(F.col("kind") == "article", 1).otherwise(0)).alias("n_articles"))


@query(
    NODES_SQL
    + """, shown AS (SELECT doc_id, id, kind, num, is_unique, regexp_extract(id, '^art(\\d+)', 1) AS art, TRY_CAST(regexp_extract(id, '_inc(\\d+)', 1) AS INT) AS inc FROM nodes WHERE ctx = 0)
SELECT doc_id, id, CASE WHEN kind = 'chapter' THEN 'CAPÍTULO ' || (SELECT 'DISPOSIÇÕES ' || priority FROM norms WHERE norms.doc_id = shown.doc_id)
  WHEN kind = 'amendment' THEN 'alteração 1 da ' ELSE '' END
  || CASE WHEN kind = 'chapter' THEN '' ELSE CASE
      WHEN id LIKE '%_par1u%' THEN 'Parágrafo único. do ' WHEN id LIKE '%_par1%' THEN '§ 1º do '
      WHEN id LIKE '%_ali1%' THEN 'a) do ' || (SELECT r FROM roman WHERE i = inc) || ' – do caput do '
      WHEN inc IS NOT NULL THEN (SELECT r FROM roman WHERE i = inc) || ' – do caput do ' WHEN id LIKE '%_cpt%' THEN 'caput do ' ELSE '' END || 'Art. ' || art || 'º' END AS shown FROM shown"""
)
def path_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """paths of all nodes outside of amendments as text, leaf first."""
    return O.path_texts(lines(spark, sf_dir)).where("ctx = 0").select("doc_id", "id", "shown")


#: Up to three cited norms an amendment: the first fits exactly, by prefix or not at all, the others in their own ways.
_CITED = """,
cited AS (
  SELECT doc_id, seq, 'a' AS base, 'art' || (1 + doc_id % 9) AS u FROM own WHERE amended
  UNION ALL SELECT doc_id, seq, 'b', 'art9_cpt_inc2' FROM own WHERE amended AND doc_id % 2 = 0
  UNION ALL SELECT doc_id, seq, 'c', 'cap1_art9' FROM own WHERE amended AND doc_id % 3 = 0),
classed AS (
  SELECT *, CASE base WHEN 'a' THEN CASE WHEN u <> 'art9' THEN 0 WHEN f = 'art9' THEN 10 ELSE 9 END WHEN 'b' THEN 7 ELSE CASE f WHEN 'art9' THEN 8 ELSE 4 END END AS level,
         CASE base WHEN 'c' THEN 'cap1_' ELSE '' END AS complement
  FROM cited, (VALUES ('art9'), ('art9_cpt')) AS t(f)),
chosen AS (SELECT doc_id, seq, CASE WHEN doc_id % 9 = 8 THEN 'a' WHEN doc_id % 3 = 0 THEN 'c' WHEN doc_id % 2 = 0 THEN 'b' ELSE 'a' END AS base FROM own WHERE amended),
best AS (SELECT classed.* FROM classed JOIN chosen USING (doc_id, seq, base))
"""
_BASE_SQL = "CASE base WHEN 'a' THEN 'urn:lex:br:federal:lei:' || (1990 + doc_id % 20) || ';' || (doc_id + 1) WHEN 'b' THEN 'urn:lex:br:federal:lei:2011-05-02;77' ELSE 'urn:lex:br:federal:lei:2012;78' END"


def _cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each amendment of a norm with the one to three references of the provision around."""
    k = F.col("doc_id")
    first = F.concat(F.lit("urn:lex:br:federal:lei:"), (1990 + k % 20).cast("string"), F.lit(";"), (k + 1).cast("string"), F.lit("!art"), (1 + k % 9).cast("string"))
    more = [F.when(k % 2 == 0, F.lit("urn:lex:br:federal:lei:2011-05-02;77!art9_cpt_inc2")), F.when(k % 3 == 0, F.lit("urn:lex:br:federal:lei:2012;78!cap1_art9"))]
    return M.amendment_runs(lines(spark, sf_dir)).where("parent_at is not null").withColumn("links", F.array_compact(F.array(first, *more)))


@query(NODES_SQL + _CITED + "SELECT u AS cited, f AS fragment, level, complement, count(*) AS n FROM classed GROUP BY ALL")
def match_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of each amendment's provision against its fragments, five of the classes."""
    found = M.run_matches(_cited(spark, sf_dir), ["doc_id", "run_parent"])
    return found.groupBy("cited", "fragment", "level", "complement").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT o_orderkey AS k, 'art' || (o_custkey % 7 + 1) AS u FROM orders)
SELECT u AS cited, f AS fragment, CASE c WHEN 'x' THEN 10 WHEN 'p' THEN 9 WHEN 'n' THEN 6 ELSE 0 END AS level,
 CASE WHEN f LIKE 'par%' THEN u || '_' WHEN f LIKE 'inc%' THEN u || '_cpt_' ELSE '' END AS complement, count(*) AS n
FROM p, LATERAL (SELECT unnest([u, u || '_par1', 'par1', 'inc2', 'cap1', 'par1u']) AS f, unnest(['x', 'p', 'n', 'n', 'z', 'n']) AS c) GROUP BY ALL""")
def match_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An article cited, and provisions that fit it exactly, by prefix, as neighbours or not."""
    cited = F.concat(F.lit("art"), (F.col("o_custkey") % 7 + 1).cast("string"))
    fragments = F.array(F.col("cited"), F.concat("cited", F.lit("_par1")), *map(F.lit, ("par1", "inc2", "cap1", "par1u")))
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").select(cited.alias("cited")).select("cited", F.explode(fragments).alias("fragment"))
    return df.withColumn("m", M.classify(F.col("cited"), F.col("fragment"))).groupBy("cited", "fragment", "m.level", "m.complement").agg(F.count("*").alias("n"))


@query(
    NODES_SQL
    + _CITED
    + f"""SELECT doc_id, {_BASE_SQL} AS base, count(DISTINCT seq) AS n_amendments, count(*) FILTER (level = 10) AS n_exact, count(*) FILTER (level = 9) AS n_prefix,
       count(*) FILTER (level = 8) AS n_suffix, count(*) FILTER (level = 7) AS n_superprefix, count(*) FILTER (level = 4) AS n_partial, count(*) FILTER (level = 0) AS n_none FROM best GROUP BY doc_id, base"""
)
def match_best_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of up to three bases of each amendment, with the counts of its classes, summed by norm."""
    keys = ["doc_id", "run_parent"]
    best = M.best_base(M.best_matches(M.run_matches(_cited(spark, sf_dir), keys), keys), keys)
    counts = ("n_exact", "n_prefix", "n_suffix", "n_superprefix", "n_partial", "n_none")
    return best.groupBy("doc_id", "base").agg(F.count("*").alias("n_amendments"), *(F.sum(c).alias(c) for c in counts))


@query(NODES_SQL + _CITED + f"SELECT doc_id, {_BASE_SQL} AS base, f AS own_fragment, complement || f AS full_fragment, count(*) AS n FROM best GROUP BY ALL")
def match_rewritten_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments of amendments under their best base."""
    keys = ["doc_id", "run_parent"]
    full = M.best_rewritten(M.best_matches(M.run_matches(_cited(spark, sf_dir), keys), keys), keys)
    return full.groupBy("doc_id", "base", F.col("fragment").alias("own_fragment"), "full_fragment").agg(F.count("*").alias("n"))


_LEVELS = "(VALUES (10),(20),(30),(40),(50),(60),(70),(80),(110),(120),(130),(140),(150),(160),(1000)) AS t(k)"
_DIRECT = """direct AS (SELECT * FROM (VALUES (10,20),(10,30),(10,50),(10,70),(10,110),(20,30),(20,50),(20,70),(20,110),(30,50),(30,70),(30,110),(30,40),(40,50),(40,70),(40,110),
 (50,60),(50,70),(50,110),(60,70),(60,110),(70,80),(70,110),(80,110),(110,120),(120,130),(120,1000),(120,160),(130,140),(130,160),(140,150),(140,160),(150,160)) AS t(a, b)
 UNION ALL SELECT 1000, k FROM (VALUES (10),(20),(30),(40),(50),(60),(70),(80),(110)) AS t(k))"""


@query(f"WITH RECURSIVE {_DIRECT}, c(a, b) AS (SELECT a, b FROM direct WHERE a <> 1000 UNION SELECT c.a, d.b FROM c JOIN direct d ON c.b = d.a AND d.a <> 1000) SELECT a AS parent_level, b AS child_level, (a, b) IN (SELECT (a, b) FROM direct) AS is_direct FROM (SELECT * FROM c UNION SELECT * FROM direct)")
def level_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1.3: direct and transitive containment of levels."""
    return containment(spark)


@query("""SELECT CAST(kind AS VARCHAR) AS kind, CAST(level AS INT) AS level, prefix, word, label_group, CAST(many AS INT) AS many, in_word, of_word FROM (VALUES
 ('part', 10, 'prt', 'PARTE', 'grouping', 1, 'na', 'da'), ('book', 20, 'liv', 'LIVRO', 'grouping', 1, 'no', 'do'), ('title', 30, 'tit', 'TÍTULO', 'grouping', 1, 'no', 'do'),
 ('subtitle', 40, 'stt', 'SUBTÍTULO', 'grouping', 1, 'no', 'do'), ('chapter', 50, 'cap', 'CAPÍTULO', 'grouping', 1, 'no', 'do'), ('subchapter', 60, 'sct', 'SUB-CAPÍTULO', 'grouping', 1, 'no', 'do'),
 ('section', 70, 'sec', 'Seção', 'grouping', 1, 'na', 'da'), ('subsection', 80, 'sub', 'Subseção', 'grouping', 1, 'na', 'da'), ('article', 110, 'art', 'Art.', 'unit', 1, 'no', 'do'),
 ('paragraph', 120, 'par', '§', 'unit', 2, 'no', 'do'), ('clause', 130, 'inc', 'inciso', 'unit', 0, 'no', 'do'), ('letter', 140, 'ali', 'alínea', 'unit', 0, 'na', 'da'),
 ('item', 150, 'ite', 'item', 'unit', 0, 'no', 'do'), ('penalty', 160, 'pena', 'Pena', 'unit', 0, 'na', 'da'), ('generic', 160, 'dpg', '', 'unit', 0, 'no', 'do'),
 ('amendment', 1000, 'alt', '', 'neither', 0, 'na', 'da')) AS t(kind, level, prefix, word, label_group, many, in_word, of_word)""")
def level_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1.3: the classes of labels."""
    return levels(spark)


@query("""SELECT l_linenumber AS num, CAST(l_quantity AS INT) AS prev, CAST(l_partkey % 3 AS INT) AS comp, k AS level,
  CASE WHEN k IN (10, 20) THEN true WHEN l_partkey % 3 > 0 THEN l_linenumber = CAST(l_quantity AS INT) AND l_partkey % 3 = 1
       ELSE l_linenumber = CAST(l_quantity AS INT) + 1 OR (k = 140 AND l_linenumber = 12 AND CAST(l_quantity AS INT) = 10) END AS follows,
  CASE WHEN k IN (10, 20) THEN l_linenumber = 1 AND l_partkey % 3 = 0 WHEN k IN (110, 160) THEN true WHEN k = 120 THEN false ELSE l_linenumber = 1 AND l_partkey % 3 = 0 END AS first, count(*) AS n
FROM lineitem, (VALUES (10), (50), (110), (120), (130), (140)) AS t(k) GROUP BY ALL""")
def label_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1.3: consecutive labels and first labels, over numbers of line items."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_linenumber").alias("num"), F.col("l_quantity").cast("int").alias("prev"), (F.col("l_partkey") % 3).cast("int").alias("comp"), F.explode(F.array(*map(F.lit, (10, 50, 110, 120, 130, 140)))).alias("level"))
    comp = F.when(F.col("comp") > 0, F.col("comp") - 1)
    none = F.lit(None).cast("int")
    out = items.withColumn("follows", follows(F.col("level"), F.col("num"), comp, F.col("level"), F.col("prev"), none)).withColumn("first", may_be_first(F.col("level"), F.col("num"), comp, F.lit(None).cast("string")))
    return out.groupBy("num", "prev", "comp", "level", "follows", "first").agg(F.count("*").alias("n"))
