"""Queries over identifiers of norms, headings and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normloom.functions import norms as N
from normloom.functions import text as X
from normloom.operators import outline as O
from normloom.operators import render as R
from normloom.operators import segment as S
from normloom.plans.corpus import table
from normloom.plans.registry import query
from normloom.sources import profiles as P


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("date"), "o_orderpriority", "o_custkey")
    norm = N.render_id(F.year("date"), F.col("date"), F.col("o_orderkey"), F.when(F.col("o_orderkey") % 5 == 0, 1), F.lit(None).cast("string"))
    return o.withColumn("urn", F.concat(N.urn(F.lit("br"), F.lit("federal"), F.lit("lei"), norm), F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit("!art"), (F.col("o_custkey") % 20 + 1).cast("string"), F.lit("_par2"))).otherwise(F.lit(""))))


_URN_SQL = """urns AS (SELECT o_orderkey, o_orderdate AS d, o_custkey % 20 + 1 AS a, 'urn:lex:br:federal:lei:' || strftime(o_orderdate, '%Y-%m-%d') || ';' || o_orderkey || CASE WHEN o_orderkey % 5 = 0 THEN '-1' ELSE '' END AS base FROM orders)"""


@query(f"""WITH {_URN_SQL} SELECT o_orderkey, base || CASE WHEN o_orderkey % 3 > 0 THEN '!art' || a || '_par2' ELSE '' END AS urn, base, CAST(year(d) AS INT) AS year, CAST(month(d) AS INT) AS month, CAST(day(d) AS INT) AS day,
 CASE WHEN o_orderkey % 3 > 0 THEN 'art' || a || '_par2' END AS fragment, CASE WHEN o_orderkey % 3 > 0 THEN 'par' END AS last_part, CASE WHEN o_orderkey % 3 > 0 THEN 'art' END AS first_part FROM urns""")
def fn_urns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """urns written and read."""
    df = _orders(spark, sf_dir).withColumn("u", N.urn_parts(F.col("urn")))
    f = F.col("u.fragment")
    return df.select("o_orderkey", "urn", "u.base", "u.year", "u.month", "u.day", f.alias("fragment"), N.last_component(f).alias("last_part"), N.first_component(f).alias("first_part"))


@query(f"""WITH {_URN_SQL} SELECT o_orderkey, CAST(year(d) AS INT) AS year, CAST(d AS DATE) AS date, CAST(o_orderkey AS INT) AS number, CASE WHEN o_orderkey % 5 = 0 THEN 1 END AS comp,
 'Nº ' || replace(format('{{:,}}', o_orderkey), ',', '.') || CASE WHEN o_orderkey % 5 = 0 THEN '-B' ELSE '' END || ', DE ' || upper(day(d) || ' de ' || list_extract(['{"','".join(X.MONTHS)}'], CAST(month(d) AS INT)) || ' de ' || year(d)) AS heading FROM urns""")
def fn_norm_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ids of norms read, and as headings have them."""
    df = _orders(spark, sf_dir).withColumn("i", N.norm_id(F.regexp_extract("urn", r":([^:!]*)(?:!|$)", 1)))
    return df.select("o_orderkey", "i.year", "i.date", "i.number", "i.comp", N.heading_id(F.col("i.year"), F.col("i.date"), F.col("i.number"), F.col("i.comp")).alias("heading"))


@query("""SELECT o_orderkey, 'LEI Nº ' || o_orderkey || ' (' || o_orderpriority || ')' AS heading, 'norma ' || o_orderkey || ' de NORMA_ANO, NORMA_X' AS filled,
 strftime(o_orderdate, '%Y-%m-%d') || ';publicacao;' || strftime(o_orderdate, '%Y-%m-%dt%H.%M') AS version, 'lei_' || o_orderkey || '_' || year(o_orderdate) AS folder FROM orders""")
def fn_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions, heading templates, placeholders, folder names."""
    o = table(spark, sf_dir, "orders")
    number = F.col("o_orderkey").cast("string")
    heading = N.fill(F.lit("<head> Nº <id> (<tail>)"), {"head": F.lit("LEI"), "id": number, "tail": F.col("o_orderpriority")})
    filled = N.replace_placeholders(F.lit("norma NORMA_NUMERO de NORMA_ANO, NORMA_X"), {"NUMERO": number, "ANO": F.lit(None).cast("string")})
    version = N.version(F.col("o_orderdate"), F.lit("publicacao"), F.col("o_orderdate"))
    return o.select("o_orderkey", heading.alias("heading"), filled.alias("filled"), version.alias("version"), N.folder_name(F.lit("lei"), F.col("o_orderkey"), F.lit(None), F.year("o_orderdate"), F.lit(None)).alias("folder"))


@query("""SELECT o_orderkey, '<Metadado><Identificacao URN="urn:lex:br:federal:lei:' || year(o_orderdate) || ';' || o_orderkey || '"/></Metadado>' AS metadata,
 '<ParteInicial><Epigrafe>LEI ' || o_orderkey || '</Epigrafe><Ementa>Prioridade &lt;' || o_orderpriority || '&gt;.</Ementa><Preambulo><p>O CONGRESSO NACIONAL decreta, e ' || CASE WHEN o_orderkey % 2 = 0 THEN '<b>A PRESIDENTA DA REPÚBLICA</b>' ELSE '<b>VICE-PRESIDENTE DA REPÚBLICA</b>' END || ' sanciona:</p></Preambulo></ParteInicial>' AS initial,
 '<Proposicao urn="u" md5="' || md5(o_orderpriority) || '" dispositivos="7"><Ementa>x</Ementa><Parte>proposicao.xml</Parte><Parte>texto.xml</Parte></Proposicao>' AS editor FROM orders""")
def render_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and initial part of each norm."""
    o = table(spark, sf_dir, "orders")
    number = F.col("o_orderkey").cast("string")
    urn = N.urn(F.lit("br"), F.lit("federal"), F.lit("lei"), F.concat_ws(";", F.year("o_orderdate").cast("string"), number))
    summary = F.concat(F.lit("Prioridade <"), F.col("o_orderpriority"), F.lit(">."))
    holder = F.when(F.col("o_orderkey") % 2 == 0, "A PRESIDENTA DA REPÚBLICA").otherwise("VICE-PRESIDENTE DA REPÚBLICA")
    preamble = F.concat(F.lit("O CONGRESSO NACIONAL decreta, e "), holder, F.lit(" sanciona:"))
    initial = R.initial_part_xml(F.concat(F.lit("LEI "), number), summary, preamble)
    editor = R.editor_metadata_xml(F.lit("u"), F.lit("x"), F.md5("o_orderpriority"), F.lit(7), F.array(F.lit("proposicao.xml"), F.lit("texto.xml")))
    return o.select("o_orderkey", R.metadata_xml(urn).alias("metadata"), initial.alias("initial"), editor.alias("editor"))


@query("""SELECT o_orderkey, 'LEI ' || o_orderkey AS comment, 'proposicao.xml,texto.xml' AS names,
 '<Metadado><Identificacao URN="' || o_orderkey || '"/></Metadado>' AS metadata, '<p>' || o_orderpriority || ' é</p>' AS body FROM orders""")
def zip_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ZIP of metadata and text of each norm, unpacked again."""
    o = table(spark, sf_dir, "orders")
    number = F.col("o_orderkey").cast("string")
    bundle = R.zip_bundle(R.metadata_xml(number), F.concat(F.lit("<p>"), "o_orderpriority", F.lit(" é</p>")), F.concat(F.lit("LEI "), number))
    z = o.select("o_orderkey", R.unzipped(bundle).alias("z"))
    return z.select("o_orderkey", "z.comment", F.array_join("z.names", ",").alias("names"), F.col("z.texts")[0].alias("metadata"), F.col("z.texts")[1].alias("body"))


#: The built-in profiles written out: authority, then type and what is true of it (h heading optional, s summary optional, d draft, n no text before the heading).
_PROFILE_SQL = """profiles AS (
 SELECT 'br' AS locality, authority, split_part(x, ' ', 1) AS type, contains(split_part(x, ' ', 2), 'h') AS heading_optional, contains(split_part(x, ' ', 2), 's') AS summary_optional,
        contains(split_part(x, ' ', 2), 'd') AS is_draft, NOT contains(split_part(x, ' ', 2), 'n') AS pre_heading_allowed
 FROM (SELECT authority, unnest(string_split(types, ', ')) AS x FROM (VALUES
  ('senado.federal', 'projeto.lei;pls d, projeto.lei;plc hd, proposta.emenda.constitucional;pec d, projeto.resolucao;prs d, projeto.decreto.legislativo;pds hdn, projeto.decreto.legislativo;pdc hd, projeto.decreto.legislativo;pdl hd, projeto.lei.complementar;pls d, projeto.lei.complementar;plc hd, projeto.lei;pl hd, projeto.lei.complementar;plp hd, resolucao, regimento.interno s'),
  ('camara.deputados', 'projeto.decreto.legislativo;pdl hd, projeto.lei;pl hd, projeto.lei.complementar;plp hd, projeto.resolucao hd, resolucao, regimento.interno s'),
  ('congresso.nacional', 'projeto.lei;pln hd, medida.provisoria;mpv d, decreto.legislativo, resolucao, regimento.interno s, projeto.lei.conversao;plv hd'),
  ('federal', 'lei, lei.complementar, lei.delegada, decreto.lei, decreto, decreto.legislativo, emenda.constitucional, emenda.constitucional.revisao s, medida.provisoria, constituicao s, ato.disposicoes.constitucionais.transitorias s')) AS t(authority, types)))"""


@query(f"WITH {_PROFILE_SQL} SELECT * FROM profiles")
def profile_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Built-in profiles and their policies."""
    return P.profiles(spark).select("locality", "authority", "type", "heading_optional", "summary_optional", "is_draft", "pre_heading_allowed")


_KEYS = "['federal', 'senado.federal', 'congresso.nacional', 'camara.deputados', 'nenhum']", "['lei', 'resolucao', 'decreto', 'projeto.lei;pl', 'regimento.interno', 'projeto.lei;pln']"


@query(f"""WITH {_PROFILE_SQL}, docs AS (SELECT o_orderkey, list_extract({_KEYS[0]}, CAST(o_orderkey % 5 AS INT) + 1) AS authority, list_extract({_KEYS[1]}, CAST(o_custkey % 6 AS INT) + 1) AS type FROM orders)
SELECT d.o_orderkey, d.authority, d.type, p.heading_optional, p.is_draft FROM docs d LEFT JOIN profiles p ON p.locality = 'br' AND p.authority = d.authority AND p.type = d.type""")
def profile_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile of each norm's key."""
    pick = lambda names, n: F.element_at(F.array(*(F.lit(x.strip(" '")) for x in names.strip("[]").split(", "))), n.cast("int") + 1)
    docs = table(spark, sf_dir, "orders").select("o_orderkey", F.lit("br").alias("locality"), pick(_KEYS[0], F.col("o_orderkey") % 5).alias("authority"), pick(_KEYS[1], F.col("o_custkey") % 6).alias("type"))
    return P.lookup(docs, P.profiles(spark)).select("o_orderkey", "authority", "type", "heading_optional", "is_draft")


@query(f"""WITH {_PROFILE_SQL}, docs AS (SELECT o_orderkey, CASE o_orderkey % 2 WHEN 0 THEN 'senado.federal' ELSE 'camara.deputados' END AS authority, CASE o_custkey % 3 WHEN 0 THEN 'pl' WHEN 1 THEN 'plp' ELSE 'pls' END AS sigla FROM orders)
SELECT o_orderkey, d.authority, sigla, p.type FROM docs d JOIN profiles p ON p.authority = d.authority AND ends_with(p.type, ';' || sigla)""")
def profile_by_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles by authority and short name."""
    docs = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "senado.federal").otherwise("camara.deputados").alias("authority"), F.when(F.col("o_custkey") % 3 == 0, "pl").when(F.col("o_custkey") % 3 == 1, "plp").otherwise("pls").alias("sigla"))
    return P.lookup_by_suffix(docs, P.profiles(spark)).select("o_orderkey", "authority", "sigla", "type")


@query(f"WITH {_PROFILE_SQL} SELECT o_orderkey, 'urn:lex:br:federal:lei:' || year(o_orderdate) || ';' || o_orderkey AS urn, heading_optional, summary_optional, is_draft FROM orders, profiles WHERE authority = 'federal' AND type = 'lei'")
def profile_by_urn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles by the beginning of a urn."""
    docs = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("urn:lex:br:federal:lei:"), F.year("o_orderdate").cast("string"), F.lit(";"), F.col("o_orderkey").cast("string")).alias("urn"))
    return P.lookup_by_urn(docs, P.profiles(spark)).select("o_orderkey", "urn", "heading_optional", "summary_optional", "is_draft")


@query(f"WITH {_PROFILE_SQL} SELECT authority, count(DISTINCT type) AS n_types, string_agg(DISTINCT type, ',' ORDER BY type) AS types FROM profiles GROUP BY authority")
def profile_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authorities, and the types of each."""
    return P.types_of(P.profiles(spark)).groupBy("authority").agg(F.count("*").alias("n_types"), F.array_join(F.array_sort(F.collect_list("type")), ",").alias("types"))


@query(f"WITH {_PROFILE_SQL} SELECT authority, type, authority = 'federal' AND type = 'lei' OR heading_optional AS heading_optional, summary_optional FROM profiles")
def profile_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON override of one profile, the others as they are, written as JSON and read back."""
    given = spark.createDataFrame([("br", "federal", "lei", '{"heading_optional": true}')], "locality string, authority string, type string, json string")
    text = P.to_json(P.with_overrides(P.profiles(spark), given))
    return text.withColumn("o", P.overrides_from_json(F.col("json"))).select("authority", "type", "o.heading_optional", "o.summary_optional")


@query(f"WITH {_PROFILE_SQL} SELECT count(*) * {len(P.OVERRIDABLE)} AS n_lines, count(*) AS n_keys FROM profiles")
def profile_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for each profile and field."""
    return P.dump(P.profiles(spark)).agg(F.count("*").alias("n_lines"), F.countDistinct("key").alias("n_keys"))


def _bills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a bill for each order, some of its parts missing by its number."""
    k = F.col("o_orderkey")
    line = lambda text, where=None: F.when(F.lit(True) if where is None else where, text)
    lines = F.array(
        line(F.lit("SENADO"), k % 4 == 0), line(F.lit("PROJETO DE LEI DO SENADO"), k % 7 > 0), line(F.concat(F.lit("Nº "), k.cast("string"), F.lit(", DE 1998")), k % 7 > 0),
        line(F.lit("(Do Senador)"), k % 2 == 0), line(F.concat(F.lit("Dispõe sobre "), F.col("o_orderpriority"), F.lit(".")), k % 5 > 0), line(F.lit("O Congresso Nacional decreta:")),
        line(F.lit("Art. 1º Esta Lei entra em vigor."), k % 11 > 0), line(F.lit("Parágrafo único. Salvo."), k % 11 > 0), line(F.lit("Sala das Sessões, hoje."), k % 3 == 0), line(F.lit("JUSTIFICAÇÃO"), k % 3 > 0), line(F.lit("Texto livre.")), line(F.lit("JUSTIFICAÇÃO")),
    )
    return table(spark, sf_dir, "orders").select(k.alias("doc_id"), F.posexplode(F.filter(lines, lambda x: x.isNotNull())).alias("pos", "raw"))


_BILLS = """b AS (SELECT o_orderkey AS k, o_orderpriority AS p, o_orderkey % 7 > 0 AS h, o_orderkey % 11 > 0 AS a FROM orders)"""


_PARTS = """SELECT k AS doc_id, CASE WHEN h THEN 'PROJETO DE LEI DO SENADO Nº ' || k || ', DE 1998' ELSE '' END AS heading,
 concat_ws(' ', CASE WHEN NOT h AND k % 4 = 0 THEN 'SENADO' END, CASE WHEN k % 5 > 0 THEN 'Dispõe sobre ' || p || '.' END) AS summary,
 CASE WHEN a THEN 'O Congresso Nacional decreta:' ELSE 'O Congresso Nacional decreta:' || CASE WHEN k % 3 = 0 THEN ' Sala das Sessões, hoje.' ELSE ' JUSTIFICAÇÃO' END || ' Texto livre. JUSTIFICAÇÃO' END AS preamble,
 CASE WHEN a THEN 2 ELSE 0 END AS n_body, NOT h AS no_heading, NOT (k % 5 > 0 OR (NOT h AND k % 4 = 0)) AS no_summary, NOT a AS no_body FROM b"""


@query(f"WITH {_BILLS} {_PARTS}")
def segment_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heading, summary and preamble of each bill, and what is missing."""
    profile = P.find("br", "senado.federal", "projeto.lei;pls")
    parts = S.parts(_bills(spark, sf_dir), profile)
    return S.documents(parts, profile).select("doc_id", "heading", "summary", "preamble", "n_body", "no_heading", "no_summary", "no_body")


@query(f"""WITH {_BILLS}, p AS ({_PARTS})
SELECT doc_id, '<Documento><Metadado><Identificacao URN="urn:lex:br:senado.federal:projeto.lei;pls:1998;' || doc_id || '"/></Metadado><ProjetoNorma><Norma><ParteInicial>'
 || CASE WHEN heading <> '' THEN '<Epigrafe>' || heading || '</Epigrafe>' ELSE '' END || CASE WHEN summary <> '' THEN '<Ementa>' || summary || '</Ementa>' ELSE '' END
 || '<Preambulo><p>' || preamble || '</p></Preambulo></ParteInicial><Articulacao>'
 || CASE WHEN n_body > 0 THEN '<Artigo id="art1"><Rotulo>Art. 1º</Rotulo><Caput id="art1_cpt"><p>Esta Lei entra em vigor.</p></Caput><Paragrafo id="art1_par1u"><Rotulo>Parágrafo único.</Rotulo><p>Salvo.</p></Paragrafo></Artigo>' ELSE '' END
 || '</Articulacao></Norma></ProjetoNorma></Documento>' AS xml FROM p""")
def render_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bill as a whole XML document."""
    profile = P.find("br", "senado.federal", "projeto.lei;pls")
    parts = S.parts(_bills(spark, sf_dir), profile)
    whole = S.documents(parts, profile).join(R.bodies(S.body(parts)), "doc_id", "left")
    urn = N.urn(F.lit(profile.locality), F.lit(profile.authority), F.lit(profile.type), F.concat(F.lit("1998;"), F.col("doc_id").cast("string")))
    return whole.select("doc_id", R.document_xml(urn, R.initial_part_xml(F.col("heading"), F.col("summary"), F.col("preamble")), F.col("body")).alias("xml"))


@query(f"""WITH {_BILLS} SELECT part, count(*) AS n FROM (SELECT unnest(list_concat(
 CASE WHEN k % 4 = 0 THEN [CASE WHEN h THEN 'before' ELSE 'summary' END] ELSE [] END, CASE WHEN h THEN ['heading', 'heading'] ELSE [] END, CASE WHEN k % 2 = 0 THEN ['after_heading'] ELSE [] END,
 CASE WHEN k % 5 > 0 THEN ['summary'] ELSE [] END, ['preamble'],
 CASE WHEN NOT a THEN ['preamble', 'preamble', 'preamble'] WHEN k % 3 = 0 THEN ['body', 'body', 'marker', 'place_date', 'marker'] ELSE ['body', 'body', 'marker', 'justification', 'justification'] END)) AS part FROM b) GROUP BY part""")
def segment_all_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each part of every bill, with a body or without."""
    parts = S.parts(_bills(spark, sf_dir), P.find("br", "senado.federal", "projeto.lei;pls"))
    return parts.groupBy("part").agg(F.count("*").alias("n"))
