"""XML and HTML of outlines: each node gives an opening and a closing event, put in order per document."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructField, StructType

from normloom.functions import labels as L
from normloom.functions import text as X
from normloom.operators import nesting
from normloom.operators import outline as O
from normloom.operators import runs as U


#: Columns of an outline that bodies are made of; with styled lines also runs.
COLUMNS = ["at", "unit", "kind", "level", "num", "comp", "is_unique", "name", "title", "content", "open_quote", "close_quote", "note", "omitted", "id", "parent_id", "leaf", "due"]


def _attribute(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f' {name}="'), X.escape_xml(value), F.lit('"')), F.lit(""))


def _tag(name: str, value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"<{name}>"), X.escape_xml(value), F.lit(f"</{name}>"))).otherwise(F.lit(""))


def shown_label(nodes: DataFrame) -> Column:
    c = F.col
    return F.trim(L.display(c("kind"), c("num"), c("comp"), c("is_unique"), F.when(c("kind").isin("part", "book", "generic") & c("num").isNull(), c("name"))))


def render(nodes: DataFrame, opening: Column, name: Column, element: str | None = None) -> DataFrame:
    """(doc_id, body): the nodes of each document as nested text.

    Each node knows all nodes around it, so the closing tags due before the
    next node are read off the two nodes' ancestries, of any depth, unless an
    outline of COLUMNS lists them; the document is then one ordered
    concatenation.  element: the name of all elements, where they have one.
    """
    tag = lambda x: F.concat(F.lit("</"), F.lit(element) if element else x, F.lit(">"))
    if {"leaf", "due"} <= set(nodes.columns):
        size = F.size("due")
        due_tags = F.repeat(F.lit(f"</{element}>"), size) if element else F.when(size > 0, F.concat(F.lit("</"), F.array_join("due", "></"), F.lit(">"))).otherwise(F.lit(""))
        return _bodies(nodes.select("doc_id", "at", F.concat(opening, F.when(F.col("leaf"), tag(name)).otherwise(F.lit("")), due_tags).alias("piece")))
    around = F.lead("ancestry").over(Window.partitionBy("doc_id").orderBy("at"))
    df = nodes.withColumns({"text_open": opening, "text_name": name, "next_at": F.coalesce(around["at"], F.array().cast("array<int>"))})
    kept = F.size(F.array_intersect("ancestry.at", "next_at"))
    due = F.reverse(F.slice("ancestry", kept + 1, F.size("ancestry") - kept))
    closes = F.concat(tag(F.col("text_name")), F.array_join(F.transform(due, lambda x: tag(x["tag"])), ""))
    pieces = df.withColumn("piece", F.concat("text_open", F.when(F.array_contains("next_at", F.col("at")), F.lit("")).otherwise(closes)))
    return _bodies(pieces)


def _bodies(pieces: DataFrame) -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"])
    return pieces.groupBy("doc_id").agg(F.array_join(ordered, "").alias("body"))


def xml_body(nodes: DataFrame) -> DataFrame:
    """(doc_id, body): nested XML of the outline of each document."""
    c = F.col
    summary = (c("klass") == "summary") if "klass" in nodes.columns else F.lit(False)
    own = F.when(c("unit") == "omission", F.lit("Omissis")).when(c("unit") == "paragraph", F.lit("p")).otherwise(F.coalesce(L.element_name(c("kind"), c("num")), c("unit")))
    name = F.when(summary, F.lit("Ementa")).otherwise(own)
    node_id = F.coalesce(c("override_id"), c("id")) if "override_id" in nodes.columns else c("id")
    node_id = F.when(summary, F.concat("parent_id", F.lit("_ementa"))).otherwise(node_id)
    attributes = F.concat(_attribute("id", node_id), F.when(c("omitted"), F.lit(' textoOmitido="s"')).otherwise(F.lit("")), F.when(c("open_quote"), F.lit(' abreAspas="s"')).otherwise(F.lit("")), F.when(c("close_quote"), F.lit(' fechaAspas="s"')).otherwise(F.lit("")), _attribute("notaAlteracao", F.upper("note")))
    if "base_urn" in nodes.columns:
        attributes = F.concat(attributes, F.when(c("unit") == "amendment", _attribute("xml:base", c("base_urn"))).otherwise(F.lit("")))
    head = F.concat(F.lit("<"), name, attributes, F.lit(">"))
    label = F.when(c("unit") == "provision", _tag("Rotulo", shown_label(nodes))).otherwise(F.lit(""))
    styled = U.content_markup(c("runs")) if "runs" in nodes.columns else F.lit(None).cast("string")
    shown = F.coalesce(F.when(styled != "", styled), X.escape_xml(c("content")))
    heading = F.coalesce(F.when(styled != "", styled), X.escape_xml(c("name")), F.lit(""))
    heading = F.when(heading != "", F.concat(F.lit("<NomeAgrupador>"), heading, F.lit("</NomeAgrupador>"))).otherwise(F.lit(""))
    naming = F.when((c("unit") == "provision") & (c("level") < 110), heading).otherwise(F.lit(""))
    cell = F.concat(F.lit("<tr><td>"), X.escape_xml(c("content")), F.lit("</td></tr>"))
    text = F.when(c("unit") == "paragraph", shown).when(c("unit") == "table", cell).when((c("unit") == "provision") & ~c("omitted"), F.when(c("content") != "", F.concat(F.lit("<p>"), shown, F.lit("</p>"))).otherwise(F.lit(""))).otherwise(F.lit(""))
    opening = F.concat(head, _tag("TituloDispositivo", c("title")), label, naming, text)
    return render(nodes, opening, name)


def html_body(nodes: DataFrame) -> DataFrame:
    """(doc_id, body): nested HTML of the outline of each document."""
    c = F.col
    head = F.concat(F.lit('<div class="'), F.coalesce(c("kind"), c("unit")), F.lit('"'), _attribute("id", c("id")), F.lit(">"))
    label = F.when((c("unit") == "provision") & (shown_label(nodes) != ""), F.concat(F.lit('<span class="label">'), X.escape_xml(shown_label(nodes)), F.lit("</span> "))).otherwise(F.lit(""))
    quoted = F.concat(F.when(c("open_quote"), F.lit("“")).otherwise(F.lit("")), F.coalesce(F.when(c("level") < 110, c("name")).otherwise(c("content")), F.lit("")), F.when(c("close_quote"), F.lit("”")).otherwise(F.lit("")), F.coalesce(F.concat(F.lit(" ("), c("note"), F.lit(")")), F.lit("")))
    title = F.when(c("title").isNotNull(), F.concat(F.lit('<span class="title">'), X.escape_xml(c("title")), F.lit("</span> "))).otherwise(F.lit(""))
    text = F.when(quoted != "", F.concat(F.lit("<p>"), title, label, X.escape_xml(quoted), F.lit("</p>"))).otherwise(F.concat(title, label))
    return render(nodes, F.concat(head, text), F.lit("div"), "div")


def bodies(lines: DataFrame, html: bool = False) -> DataFrame:
    """As xml_body or html_body of the outline of lines, made in the outline's own pass; styled lines by these."""
    if "runs" in lines.columns:
        return (html_body if html else xml_body)(O.outline(lines, columns=[*COLUMNS, "runs"]))
    sink = nesting.HtmlBodies if html else nesting.XmlBodies
    return O.made(lines, sink.TYPES, sink=sink)


def metadata_xml(urn: Column) -> Column:
    return F.concat(F.lit("<Metadado><Identificacao"), _attribute("URN", urn), F.lit("/></Metadado>"))


#: Office holders that a preamble emphasises (a fixed value).
HOLDERS = r"\b([OA] +)?(VICE-)?PRESIDENT[EA] +DA +REP.BLICA\b"


def initial_part_xml(heading: Column, summary: Column, preamble: Column) -> Column:
    emphasised = X.embolden(X.escape_xml(preamble), HOLDERS)
    shown = F.when(F.coalesce(preamble, F.lit("")) != "", F.concat(F.lit("<Preambulo><p>"), emphasised, F.lit("</p></Preambulo>"))).otherwise(F.lit(""))
    return F.concat(F.lit("<ParteInicial>"), _tag("Epigrafe", heading), _tag("Ementa", summary), shown, F.lit("</ParteInicial>"))


def document_xml(urn: Column, initial: Column, body: Column, root: str = "Documento") -> Column:
    """A whole document below an element of the given name."""
    return F.concat(F.lit(f"<{root}>"), metadata_xml(urn), F.lit("<ProjetoNorma><Norma>"), initial, F.lit("<Articulacao>"), F.coalesce(body, F.lit("")), F.lit("</Articulacao></Norma></ProjetoNorma>"), F.lit(f"</{root}>"))


def editor_metadata_xml(urn: Column, summary: Column, digest: Column, provisions: Column, parts: Column) -> Column:
    """Metadata for an editor; the digest is named for what it is."""
    return F.concat(F.lit("<Proposicao"), _attribute("urn", urn), _attribute("md5", digest), _attribute("dispositivos", provisions.cast("string")), F.lit(">"), _tag("Ementa", summary), F.array_join(F.transform(parts, lambda p: F.concat(F.lit("<Parte>"), X.escape_xml(p), F.lit("</Parte>"))), ""), F.lit("</Proposicao>"))


def debug_json(nodes: DataFrame) -> DataFrame:
    """Every node as JSON."""
    return nodes.select("doc_id", "at", F.to_json(F.struct(*(c for c in nodes.columns if c not in ("doc_id", "at")))).alias("node"))


def node_json(lines: DataFrame, fields: dict[str, pa.DataType] | None = None) -> DataFrame:
    """As debug_json of the outline of lines, made in the outline's own pass; styled lines by that.

    fields: those to be read back out of each node's JSON there, given in its place.
    """
    if "runs" in lines.columns:
        nodes = debug_json(O.outline(lines))
        return nodes if fields is None else nodes.select("doc_id", F.from_json("node", StructType([StructField(c, from_arrow_type(t)) for c, t in fields.items()])).alias("x")).select("doc_id", "x.*")
    if fields is None:
        return O.made(lines, nesting.NodeJson.TYPES, sink=nesting.NodeJson)
    return O.made(lines, fields, sink=nesting.NodeJson, then=lambda batches: nesting.read_back(batches, fields))


@F.pandas_udf(BinaryType())
def zip_bundle(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """ZIP of metadata and text XML, the heading as its comment; same input, same bytes."""
    for metadata, text, comment in parts:
        out = []
        for m, t, c in zip(metadata, text, comment):
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED, compresslevel=9) as bundle:
                for name, content in (("proposicao.xml", m), ("texto.xml", t)):
                    bundle.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), content or "", zipfile.ZIP_DEFLATED, 9)
                bundle.comment = (c or "").encode()[:65535]
            out.append(buffer.getvalue())
        yield pd.Series(out)


@F.pandas_udf(StructType([StructField("comment", StringType()), StructField("names", ArrayType(StringType())), StructField("texts", ArrayType(StringType()))]))
def unzipped(bundles: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Comment, member names and member texts of bundles."""
    for column in bundles:
        rows = []
        for blob in column:
            with zipfile.ZipFile(io.BytesIO(bytes(blob))) as bundle:
                names = bundle.namelist()
                rows.append((bundle.comment.decode(), names, [bundle.read(n).decode() for n in names]))
        yield pd.DataFrame(rows, columns=["comment", "names", "texts"])
