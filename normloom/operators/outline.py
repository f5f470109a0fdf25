"""Outline recognition: lines of documents become nested, identified provisions.

A single shuffle on the document key; then one Arrow pass over each document's
lines in order (`nesting`), which columns of expressions took many sorts for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import StructField, StructType

from normloom.functions import text as X
from normloom.operators import nesting as N


def _doc() -> WindowSpec:
    return W.partitionBy("doc_id").orderBy("pos")


def _before() -> WindowSpec:
    return _doc().rowsBetween(W.unboundedPreceding, -1)


def _up_to() -> WindowSpec:
    return _doc().rowsBetween(W.unboundedPreceding, 0)


def amendments(lines: DataFrame) -> DataFrame:
    """Mark quoted runs: inside, starts (first line of a run), open_quote, close_quote, note.

    A run starts at a line that opens with a quote while no run is open and
    ends with the first line, itself included, that closes one.  `unclosed`
    marks the lines of a run that the document never closes.
    """
    df = lines.withColumn("norm", X.normalize(F.col("raw"))).withColumn("opens", X.opens_quote(F.col("norm"))).withColumn("closes", X.closes_quote(F.col("norm")))
    df = df.withColumn("last_open", F.max(F.when(F.col("opens"), F.col("pos"))).over(_up_to())).withColumn("last_close", F.max(F.when(F.col("closes"), F.col("pos"))).over(_before()))
    df = df.withColumn("inside", F.col("last_open").isNotNull() & (F.col("last_close").isNull() | (F.col("last_open") > F.col("last_close"))))
    df = df.withColumn("open_quote", F.col("inside") & ~F.coalesce(F.lag("inside").over(_doc()) & ~F.lag("closes").over(_doc()), F.lit(False)))
    df = df.withColumn("close_quote", F.col("inside") & F.col("closes")).withColumn("note", F.when(F.col("close_quote"), F.upper(X.closing_note(F.col("norm")))))
    final_close = F.max(F.when(F.col("closes"), F.col("pos"))).over(W.partitionBy("doc_id"))
    df = df.withColumn("unclosed", F.col("inside") & ~F.coalesce(final_close >= F.col("pos"), F.lit(False)))
    return df.drop("last_open", "last_close", "opens", "closes")


def summaries(nodes: DataFrame) -> DataFrame:
    """Mark the first paragraph of the only amendment of a provision that speaks of a summary."""
    doc = W.partitionBy("doc_id").orderBy("at")
    content = F.last(F.when((F.col("unit") == "provision") & (F.col("ctx") == 0), F.col("content")), ignorenulls=True).over(doc.rowsBetween(W.unboundedPreceding, -1))
    run = F.col("unit") == "amendment"
    speaks = run & F.coalesce(X.normalize(content).rlike(r"\bementa\b"), F.lit(False))
    df = nodes.withColumn("only_", F.count("*").over(W.partitionBy("doc_id", "parent_at", "unit")) == 1).withColumn("speaks_", speaks)
    first = F.lag(F.col("speaks_") & F.col("only_")).over(doc) & (F.col("unit") == "paragraph")
    return df.withColumn("klass", F.when(first, F.lit("summary"))).drop("only_", "speaks_")


def ordered(lines: DataFrame) -> DataFrame:
    """Lines as nesting reads them: document by document and in order.

    Lines with a column text are so already: the rows of a document follow
    each other in one partition, each with one line or several.
    """
    if "text" in lines.columns:
        return lines.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    fields = [F.col(c).cast("int").alias(c) if c in ("pos", "list_item") else F.col(c) for c in ("doc_id", "pos", "raw", "list_item", "block", "runs") if c in lines.columns]
    # the window deals lines by document, where they are not dealt so already
    return lines.select(*fields).withColumn("nth_", F.row_number().over(_doc())).sortWithinPartitions("doc_id", "pos")


def outline(lines: DataFrame, compatible: bool = False, columns: list[str] | None = None) -> DataFrame:
    """Nodes of lines (doc_id, pos, raw[, list_item][, block][, runs]), or of texts in order (doc_id, text).

    Columns: doc_id, at (order), ctx (number of the quoted run, 0 outside),
    unit, kind, level, num, comp, is_unique, name, title, content, open_quote,
    close_quote, note, omitted, parent_at, parent_level, path, ancestry (order
    and element of all nodes around), run_parent, id, parent_id (of paragraphs),
    and with styled lines runs (of the content, or of a grouping's name).

    columns: those wanted alone, of these and of nesting.TYPES; what is not
    wanted is not made.
    """
    styled = "runs" in lines.columns
    wanted = [c for c in N.COLUMNS if styled or c != "runs"] if columns is None else list(columns)
    return made(lines, {c: N.TYPES[c] for c in wanted}, compatible)


def made(lines: DataFrame, types: dict, compatible: bool = False, sink: type = N.Nodes, then: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] = iter) -> DataFrame:
    """What a sink makes of the nodes of each document, and what then makes of that: columns of these types after doc_id."""
    styled = "runs" in lines.columns
    wanted = list(types)
    schema = StructType([StructField("doc_id", lines.schema["doc_id"].dataType), *(StructField(c, from_arrow_type(t)) for c, t in types.items())])
    return ordered(lines).mapInArrow(lambda batches: then(N.outlined(batches, wanted, styled, compatible, sink)), schema)


def unclosed(lines: DataFrame) -> DataFrame:
    """(doc_id, context): first three lines of a quoted run that never closes."""
    marked = amendments(lines).where("unclosed")
    ranked = marked.withColumn("k", F.row_number().over(W.partitionBy("doc_id").orderBy("pos"))).where("k <= 3")
    return ranked.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "raw"))), lambda x: x["raw"]).alias("context"))


def feature_flags(nodes: DataFrame) -> DataFrame:
    """Feature map of each document: table, amendment, title, penalty, image, summary."""
    flags = {"table": F.col("kind") == "table", "amendment": F.col("unit") == "amendment", "title": F.col("title").isNotNull(), "penalty": F.col("kind") == "penalty", "image": F.col("kind") == "image", "summary": F.lower("content").contains("ementa")}
    return nodes.groupBy("doc_id").agg(F.map_from_arrays(F.array(*map(F.lit, flags)), F.array(*(F.coalesce(F.bool_or(c), F.lit(False)) for c in flags.values()))).alias("features"), F.count_if(F.col("unit").isin("provision", "omission", "amendment") & ~F.coalesce(F.col("level") < 110, F.lit(False))).alias("provisions"))


def path_texts(lines: DataFrame) -> DataFrame:
    """(doc_id, ctx, id, shown): the nodes of lines with their paths as text, made in the outline's own pass."""
    return made(lines, N.Paths.TYPES, sink=N.Paths)


def document_features(lines: DataFrame) -> DataFrame:
    """As feature_flags of the outline of lines, a column a feature, made in the outline's own pass."""
    return made(lines, N.Features.TYPES, sink=N.Features)


def kinds(lines: DataFrame) -> DataFrame:
    """(kind, quoted, n, n_docs): nodes of each kind and documents that have one; each batch of documents counts its own in the outline's pass."""
    return made(lines, N.Kinds.TYPES, sink=N.Kinds).groupBy("kind", "quoted").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))
