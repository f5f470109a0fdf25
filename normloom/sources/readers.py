"""Sources: files, texts, lists and lines as documents or as ordered lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from normloom.functions import text as X
from normloom.sources import markup as M

#: MIME types that are read, by file name ending (fixed values).
ENDINGS = {"txt": M.TEXT, "html": M.HTML, "htm": M.HTML, "xhtml": M.XHTML, "docx": M.DOCX, "odt": M.ODT, "rtf": M.RTF, "doc": M.DOC}
ACCEPTED = sorted({*ENDINGS.values()})


def accepted(mime: Column) -> Column:
    return mime.isin(ACCEPTED)


def files(spark: SparkSession, path: str) -> DataFrame:
    """Files below a path: doc_id, path, mime, content, digest (MD5 of the bytes)."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    ending = F.lower(F.substring_index("path", ".", -1))
    mime = F.coalesce(*(F.when(ending == e, F.lit(m)) for e, m in ENDINGS.items()), F.lit("application/octet-stream"))
    return df.select(F.xxhash64("path").alias("doc_id"), "path", mime.alias("mime"), "content", F.md5("content").alias("digest"))


def bytes_of(spark: SparkSession, content: bytes, mime: str, doc_id: int = 0) -> DataFrame:
    """One document from bytes, such as those of standard input."""
    return spark.createDataFrame([(doc_id, mime, bytearray(content))], "doc_id long, mime string, content binary")


def paragraphs(texts: DataFrame, text: str = "text") -> DataFrame:
    """Lines of plain texts as paragraphs (doc_id, pos, raw): blank lines divide, others join in order."""
    split = texts.select("doc_id", F.posexplode(F.split(X.clean_source(F.coalesce(F.col(text), F.lit(""))), "\r?\n")).alias("line_no", "line"))
    marked = split.withColumn("blank", F.trim("line") == "")
    group = F.sum(F.col("blank").cast("int")).over(W.partitionBy("doc_id").orderBy("line_no"))
    filled = marked.withColumn("par", group).where("not blank")
    lines = F.array_sort(F.collect_list(F.struct("line_no", F.trim("line").alias("line"))))
    joined = filled.groupBy("doc_id", "par").agg(F.array_join(F.transform(lines, lambda x: x["line"]), " ").alias("raw"))
    return joined.select("doc_id", (F.row_number().over(W.partitionBy("doc_id").orderBy("par")) - 1).alias("pos"), "raw")


def listed(df: DataFrame, lines: str = "lines") -> DataFrame:
    """One paragraph for each element of an array column."""
    return df.select("doc_id", F.posexplode(lines).alias("pos", "raw"))


def line_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of one paragraph a line."""
    whole = spark.read.text(path, wholetext=True).select(F.xxhash64(F.input_file_name()).alias("doc_id"), "value")
    lines = F.split(F.regexp_replace("value", "\r?\n$", ""), "\r?\n")
    return listed(whole.select("doc_id", lines.alias("lines")))


@F.pandas_udf(ArrayType(StringType()))
def _xml_texts(xml):  # noqa: ANN001, ANN202
    """Whole texts of the direct p children, which xpath gives only by text node."""
    from xml.etree import ElementTree

    return xml.map(lambda x: ["".join(p.itertext()) for p in ElementTree.fromstring(x) if p.tag.rpartition("}")[2] == "p"] if x else None, na_action="ignore")


def xml_paragraphs(df: DataFrame, text: str = "xml") -> DataFrame:
    """Direct p children of the root of a well-formed XML text, each with all its text as one paragraph."""
    return listed(df.select("doc_id", _xml_texts(F.col(text)).alias("lines")))


def documents(df: DataFrame, converters: dict | None = None) -> DataFrame:
    """Blocks of documents by MIME type, parsed in one Python pass; texts that are columns already go to `paragraphs`."""
    return M.blocks(df, converters)


def lines(blocks: DataFrame) -> DataFrame:
    """Blocks as lines of an outline: doc_id, pos, raw, list_item, block (paragraph, table or image), runs."""
    return blocks.where("problem is null").select("doc_id", "pos", F.coalesce("raw", F.lit("")).alias("raw"), "list_item", F.col("kind").alias("block"), "runs")


def conversion_problems(blocks: DataFrame) -> DataFrame:
    return blocks.where("problem is not null").select("doc_id", F.col("problem").alias("code"))


#: Rules that a text may be held against at once; each is tried on each text.
MOST_RULES = 10_000


def regex_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules of the lines of files."""
    return rules_of(spark.read.text(path))


def rules_of(lines_: DataFrame) -> DataFrame:
    """Rules of lines /pattern/,message (column value) with any delimiter; comments and malformed lines are skipped."""
    form = r"^([^#\w\s])(.+)\1,(.*)$"
    df = lines_.where(F.col("value").rlike(form))
    return df.select(F.regexp_extract("value", form, 2).alias("pattern"), F.trim(F.regexp_extract("value", form, 3)).alias("message"))


def classified(texts: DataFrame, rules: DataFrame, text: str = "text") -> DataFrame:
    """Every (row, rule) whose pattern the text matches; the rules, counted, go to every text."""
    if rules.count() > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    return texts.join(F.broadcast(rules), F.expr(f"{text} rlike pattern"))
