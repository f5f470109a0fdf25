"""Styled runs of a paragraph as arrays of structs, and passes over ordered blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

STYLE = ("b", "i", "sup", "sub")


def run(text: Column, href: Column | None = None, **style: bool) -> Column:
    return F.struct(text.alias("text"), *(F.lit(style.get(s, False)).alias(s) for s in STYLE), (F.lit(None).cast("string") if href is None else href).alias("href"))


def _with_text(r: Column, text: Column) -> Column:
    return F.struct(text.alias("text"), *(r[s].alias(s) for s in STYLE), r["href"].alias("href"))


def text(runs: Column) -> Column:
    return F.array_join(F.transform(runs, lambda r: r["text"]), "")


def merge(runs: Column) -> Column:
    """Neighbouring runs of one style joined, empty ones dropped."""
    full = F.filter(runs, lambda r: F.length(r["text"]) > 0)

    def step(out: Column, r: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        alike = F.lit(True)
        for s in (*STYLE, "href"):
            alike = alike & last[s].eqNullSafe(r[s])
        joined = F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(_with_text(last, F.concat(last["text"], r["text"]))))
        return F.when((F.size(out) > 0) & F.coalesce(alike, F.lit(False)), joined).otherwise(F.concat(out, F.array(_with_text(r, r["text"]))))

    return F.when(F.size(full) == 0, full).otherwise(F.aggregate(F.slice(full, F.lit(2), F.greatest(F.size(full) - 1, F.lit(0))), F.slice(F.transform(full, lambda r: _with_text(r, r["text"])), 1, 1), step))


def _offsets(runs: Column) -> Column:
    """Runs with the character where each begins."""
    start = F.transform(runs, lambda r, i: F.aggregate(F.slice(runs, F.lit(1), i), F.lit(0), lambda n, x: n + F.length(x["text"])))
    return F.arrays_zip(runs.alias("run"), start.alias("start"))


def cut_right(runs: Column, at: Column) -> Column:
    """Runs before a character, on the text that the runs hold."""
    kept = F.transform(_offsets(runs), lambda z: _with_text(z["run"], F.substring(z["run"]["text"], F.lit(1), F.greatest(at - z["start"], F.lit(0)))))
    return F.filter(kept, lambda r: F.length(r["text"]) > 0)


def cut_left(runs: Column, at: Column) -> Column:
    """Runs from a character on."""
    kept = F.transform(_offsets(runs), lambda z: _with_text(z["run"], F.substring(z["run"]["text"], F.greatest(at - z["start"], F.lit(0)) + 1, F.length(z["run"]["text"]))))
    return F.filter(kept, lambda r: F.length(r["text"]) > 0)


def plain(runs: Column) -> Column:
    """Runs without bold and italic."""
    return F.transform(runs, lambda r: F.struct(r["text"].alias("text"), F.lit(False).alias("b"), F.lit(False).alias("i"), r["sup"].alias("sup"), r["sub"].alias("sub"), r["href"].alias("href")))


def _escaped(text_: Column) -> Column:
    for c, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text_ = F.replace(text_, F.lit(c), F.lit(name))
    return text_


def to_markup(runs: Column) -> Column:
    """Runs as tags: links outside bold outside italic, then superscript and subscript; text is escaped."""
    def one(r: Column) -> Column:
        out = _escaped(r["text"])
        for s in reversed(STYLE):
            out = F.when(r[s], F.concat(F.lit(f"<{s}>"), out, F.lit(f"</{s}>"))).otherwise(out)
        return F.when(r["href"].isNotNull(), F.concat(F.lit('<span xlink:href="'), _escaped(r["href"]), F.lit('">'), out, F.lit("</span>"))).otherwise(out)

    return F.array_join(F.transform(runs, one), "")


def content_markup(runs: Column) -> Column:
    """Runs of a provision's text as tags; a text that is bold or italic as a whole has neither."""
    return to_markup(F.when(F.size(runs) == 1, plain(runs)).otherwise(runs))


def style_of(css: Column) -> Column:
    """Struct of style flags of a CSS text; other properties are dropped."""
    rules = F.str_to_map(F.lower(F.regexp_replace(css, r"\s+", "")), F.lit(";"), F.lit(":"))
    get = lambda k: F.coalesce(F.element_at(rules, k), F.lit(""))
    return F.struct(get("font-weight").isin("bold", "700").alias("b"), (get("font-style") == "italic").alias("i"), (get("vertical-align") == "super").alias("sup"), (get("vertical-align") == "sub").alias("sub"))


def indent_mm(css: Column) -> Column:
    """Sum of text-indent and margin-left in millimetres."""
    def part(name: str) -> Column:
        pattern = rf"{name}\s*:\s*(-?[0-9.]+)(mm|cm|in)"
        unit = F.regexp_extract(css, pattern, 2)
        value = F.regexp_extract(css, pattern, 1)
        return F.when(value != "", value.cast("double") * F.when(unit == "cm", 10.0).when(unit == "in", 25.4).otherwise(1.0)).otherwise(0.0)

    return part("text-indent") + part("margin-left")


def join_islands(rows: DataFrame, style: str, value: str) -> DataFrame:
    """Neighbouring rows (doc_id, pos) with one style as one: island, style, joined, n."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    new = (~F.col(style).eqNullSafe(F.lag(style).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    marked = rows.withColumn("new_", new).withColumn("island", F.sum("new_").over(w))
    parts = F.array_sort(F.collect_list(F.struct("pos", F.col(value).alias("v"))))
    return marked.groupBy("doc_id", "island", style).agg(F.array_join(F.transform(parts, lambda x: x["v"]), " ").alias("joined"), F.count("*").alias("n"))


def collapse_empty(lines: DataFrame) -> DataFrame:
    """Drop empty lines right after empty lines."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    return lines.withColumn("was_", F.lag("raw").over(w)).where(~((F.trim("raw") == "") & F.coalesce(F.trim("was_") == "", F.lit(False)))).drop("was_")


def trim_ends(lines: DataFrame) -> DataFrame:
    """Drop empty lines at the ends of each document."""
    w = Window.partitionBy("doc_id")
    full = F.when(F.trim("raw") != "", F.col("pos"))
    return lines.withColumn("a_", F.min(full).over(w)).withColumn("b_", F.max(full).over(w)).where("pos between a_ and b_").drop("a_", "b_")


def exists_first(lines: DataFrame, test: Column) -> DataFrame:
    """(doc_id, any_, first_pos): whether some block passes a test, and the first that does."""
    return lines.groupBy("doc_id").agg(F.bool_or(test).alias("any_"), F.min(F.when(test, F.col("pos"))).alias("first_pos"))


@F.pandas_udf(StringType())
def nfc(text_):  # noqa: ANN001, ANN201
    """Canonical composition, which Spark has no function for."""
    import unicodedata

    return text_.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")
