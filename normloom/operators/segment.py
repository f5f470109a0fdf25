"""Parts of a document: heading, summary, preamble, body, and the sections after it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from normloom.functions import labels as L
from normloom.functions import text as X
from normloom.sources.profiles import Profile

#: Sections after the body, in the order of their priority.
MARKERS = ["place_date", "justification", "annex", "cited_law", "signature"]


def _doc() -> WindowSpec:
    return Window.partitionBy("doc_id")


def _in_order() -> WindowSpec:
    return _doc().orderBy("pos")


def markers(lines: DataFrame, profile: Profile) -> DataFrame:
    """Lines (doc_id, pos, norm, part) with, in the body, marker (class of a marker line) and section.

    The first line of each class starts its section and is dropped; later ones
    stay where they are.
    """
    kind = F.coalesce(*(F.when(F.col("norm").rlike(profile.pattern(m)), F.lit(m)) for m in MARKERS))
    df = lines.withColumn("marker", F.when(F.col("part") == "body", kind))
    seen = {f"n_{m}": F.sum(F.when(F.col("marker") == m, 1).otherwise(0)).over(_in_order()) for m in MARKERS}
    first = F.lit(False)
    for m in MARKERS:
        first = first | ((F.col("marker") == m) & (F.col(f"n_{m}") == 1))
    df = df.withColumns(seen).withColumn("starts", F.coalesce(first, F.lit(False))).drop(*seen)
    return df.withColumn("section", F.last(F.when(F.col("starts"), F.col("marker")), ignorenulls=True).over(_in_order()))


def _first(where: Column) -> Column:
    return F.min(F.when(where, F.col("pos"))).over(_doc())


def parts(lines: DataFrame, profile: Profile) -> DataFrame:
    """Lines (doc_id, pos, raw, any others) with norm and part: before, heading, after_heading, summary,
    preamble, body, or the name of a section; marker lines are of part marker."""
    df = lines.withColumn("norm", X.normalize(F.col("raw")))
    start = F.col("norm").rlike(profile.pattern("heading_start"))
    more = start | F.col("norm").rlike(profile.pattern("heading_more"))
    df = df.withColumn("heading_from", _first(start))
    broken = F.sum(F.when((F.col("pos") >= F.col("heading_from")) & ~more, 1).otherwise(0)).over(_in_order())
    in_heading = F.coalesce((F.col("pos") >= F.col("heading_from")) & (broken == 0), F.lit(False))
    df = df.withColumn("in_heading", in_heading)
    df = df.withColumn("heading_to", F.coalesce(F.max(F.when(F.col("in_heading"), F.col("pos"))).over(_doc()), F.lit(-1)))
    past = F.col("pos") > F.col("heading_to")
    df = df.withColumn("body_from", _first(past & (L.parse(F.col("norm"))["label"]["level"] <= 110)))
    df = df.withColumn("preamble_from", F.least(_first(past & F.col("norm").rlike(profile.pattern("preamble"))), "body_from"))
    extra = F.col("norm").rlike(profile.pattern("post_heading")) | (F.col("norm") == "")
    before_body = F.col("body_from").isNull() | (F.col("pos") < F.col("body_from"))
    in_preamble = F.col("preamble_from").isNotNull() & (F.col("pos") >= F.col("preamble_from"))
    part = (
        F.when(F.col("heading_from").isNotNull() & (F.col("pos") < F.col("heading_from")), F.lit("before"))
        .when(F.col("in_heading"), F.lit("heading"))
        .when(before_body & extra, F.lit("after_heading"))
        .when(before_body & in_preamble, F.lit("preamble"))
        .when(before_body, F.lit("summary"))
        .otherwise(F.lit("body"))
    )
    df = markers(df.withColumn("part", part), profile)
    section = F.when(F.col("starts"), F.lit("marker")).otherwise(F.coalesce("section", F.lit("body")))
    return df.withColumn("part", F.when(F.col("part") == "body", section).otherwise(F.col("part"))).select(*lines.columns, "norm", "part")


def documents(parts_: DataFrame, profile: Profile) -> DataFrame:
    """One row a document: heading, summary, preamble, n_body, and what is missing of them."""
    text = lambda name: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("part") == name, F.struct("pos", "raw")))), lambda x: F.trim(x["raw"])), " ")
    df = parts_.groupBy("doc_id").agg(text("heading").alias("heading"), text("summary").alias("summary"), text("preamble").alias("preamble"), F.count_if(F.col("part") == "body").alias("n_body"), F.count_if((F.col("part") == "before") & (F.col("norm") != "")).alias("n_before"))
    no_heading = ((F.col("heading") == "") & F.lit(not profile.heading_optional)) | ((F.col("n_before") > 0) & F.lit(not profile.pre_heading_allowed))
    return df.withColumn("no_heading", no_heading).withColumn("no_summary", (F.col("summary") == "") & F.lit(not profile.summary_optional)).withColumn("no_body", F.col("n_body") == 0)


def body(parts_: DataFrame) -> DataFrame:
    """Lines of the body, for the outline."""
    return parts_.where("part = 'body'").drop("norm", "part")
