"""Match cited references with the provisions of an amendment and name these by the best norm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from normloom.functions import norms as N
from normloom.functions.levels import case
from normloom.operators import nesting
from normloom.operators import outline as O

#: Classes of a match and their rank (fixed values).
RANKS = {"exact": 10, "prefix": 9, "suffix": 8, "superprefix": 7, "neighbour": 6, "partial": 4, "none": 0}
#: Classes in the order in which bases are compared by their counts (a fixed value).
ORDER = ["exact", "prefix", "suffix", "superprefix", "partial", "neighbour", "none"]
#: Neighbouring types (cited, provision): what goes between them (fixed values).
NEIGHBOURS = {"art>inc": "cpt", "art>par": "", "par>inc": "", "inc>ali": "", "ali>ite": "", "prt>liv": "", "liv>tit": "", "tit>cap": "", "cap>sec": "", "sec>sub": ""}


def classify(cited: Column, fragment: Column) -> Column:
    """Struct(level, complement): how a provision's fragment fits a cited one.

    The "only" marker u of numbers is compared as if it were not there.
    """
    u, f = cited, F.regexp_replace(fragment, r"1u(?=_|$)", "1")
    pair = F.concat(N.last_component(u), F.lit(">"), N.first_component(f))
    between = case(pair, NEIGHBOURS)
    near = F.when(between.isNotNull(), F.struct(F.lit(6).alias("level"), F.concat(u, F.lit("_"), F.when(between != "", F.concat(between, F.lit("_"))).otherwise(F.lit(""))).alias("complement"))).otherwise(F.struct(F.lit(0).alias("level"), F.lit("").alias("complement")))
    made = lambda level, text: F.struct(F.lit(level).alias("level"), text.alias("complement"))
    none = F.lit("")
    head = F.substring_index(f, "_", 1)
    at = F.position(head, u)
    longer, shorter = F.length(f) > F.length(u), F.length(f) < F.length(u)
    return (
        F.when(u == f, made(10, none))
        .when(F.length(u) == F.length(f), near)
        .when(longer & F.startswith(f, u), made(9, none))
        .when(longer, near)
        .when(shorter & F.endswith(u, f), made(8, F.substring(u, F.lit(1), F.length(u) - F.length(f))))
        .when(shorter & (at > 1), made(4, F.substring(u, F.lit(1), at - 1)))
        .when(shorter & (at == 1), made(7, none))
        .otherwise(near)
    )


def matches(citations: DataFrame, fragments: DataFrame, keys: list[str]) -> DataFrame:
    """Every cited reference against every provision of the same amendment, classified.

    citations: keys, urn; fragments: keys, fragment.  The join is an equi-join on
    the amendment's keys, so its size is bounded by what one amendment holds.
    """
    cited = citations.withColumn("u", N.urn_parts(F.col("urn"))).where("u is not null").select(*keys, "urn", F.col("u.base").alias("base"), F.col("u.year").alias("year"), F.col("u.month").alias("month"), F.col("u.day").alias("day"), F.coalesce("u.fragment", F.lit("")).alias("cited")).distinct()
    pairs = cited.join(fragments.select(*keys, "fragment").distinct(), keys)
    return pairs.withColumn("m", classify(F.col("cited"), F.col("fragment"))).select(*keys, "base", "urn", "year", "month", "day", "cited", "fragment", "m.level", "m.complement")


def run_matches(runs: DataFrame, keys: list[str]) -> DataFrame:
    """As matches, of amendments that each hold their references and fragments (keys, links, fragments): no join."""
    part = lambda c: F.explode(F.array_distinct(c))
    cited = runs.select(*keys, part("links").alias("urn"), "fragments").withColumn("u", N.urn_parts(F.col("urn"))).where("u is not null")
    pairs = cited.select(*keys, "urn", F.col("u.base").alias("base"), F.col("u.year").alias("year"), F.col("u.month").alias("month"), F.col("u.day").alias("day"), F.coalesce("u.fragment", F.lit("")).alias("cited"), part("fragments").alias("fragment"))
    return pairs.withColumn("m", classify(F.col("cited"), F.col("fragment"))).select(*keys, "base", "urn", "year", "month", "day", "cited", "fragment", "m.level", "m.complement")


def best_matches(found: DataFrame, keys: list[str]) -> DataFrame:
    """Best match of each fragment under each base: highest level, then urn and complement."""
    top = F.max(F.struct("level", "urn", "cited", "complement")).alias("top")
    return found.groupBy(*keys, "base", "year", "month", "day", "fragment").agg(top).select(*keys, "base", "year", "month", "day", "fragment", "top.*")


def match_counts(best: DataFrame, keys: list[str], name: str = "n_", more: list[Column] | None = None) -> DataFrame:
    """Counts of each class under each base; more: other aggregates beside them."""
    return best.groupBy(*keys, "base", "year", "month", "day").agg(*(more or []), *(F.count_if(F.col("level") == rank).alias(name + kind) for kind, rank in RANKS.items()))


def best_base(best: DataFrame, keys: list[str]) -> DataFrame:
    """The base that fits an amendment best, with the counts of its classes.

    First bases whose fragments all match, then more exact matches, and so on
    down to more unmatched ones, then the older norm, dated before undated.
    """
    return _first(match_counts(best, keys), keys)


def _first(counts: DataFrame, keys: list[str]) -> DataFrame:
    order = [F.asc(F.col("n_none") > 0), *(F.desc(f"n_{kind}") for kind in ORDER), F.asc_nulls_last("year"), F.asc_nulls_last("month"), F.asc_nulls_last("day"), F.asc("base")]
    return counts.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("place = 1").drop("place")


def rewritten(best: DataFrame, chosen: DataFrame, keys: list[str]) -> DataFrame:
    """Fragments of each amendment named under its best base: keys, base, fragment, full_fragment."""
    return best.join(chosen.select(*keys, "base"), [*keys, "base"]).select(*keys, "base", "fragment", F.concat("complement", "fragment").alias("full_fragment"))


def best_rewritten(best: DataFrame, keys: list[str]) -> DataFrame:
    """As rewritten under best_base, read once: counts keep the fragments of their base."""
    chosen = _first(match_counts(best, keys, more=[F.collect_list(F.struct("fragment", F.concat("complement", "fragment").alias("full_fragment"))).alias("named")]), keys)
    return chosen.select(*keys, "base", F.inline("named"))


def with_overrides(nodes: DataFrame, renamed: DataFrame) -> DataFrame:
    """Nodes with override_id and base_urn from the best base of their amendment.

    nodes: an outline; renamed: doc_id, run_parent, base, fragment, full_fragment.
    """
    own = N.link_target(F.col("id"))
    named = renamed.withColumnRenamed("fragment", "own_fragment")
    out = nodes.withColumn("own_fragment", own).join(named, ["doc_id", "run_parent", "own_fragment"], "left")
    return out.withColumn("override_id", F.when(F.col("full_fragment").isNotNull(), F.concat(F.regexp_extract("id", r"^(.*_alt\d+_)", 1), F.col("full_fragment")))).withColumnRenamed("base", "base_urn").drop("own_fragment", "full_fragment")


#: A urn written out in a text.
URN_IN_TEXT = r"urn:lex:[a-z.;]+:[a-z.]+:[a-z.;]+:[0-9-]+;[0-9.]+(?:-[0-9]+)?(?:![a-z0-9_-]+)?"


def find_links(nodes: DataFrame, finder: str = URN_IN_TEXT, use: bool = True) -> DataFrame:
    """Add links: distinct references written out in each provision's text.

    The grammar of citations in prose is not part of this engine; another
    finder is a pattern here or a function given to `find_links_with`.
    """
    none = F.array().cast("array<string>")
    return nodes.withColumn("links", F.array_distinct(F.regexp_extract_all("content", F.lit(f"({finder})"), 1)) if use else none)


def find_links_with(nodes: DataFrame, finder) -> DataFrame:
    """Add links by a function from an iterator of pandas series of texts to series of lists."""
    from pyspark.sql.types import ArrayType, StringType

    return nodes.withColumn("links", F.array_distinct(F.pandas_udf(finder, ArrayType(StringType()))(F.col("content"))))


def amendment_runs(lines: DataFrame) -> DataFrame:
    """(doc_id, run_parent, parent_at, around, fragments) of each amendment of an outline's lines.

    around: the text of the provision that encloses it; fragments: those of its
    own provisions.  Both come out of the one pass over a document, dealt by document.
    """
    return O.made(lines, nesting.Runs.TYPES, sink=nesting.Runs).repartition("doc_id")


def amendment_links(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Citations of the provision that encloses each amendment, and the amendment's fragments."""
    runs = nodes.where("unit = 'amendment'").select("doc_id", F.col("at").alias("run_parent"), F.col("parent_at"))
    cited = runs.join(nodes.select("doc_id", F.col("at").alias("parent_at"), "links"), ["doc_id", "parent_at"]).select("doc_id", "run_parent", F.explode("links").alias("urn"))
    fragments = nodes.where("ctx > 0 and unit = 'provision'").select("doc_id", "run_parent", N.link_target(F.col("id")).alias("fragment"))
    return cited, fragments
