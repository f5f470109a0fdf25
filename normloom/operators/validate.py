"""Structural rules: each is one query over outline nodes; all are united into problems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from normloom.functions import labels as L
from normloom.functions import text as X
from normloom.functions.levels import LEVELS, case, follows, may_be_first, may_contain
from normloom.operators import nesting
from normloom.operators import outline as O
from normloom.operators.nesting import AMONG
from normloom.sources.readers import classified

#: Problem codes: category and meaning (fixed values; 1 to 5: input, metadata, system, structure, references).
CODES = {
    1: (1, "unsupported document"), 2: (4, "inverted order"), 3: (4, "discontinuous numbering"), 4: (4, "bad first number"), 5: (4, "repeated label"),
    6: (4, "unique but not alone"), 7: (4, "bad position"), 8: (4, "no heading"), 9: (4, "empty body"), 10: (4, "schema violation"), 11: (4, "forbidden text"),
    12: (4, "no summary"), 14: (3, "system failure"), 15: (1, "conversion failure"), 16: (4, "unlabelled text"), 17: (4, "unclosed amendment"),
    18: (4, "list in a paragraph"), 19: (4, "repeated path"), 20: (4, "omission outside an amendment"), 21: (4, "table"), 22: (4, "single but not unique"), 23: (4, "connective out of place"), 3001: (3, "rendering failure"),
}
SCHEMA = "doc_id long, code int, category int, at int, position string, message string"
#: Columns of an outline that the rules look at.
COLUMNS = ["at", "ctx", "unit", "kind", "level", "num", "comp", "is_unique", "name", "content", "omitted", "parent_level", "path", "id", *AMONG]


_C = F.col


def prepared(nodes: DataFrame) -> DataFrame:
    """Nodes with what the rules look at: the sibling before, counts of siblings, equal ids.

    An outline of COLUMNS has these already, so the rules add no shuffle; others
    get them by windows, with one shuffle on the document key.
    """
    df = nodes if "klass" in nodes.columns else nodes.withColumn("klass", F.lit(None).cast("string"))
    df = df.withColumn("ranked", (_C("unit") == "provision") & (_C("ctx") == 0))
    if set(AMONG) <= set(nodes.columns):
        return df
    siblings = Window.partitionBy("doc_id", "ranked", "parent_at").orderBy("at")
    level = Window.partitionBy("doc_id", "ranked", "parent_at", "level").orderBy("at")
    kind = Window.partitionBy("doc_id", "ranked", "parent_at", "kind")
    key = F.when(_C("unit") == "provision", F.regexp_replace("id", r"1u(?=_|$)", "1"))
    same = Window.partitionBy("doc_id", "same_id")
    numbered = ~((_C("kind") == "paragraph") & _C("num").isNull()) & _C("kind").isin([x.kind for x in LEVELS if x.many])
    df = df.withColumns({f"prev_{c}": F.when(_C("ranked"), F.lag(c).over(siblings)) for c in ("level", "num", "comp")})
    df = df.withColumn("nth_level", F.row_number().over(level)).withColumn("n_kind", F.count("*").over(kind)).withColumn("n_numbered", F.sum(numbered.cast("int")).over(kind)).withColumn("numbered", numbered).withColumn("nth_kind", F.row_number().over(kind.orderBy("at")))
    df = df.withColumn("same_id", key)
    return df.withColumn("n_same", F.count("same_id").over(same)).withColumn("forms", F.size(F.collect_set("id").over(same))).withColumn("nth_same", F.row_number().over(same.orderBy("at")))


def _key(prefix: str = "") -> Column:
    return F.struct(F.coalesce(_C(f"{prefix}level"), F.lit(0)), F.coalesce(_C(f"{prefix}num"), F.lit(-1)), F.coalesce(_C(f"{prefix}comp"), F.lit(-1)))


def rules(optional: bool = False) -> dict[str, tuple[int, Column]]:
    """Name of each rule: its code, and when a prepared node breaks it."""
    c = _C
    peers = c("ranked") & (c("prev_level") == c("level"))
    inverted = _key("prev_") > _key()
    consecutive = follows(c("level"), c("num"), c("comp"), c("prev_level"), c("prev_num"), c("prev_comp"))
    first = may_be_first(c("level"), c("num"), c("comp"), F.when(c("num").isNull(), c("name")))
    limit = case(c("kind"), {x.kind: x.many for x in LEVELS})
    labelled = c("unit").isin("provision", "amendment")
    before_letter = F.try_element_at(F.filter("path", lambda x: x["level"] != 140), F.lit(-1))["kind"]
    only_and_first = (c("ctx") > 0) & (c("n_same") == 2) & (c("forms") == 2) & (c("kind") == "paragraph")
    out = {
        "repeated_label": (5, peers & (_key() == _key("prev_")) & ~c("kind").isin("penalty", "generic")),
        "inverted_order": (2, peers & inverted),
        "discontinuity": (3, peers & (c("level") != 160) & ~inverted & ~consecutive),
        "bad_first": (4, c("ranked") & (c("nth_level") == 1) & ~first),
        "unique_not_alone": (6, c("ranked") & c("is_unique") & (c("n_kind") > limit)),
        "nested_amendment": (7, (c("unit") == "amendment") & (F.size(F.filter("path", lambda x: x["kind"] == "amendment")) > 1)),
        "bad_position": (7, labelled & (c("ctx") == 0) & c("parent_level").isNotNull() & ~may_contain(c("parent_level"), c("level"))),
        "bad_position_in_amendment": (7, labelled & (c("ctx") > 0) & (c("parent_level") < 1000) & ~may_contain(c("parent_level"), c("level"), transitive=True)),
        "letter_not_under_clause": (7, (c("kind") == "letter") & (F.size("path") > 1) & ~before_letter.isin("clause", "amendment")),
        "repeated_path": (19, (c("unit") == "provision") & (c("n_same") > 1) & (c("nth_same") == 1) & ~only_and_first),
        "stray_text": (16, (c("unit") == "paragraph") & c("klass").isNull() & ~F.coalesce(c("kind") == "table", F.lit(False))),
        "omission_outside": (20, (c("ctx") == 0) & (c("omitted") | (c("unit") == "omission"))),
        "table": (21, (c("kind") == "table") | F.lower("content").contains("<table")),
        "list_markup": (18, F.lower("content").rlike("<(?:ol|li)\\b")),
    }
    if optional:
        out["single_not_unique"] = (22, c("ranked") & (c("n_numbered") == 1) & c("numbered") & ~c("is_unique"))
        out["connective"] = (23, c("ranked") & X.normalize(c("content")).rlike("[,;] (?:e|ou)$") & (c("nth_kind") != c("n_kind") - 1))
    return out


def validate(nodes: DataFrame, optional: bool = False) -> DataFrame:
    """Problems of an outline: a single pass in which each node lists the rules it breaks."""
    broken = [F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(name).alias("rule"))) for name, (code, test) in rules(optional).items()]
    hits = prepared(nodes).select("doc_id", "at", "id", "path", F.explode(F.filter(F.array(*broken), lambda x: x.isNotNull())).alias("hit"))
    position = F.coalesce(_C("id"), L.path_text(_C("path")))
    return hits.select("doc_id", _C("hit.code").alias("code"), case(_C("hit.code"), {k: v[0] for k, v in CODES.items()}).alias("category"), _C("at").cast("int").alias("at"), position.alias("position"), case(_C("hit.code"), {k: v[1] for k, v in CODES.items()}).alias("message"), _C("hit.rule").alias("rule"))


def problems(lines: DataFrame) -> DataFrame:
    """As validate of the outline of lines, the rules applied in the outline's own pass (without the optional ones)."""
    hits = O.made(lines, nesting.Problems.TYPES, sink=nesting.Problems)
    return hits.select("doc_id", "code", case(_C("code"), {k: v[0] for k, v in CODES.items()}).alias("category"), "at", "position", case(_C("code"), {k: v[1] for k, v in CODES.items()}).alias("message"), "rule")


def empty_body(documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """Problem 9 for documents without any node."""
    bare = documents.select("doc_id").join(nodes.select("doc_id").distinct(), "doc_id", "left_anti")
    return bare.select("doc_id", F.lit(9).alias("code"), F.lit(4).alias("category"), F.lit(None).cast("int").alias("at"), F.lit(None).cast("string").alias("position"), F.lit(CODES[9][1]).alias("message"))


def forbidden_text(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules (pattern, message) that a provision's text matches."""
    hits = classified(nodes.where("unit = 'provision' and content <> ''"), rules, "content")
    return hits.select("doc_id", F.lit(11).alias("code"), F.lit(4).alias("category"), F.col("at").cast("int").alias("at"), F.col("id").alias("position"), F.col("message"))


def unclosed_amendments(found: DataFrame) -> DataFrame:
    """Problems of outline.unclosed."""
    return found.select("doc_id", F.lit(17).alias("code"), F.lit(4).alias("category"), F.lit(None).cast("int").alias("at"), F.array_join("context", " | ").alias("position"), F.lit(CODES[17][1]).alias("message"))


def document_problems(parts: DataFrame) -> DataFrame:
    """Parse-time problems of segmented documents: doc_id, no_heading, no_summary, no_body."""
    listed = F.filter(F.array(F.when(F.col("no_heading"), 8), F.when(F.col("no_summary"), 12), F.when(F.col("no_body"), 9)), lambda c: c.isNotNull())
    df = parts.select("doc_id", F.explode(listed).alias("code"))
    return df.select("doc_id", "code", F.lit(4).alias("category"), F.lit(None).cast("int").alias("at"), F.lit(None).cast("string").alias("position"), case(F.col("code"), {c: CODES[c][1] for c in (8, 9, 12)}).alias("message"))
