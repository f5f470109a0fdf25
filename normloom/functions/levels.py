"""Levels of labels, containment between them, and the CASE expressions over both."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Level(NamedTuple):
    kind: str
    level: int
    prefix: str
    word: str
    group: str
    many: int  # siblings from which "unique" is wrong
    in_: str
    of: str


#: One row for each class of label (fixed values): kind, level, id prefix, display word,
#: grouping or unit, siblings a unique one may have, "in the" and "of the".
LEVELS = [
    Level("part", 10, "prt", "PARTE", "grouping", 1, "na", "da"),
    Level("book", 20, "liv", "LIVRO", "grouping", 1, "no", "do"),
    Level("title", 30, "tit", "TÍTULO", "grouping", 1, "no", "do"),
    Level("subtitle", 40, "stt", "SUBTÍTULO", "grouping", 1, "no", "do"),
    Level("chapter", 50, "cap", "CAPÍTULO", "grouping", 1, "no", "do"),
    Level("subchapter", 60, "sct", "SUB-CAPÍTULO", "grouping", 1, "no", "do"),
    Level("section", 70, "sec", "Seção", "grouping", 1, "na", "da"),
    Level("subsection", 80, "sub", "Subseção", "grouping", 1, "na", "da"),
    Level("article", 110, "art", "Art.", "unit", 1, "no", "do"),
    Level("paragraph", 120, "par", "§", "unit", 2, "no", "do"),
    Level("clause", 130, "inc", "inciso", "unit", 0, "no", "do"),
    Level("letter", 140, "ali", "alínea", "unit", 0, "na", "da"),
    Level("item", 150, "ite", "item", "unit", 0, "no", "do"),
    Level("penalty", 160, "pena", "Pena", "unit", 0, "na", "da"),
    Level("generic", 160, "dpg", "", "unit", 0, "no", "do"),
    Level("amendment", 1000, "alt", "", "neither", 0, "na", "da"),
]
BY_KIND = {x.kind: x for x in LEVELS}
PROVISION_LEVELS = sorted({x.level for x in LEVELS if x.level < 1000})

#: Direct containment by kind (fixed values); an amendment may hold every kind up to articles.
CONTAINS = {
    "part": ["book", "title", "chapter", "section", "article"],
    "book": ["title", "chapter", "section", "article"],
    "title": ["chapter", "section", "article", "subtitle"],
    "subtitle": ["chapter", "section", "article"],
    "chapter": ["subchapter", "section", "article"],
    "subchapter": ["section", "article"],
    "section": ["subsection", "article"],
    "subsection": ["article"],
    "article": ["paragraph"],
    "paragraph": ["clause", "amendment", "penalty"],
    "clause": ["letter", "penalty"],
    "letter": ["item", "penalty"],
    "item": ["penalty"],
}


def levels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([tuple(x) for x in LEVELS], "kind string, level int, prefix string, word string, label_group string, many int, in_word string, of_word string")


def direct() -> set[tuple[int, int]]:
    pairs = {(BY_KIND[a].level, BY_KIND[b].level) for a, bs in CONTAINS.items() for b in bs}
    return pairs | {(1000, x.level) for x in LEVELS if x.level <= 110}


def closure() -> set[tuple[int, int]]:
    """Transitive containment that does not pass through an amendment."""
    known = {(a, b) for a, b in direct() if a != 1000}
    while True:
        more = {(a, d) for a, b in known for c, d in known if b == c != 1000} - known
        if not more:
            return known | direct()
        known |= more


def containment(spark: SparkSession) -> DataFrame:
    """(parent_level, child_level, is_direct) of all allowed pairs."""
    near = direct()
    return spark.createDataFrame(sorted((a, b, (a, b) in near) for a, b in closure()), "parent_level int, child_level int, is_direct boolean")


def case(column: Column, values: dict) -> Column:
    """A CASE from constants to constants, null elsewhere."""
    out = None
    for k, v in values.items():
        out = F.when(column == k, F.lit(v)) if out is None else out.when(column == k, F.lit(v))
    return out


def may_contain(parent: Column, child: Column, transitive: bool = False) -> Column:
    """Containment as an expression over level numbers."""
    pairs = closure() if transitive else direct()
    return F.concat_ws(">", parent.cast("string"), child.cast("string")).isin([f"{a}>{b}" for a, b in sorted(pairs)])


def follows(level: Column, num: Column, comp: Column, before_level: Column, before_num: Column, before_comp: Column) -> Column:
    """Whether a label may directly follow a sibling: same number with the next
    complement, or the next number; articles and paragraphs from their own
    rules, letters also from j to l, chapters to a first subtitle."""
    same = before_level == level
    plain, was_plain = comp.isNull(), before_comp.isNull()
    next_comp = (num == before_num) & F.when(was_plain, comp == 0).otherwise(comp == before_comp + 1)
    next_num = (num == before_num + 1) & plain
    caput = (level == 120) & before_num.isNull() & (num == 1) & plain
    skip_k = (level == 140) & (before_num == 10) & (num == 12) & plain & was_plain
    to_subtitle = (before_level == 50) & (level == 40) & (num == 1) & plain
    free = level.isin(10, 20, 1000)
    article_to_deeper = (before_level == 110) & (level > 110)
    return F.coalesce(free | (same & (next_comp | next_num | caput | skip_k)) | to_subtitle | article_to_deeper, F.lit(False))


def may_be_first(level: Column, num: Column, comp: Column, name: Column) -> Column:
    """Whether a label may open its siblings."""
    one = (num == 1) & comp.isNull()
    out = F.when(level.isin(10, 20), name.isNotNull() | one).when(level.isin(110, 160), F.lit(True)).when(level == 120, num.isNull())
    return F.coalesce(out.otherwise(one), F.lit(False))
