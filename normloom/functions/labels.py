"""The label grammar, and labels as ids, display text and element names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from normloom.functions import text as X
from normloom.functions.levels import BY_KIND, LEVELS, case

SCHEMA = "kind string, level int, num int, comp int, is_unique boolean, name string"

_INT = r"([0-9]+(?:\.[0-9]{3})*)"
_SIGN = r"(?:[º°˚ª]|[oa](?![a-z0-9]))?"
_COMP = r"(?:-([a-z]+)(?=[,.;:)\s\\]|$))?+"
_ORDINAL = r"(unic|primeir|segund|terceir|quart|quint|sext|setim|oitav|non|decim)"
_ROMAN = rf"(?=[mdclxvi])({X.ROMAN})"
#: Words of provisions without numbers (fixed values).
GENERIC = ["penas", "penalidade", "infracao", "medida administrativa", "multa"]
_GROUPING = {"titulo": "title", "subtitulo": "subtitle", "capitulo": "chapter", "subcapitulo": "subchapter", "secao": "section", "subsecao": "subsection"}
_TAIL = r"-?\.?"

ARTICLE = rf"^art(?:igo |\.)? ?(?:{_ORDINAL}o|{_INT}{_SIGN}){_COMP}\.?"
PARAGRAPH_WORD = rf"^paragrafo {_ORDINAL}o{_COMP}\.?"
PARAGRAPH = rf"^§ ?[-.]? ?{_INT}{_SIGN}{_COMP}\.?"
CLAUSE = rf"^{_ROMAN}{_COMP} ?-(?! *\)) *"
LETTER = rf"^(?:([a-z]{{1,6}})|([0-9]{{1,9}}))\.?{_COMP} *\)"
ITEM = rf"^{_INT}{_COMP} ?[-.]? ?"
PENALTY = r"^pena -"
OTHER = rf"^({'|'.join(GENERIC)}) *-"
PART = rf"^(?:parte|p a r t e) (?:(unica)|{_ORDINAL}o(?![a-z])|([^\s-]+)){_COMP}"
BOOK = rf"^livro ([^\s-]+){_COMP}"
GROUPING = rf"^({'|'.join(_GROUPING)}) (?:(unic[oa])(?![a-z])|{_ROMAN}(?![a-z0-9])){_COMP}"


def _label(kind: Column | str, num: Column, comp: Column, unique: Column | bool = False, name: Column | None = None, level: Column | None = None) -> Column:
    kind_ = F.lit(kind) if isinstance(kind, str) else kind
    level = F.lit(BY_KIND[kind].level) if isinstance(kind, str) else level
    unique = unique if isinstance(unique, Column) else F.lit(unique)
    return F.struct(kind_.alias("kind"), level.cast("int").alias("level"), num.cast("int").alias("num"), comp.cast("int").alias("comp"), unique.alias("is_unique"), (F.lit(None) if name is None else name).cast("string").alias("name"))


def parse(norm: Column, compatible: bool = False) -> Column:
    """Struct(label, taken) of a normalised text, null if it starts with no label.

    `taken` is the number of characters of the label.  The first alternative
    that matches wins: article, paragraph, clause, letter, item, penalty,
    generic, part, book, grouping.  With `compatible`, a subchapter is read as
    a chapter, as older engines did.
    """
    g = lambda pattern, k: F.regexp_extract(norm, pattern, k)
    filled = lambda c: F.when(c != "", c)
    comp = lambda pattern, k: F.when(g(pattern, k) != "", X.letters_value(g(pattern, k)) - 1)
    ordinal = lambda c: F.when(c != "", X.ordinal_word_value(F.concat(c, F.lit("o"))))
    none = F.lit(None).cast("int")
    kinds = _GROUPING | ({"subcapitulo": "chapter"} if compatible else {})
    alternatives = [
        (ARTICLE, _label("article", F.coalesce(ordinal(g(ARTICLE, 1)), X.integer(filled(g(ARTICLE, 2)))), comp(ARTICLE, 3), g(ARTICLE, 1) == "unic")),
        (PARAGRAPH_WORD, _label("paragraph", ordinal(g(PARAGRAPH_WORD, 1)), comp(PARAGRAPH_WORD, 2), g(PARAGRAPH_WORD, 1) == "unic")),
        (PARAGRAPH, _label("paragraph", X.integer(g(PARAGRAPH, 1)), comp(PARAGRAPH, 2))),
        (CLAUSE, _label("clause", X.roman_value(g(CLAUSE, 1)), comp(CLAUSE, 6))),
        (LETTER, _label("letter", F.coalesce(X.letters_value(filled(g(LETTER, 1))), filled(g(LETTER, 2)).try_cast("int")), comp(LETTER, 3))),
        (ITEM, _label("item", X.integer(g(ITEM, 1)), comp(ITEM, 2))),
        (PENALTY, _label("penalty", none, none)),
        (OTHER, _label("generic", F.lit(0), none, name=F.initcap(g(OTHER, 1)))),
        (PART, _label("part", F.coalesce(F.when(g(PART, 1) != "", 1), ordinal(g(PART, 2))), comp(PART, 4), (g(PART, 1) != "") | (g(PART, 2) == "unic"), F.upper(filled(g(PART, 3))))),
        (BOOK, _label("book", X.roman_value(g(BOOK, 1)), comp(BOOK, 2), name=F.when(X.roman_value(g(BOOK, 1)).isNull(), F.upper(g(BOOK, 1))))),
        (GROUPING, _label(case(g(GROUPING, 1), kinds), F.when(g(GROUPING, 2) != "", 1).otherwise(X.roman_value(g(GROUPING, 3))), comp(GROUPING, 8), g(GROUPING, 2) != "", level=case(g(GROUPING, 1), {w: BY_KIND[k].level for w, k in kinds.items()}))),
    ]
    out = None
    for pattern, label in alternatives:
        found = F.struct(label.alias("label"), F.length(F.regexp_extract(norm, pattern + _TAIL, 0)).alias("taken"))
        out = F.when(norm.rlike(pattern), found) if out is None else out.when(norm.rlike(pattern), found)
    return out


def rest(text: Column, parsed: Column) -> Column:
    """What follows the label of a text."""
    return F.trim(F.when(parsed.isNull(), text).otherwise(text.substr(parsed["taken"] + 1, F.length(text))))


def label_id(kind: Column, num: Column, comp: Column, unique: Column) -> Column:
    """Id component of a label: cap1, art5-1, par1u, cpt, pena, dpg2."""
    prefix = case(kind, {x.kind: x.prefix for x in LEVELS})
    tail = F.concat(F.coalesce(num.cast("string"), F.lit("")), F.when(unique, F.lit("u")).otherwise(F.lit("")), F.coalesce(F.concat(F.lit("-"), (comp + 1).cast("string")), F.lit("")))
    return F.when(kind == "penalty", F.lit("pena")).when((kind == "paragraph") & num.isNull(), F.lit("cpt")).otherwise(F.concat(prefix, tail))


def html_id(kind: Column, num: Column, comp: Column, unique: Column) -> Column:
    """Id component of the HTML form, where complements count from 0."""
    return label_id(kind, num, comp - 1, unique)


def display(kind: Column, num: Column, comp: Column, unique: Column, name: Column) -> Column:
    """A label as printed."""
    c = X.complement(comp)
    word = case(kind, {x.kind: x.word for x in LEVELS})
    roman = F.concat(X.roman(num), c)
    feminine = kind.isin("part", "section", "subsection")
    only = F.when(kind.isin("section", "subsection"), F.lit("Única")).otherwise(F.when(feminine, F.lit("ÚNICA")).otherwise(F.lit("ÚNICO")))
    grouping = F.concat(word, F.lit(" "), F.when(unique, only).otherwise(F.coalesce(name, roman)))
    stop = F.when((num < 10) & comp.isNull(), F.lit("")).otherwise(F.lit("."))
    return (
        F.when((kind == "article") & unique, F.lit("Artigo único. "))
        .when(kind == "article", F.concat(F.lit("Art. "), X.ordinal(num), c, stop))
        .when((kind == "paragraph") & num.isNull(), F.lit(""))
        .when((kind == "paragraph") & unique, F.lit("Parágrafo único."))
        .when(kind == "paragraph", F.concat(F.lit("§ "), X.ordinal(num), c, stop))
        .when(kind == "clause", F.concat(roman, F.lit(" –")))
        .when(kind == "letter", F.concat(X.letters(num), c, F.lit(")")))
        .when(kind == "item", F.concat(num.cast("string"), c, F.lit(".")))
        .when(kind == "penalty", F.lit("Pena –"))
        .when(kind == "generic", F.concat(name, F.lit(" –")))
        .when(kind == "amendment", F.lit(""))
        .otherwise(grouping)
    )


#: Element names of the XML form (fixed values).
ELEMENTS = {"part": "Parte", "book": "Livro", "title": "Titulo", "subtitle": "Subtitulo", "chapter": "Capitulo", "subchapter": "Subcapitulo", "section": "Secao", "subsection": "Subsecao", "article": "Artigo", "clause": "Inciso", "letter": "Alinea", "item": "Item", "penalty": "Pena", "generic": "DispositivoGenerico", "amendment": "Alteracao"}


def element_name(kind: Column, num: Column) -> Column:
    caput = F.when(num.isNull(), F.lit("Caput")).otherwise(F.lit("Paragrafo"))
    return F.when(kind == "paragraph", caput).otherwise(case(kind, ELEMENTS))


def child_label(level: Column, position: Column) -> Column:
    """Label of the nth element of an ordered list below a label of that level."""
    below = {110: "paragraph", 120: "clause", 130: "letter", 140: "item"}
    kind = case(level, below)
    return F.when(kind.isNotNull(), _label(kind, position, F.lit(None).cast("int"), level=case(level, {k: BY_KIND[v].level for k, v in below.items()})))


def path_text(path: Column) -> Column:
    """A root-first path of label structs as text, leaf first, with prepositions."""
    of = {x.kind: x.of for x in LEVELS}
    in_ = {x.kind: x.in_ for x in LEVELS}

    def one(x: Column) -> Column:
        shown = F.trim(display(x["kind"], x["num"], x["comp"], x["is_unique"], x["name"]))
        return F.when((x["kind"] == "paragraph") & x["num"].isNull(), F.lit("caput")).when(x["kind"] == "amendment", F.concat(F.lit("alteração "), x["num"].cast("string"))).otherwise(shown)

    def step(out: Column, x: Column) -> Column:
        group = x["level"] < 110
        # a unit inside a grouping says where it is; other levels say whose they are
        joined = F.when(group & out["unit"], F.concat(out["s"], F.lit(" ("), case(x["kind"], in_), F.lit(" "), one(x), F.lit(")"))).otherwise(F.concat(out["s"], F.lit(" "), case(x["kind"], of), F.lit(" "), one(x)))
        text = F.when(out["s"] == "", one(x)).otherwise(joined)
        return F.struct(text.alias("s"), (~group).alias("unit"))

    return F.aggregate(F.reverse(path), F.struct(F.lit("").alias("s"), F.lit(False).alias("unit")), step)["s"]
