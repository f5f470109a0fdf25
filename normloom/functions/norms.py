"""Identifiers of norms and of provisions in them, heading templates and placeholders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from normloom.functions import text as X

_URN = r"^urn:lex:([^:!]*):([^:!]*):([^:!]*):([^!]*)(?:!(.*))?$"
_ID = r"^(?:(\d{4})-(\d{2})-(\d{2})|(\d{4}));([0-9.]+)(?:-([0-9]+))?(?:@(.*))?$"


def urn_parts(urn: Column) -> Column:
    """Struct(urn, base, locality, authority, type, year, month, day, fragment) of a urn, null if malformed."""
    g = lambda k: F.regexp_extract(urn, _URN, k)
    date = lambda k: F.regexp_extract(g(4), r"^(\d{4})(?:-(\d{2})-(\d{2}))?", k)
    number = lambda c: F.when(c != "", c).cast("int")
    return F.when(
        urn.rlike(_URN),
        F.struct(
            urn.alias("urn"), F.substring_index(urn, "!", 1).alias("base"), g(1).alias("locality"), g(2).alias("authority"), g(3).alias("type"),
            number(date(1)).alias("year"), number(date(2)).alias("month"), number(date(3)).alias("day"), F.when(g(5) != "", g(5)).alias("fragment"),
        ),
    )


def urn(locality: Column, authority: Column, kind: Column, norm_id: Column) -> Column:
    """urn of a norm; a norm without id has a placeholder for it."""
    return F.concat(F.lit("urn:lex:"), locality, F.lit(":"), authority, F.lit(":"), kind, F.lit(":"), F.coalesce(norm_id, F.lit(PREFIX + "URN_ID")))


def norm_id(text: Column) -> Column:
    """Struct(year, date, number, comp, version) of date-or-year;number[-comp][@version]."""
    g = lambda k: F.when(F.regexp_extract(text, _ID, k) != "", F.regexp_extract(text, _ID, k))
    date = X.parse_date(F.concat_ws("-", g(1), g(2), g(3)))
    return F.when(text.rlike(_ID), F.struct(F.coalesce(g(1), g(4)).cast("int").alias("year"), date.alias("date"), X.integer(g(5)).alias("number"), g(6).cast("int").alias("comp"), g(7).alias("version")))


def render_id(year: Column, date: Column, number: Column, comp: Column, version: Column) -> Column:
    when = F.coalesce(X.render_date(date), year.cast("string"))
    return F.concat(when, F.lit(";"), number.cast("string"), F.coalesce(F.concat(F.lit("-"), comp.cast("string")), F.lit("")), F.coalesce(F.concat(F.lit("@"), version), F.lit("")))


def version(date: Column, event: Column, moment: Column) -> Column:
    """A version: its date (or that of its event), the event, and the moment."""
    return F.concat_ws(";", F.coalesce(X.render_date(date), F.lit("data.evento")), event, X.render_timestamp(moment))


def heading_id(year: Column, date: Column, number: Column, comp: Column) -> Column:
    """Number and date as a heading has them."""
    shown = F.concat(F.lit("Nº "), F.translate(F.format_number(number, 0), ",", "."), X.complement(comp))
    when = F.when(date.isNotNull(), F.concat(F.lit(", DE "), F.upper(X.long_date(date)))).otherwise(F.concat(F.lit(", DE "), year.cast("string")))
    return F.concat(shown, when)


def fill(template: Column, values: dict[str, Column]) -> Column:
    """A heading template with <name> fields filled."""
    out = template
    for name, value in values.items():
        out = F.replace(out, F.lit(f"<{name}>"), F.coalesce(value, F.lit("")))
    return out


#: Beginning of placeholders, and their names in texts written before a norm is known (fixed values but for the beginning).
PREFIX = "NORMA_"
PLACEHOLDERS = ["URN_ID", "EPIGRAFE_NUMERO", "EPIGRAFE_DATA", "ANO", "NUMERO", "DATA", "COMPLEMENTO"]


def replace_placeholders(text: Column, values: dict[str, Column], prefix: str = PREFIX) -> Column:
    """Known placeholders (a prefix and a name) replaced by the values of their names; others stay."""
    out = text
    for name in PLACEHOLDERS:
        if name in values:
            out = F.replace(out, F.lit(prefix + name), F.coalesce(values[name], F.lit(prefix + name)))
    return out


def subtype(type_fragment: Column) -> Column:
    """Part of a norm type after the semicolon."""
    return F.when(type_fragment.contains(";"), F.substring_index(type_fragment, ";", -1))


def last_component(fragment: Column) -> Column:
    """Letters of the last component of a fragment."""
    return F.regexp_extract(F.substring_index(fragment, "_", -1), "^[a-z]+", 0)


def first_component(fragment: Column) -> Column:
    """Letters of the first component of a fragment."""
    return F.regexp_extract(fragment, "^[a-z]+", 0)


def link_target(node_id: Column) -> Column:
    """Fragment that an id inside an amendment points to: what follows its last amendment."""
    return F.when(node_id.rlike(r"_alt\d+_"), F.regexp_extract(node_id, r".*_alt\d+_(.*)$", 1))


def folder_name(sigla: Column, number: Column, comp: Column, year: Column, version_: Column) -> Column:
    """Name of a bundle's folder; null without a number."""
    return F.when(number.isNotNull(), F.concat_ws("_", sigla, number.cast("string"), comp.cast("string"), year.cast("string"), version_))
