"""Document profiles: patterns and policies by locality, authority and type; overrides; lookups."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from normloom.functions import norms as N

#: Default patterns over normalised text (fixed values).
PLACE_DATE = ["^sala da sessao", "^sala das sessoes", "^sala das comissoes", "^sala da comissao", "^camara dos deputados", "^senado federal", "^brasilia,", "^rio de janeiro,", "^congresso nacional,"]
JUSTIFICATION = ["^justificacao", "^justificativa", "^j u s t i f i c a c a o", "^j u s t i f i c a t i v a"]
ANNEX = ["^anexo", "a n e x o"]
CITED_LAW = ["^legislacao citada", "^l e g i s l a c a o c i t a d a"]
SIGNATURE = ["^senadora? "]
HEADING_START = [r"^\s*(red\d+;+)?(substitutivo (ao|a)\s+)?(projeto( de)? (lei|decreto legislativo)|(proposta|projeto) de emenda|projeto de resolu)"]
HEADING_MORE = ["^(n[oº°˚]|complementar)"]
POST_HEADING = [r"^\s*(\(.*\)|autora?:.*|autoria d.*|(d[oa] )?senador.*)\s*$"]
PREAMBLE = [
    "^[ao] (congress+o nacional|senado federal|camara dos deputados) (decret[oa]|resolve|promulg[oa])",
    "^[ao] president[ae] (da republica|do senado|do supremo tribunal|da camara)",
    "^[ao] vice-president[ae] da republica",
    "^as? mesas?",
    "^faco saber que [oa] president[ea] da republica",
    "^faco saber que o congresso nacional rejeitou",
]
NORM_HEADINGS = {"lei": "^lei n", "lei.complementar": "^lei complementar", "lei.delegada": "^lei delegada", "decreto.lei": "^decreto-lei", "decreto": "^decreto n", "decreto.legislativo": "^decreto legislativo", "emenda.constitucional": "^emenda constitucional", "emenda.constitucional.revisao": "^emenda constitucional de revisao", "medida.provisoria": "^medida provisoria", "constituicao": "^constituicao", "ato.disposicoes.constitucionais.transitorias": "^ato das disposicoes", "resolucao": "^resolucao", "regimento.interno": "^regimento interno"}


@dataclass(frozen=True)
class Profile:
    locality: str
    authority: str
    type: str
    place_date: tuple[str, ...] = tuple(PLACE_DATE)
    justification: tuple[str, ...] = tuple(JUSTIFICATION)
    annex: tuple[str, ...] = tuple(ANNEX)
    cited_law: tuple[str, ...] = tuple(CITED_LAW)
    signature: tuple[str, ...] = tuple(SIGNATURE)
    heading_start: tuple[str, ...] = tuple(HEADING_START)
    heading_more: tuple[str, ...] = tuple(HEADING_MORE)
    post_heading: tuple[str, ...] = tuple(POST_HEADING)
    preamble: tuple[str, ...] = tuple(PREAMBLE)
    heading_optional: bool = False
    pre_heading_allowed: bool = True
    summary_optional: bool = False
    heading_head: str = ""
    heading_tail: str = ""
    heading_template: str = "<head> <id> <tail>"
    is_draft: bool = False

    def pattern(self, group: str) -> str:
        """One pattern for a group; one that matches nothing if it is empty."""
        return "|".join(f"(?:{p})" for p in getattr(self, group)) or "(?!)"


def _profile(authority: str, type_: str, **policies: bool) -> Profile:
    name = type_.partition(";")[0]
    start = (NORM_HEADINGS[name],) if name in NORM_HEADINGS else tuple(HEADING_START)
    return Profile("br", authority, type_, heading_start=start, heading_head=name.replace(".", " ").upper(), **policies)


def built_in() -> list[Profile]:
    """The profiles that need no configuration (fixed values)."""
    senate, chamber, congress, union = "senado.federal", "camara.deputados", "congresso.nacional", "federal"
    draft, late = {"is_draft": True}, {"is_draft": True, "heading_optional": True}
    bare = {"summary_optional": True}
    return [
        _profile(senate, "projeto.lei;pls", **draft),
        _profile(senate, "projeto.lei;plc", **late),
        _profile(senate, "proposta.emenda.constitucional;pec", **draft),
        _profile(senate, "projeto.resolucao;prs", **draft),
        _profile(senate, "projeto.decreto.legislativo;pds", pre_heading_allowed=False, **late),
        _profile(senate, "projeto.decreto.legislativo;pdc", **late),
        _profile(senate, "projeto.decreto.legislativo;pdl", **late),
        _profile(senate, "projeto.lei.complementar;pls", **draft),
        _profile(senate, "projeto.lei.complementar;plc", **late),
        _profile(senate, "projeto.lei;pl", **late),
        _profile(senate, "projeto.lei.complementar;plp", **late),
        _profile(senate, "resolucao"),
        _profile(senate, "regimento.interno", **bare),
        _profile(chamber, "projeto.decreto.legislativo;pdl", **late),
        _profile(chamber, "projeto.lei;pl", **late),
        _profile(chamber, "projeto.lei.complementar;plp", **late),
        _profile(chamber, "projeto.resolucao", **late),
        _profile(chamber, "resolucao"),
        _profile(chamber, "regimento.interno", **bare),
        _profile(congress, "projeto.lei;pln", **late),
        _profile(congress, "medida.provisoria;mpv", **draft),
        _profile(congress, "decreto.legislativo"),
        _profile(congress, "resolucao"),
        _profile(congress, "regimento.interno", **bare),
        _profile(congress, "projeto.lei.conversao;plv", **late),
        _profile(union, "lei"),
        _profile(union, "lei.complementar"),
        _profile(union, "lei.delegada"),
        _profile(union, "decreto.lei"),
        _profile(union, "decreto"),
        _profile(union, "decreto.legislativo"),
        _profile(union, "emenda.constitucional"),
        _profile(union, "emenda.constitucional.revisao", **bare),
        _profile(union, "medida.provisoria"),
        _profile(union, "constituicao", **bare),
        _profile(union, "ato.disposicoes.constitucionais.transitorias", **bare),
    ]


_ROW = "locality string, authority string, type string, " + ", ".join(f"{g} array<string>" for g in ("place_date", "justification", "annex", "cited_law", "signature", "heading_start", "heading_more", "post_heading", "preamble")) + ", heading_optional boolean, pre_heading_allowed boolean, summary_optional boolean, heading_head string, heading_tail string, heading_template string, is_draft boolean"


def profiles(spark: SparkSession, extra: list[Profile] | None = None) -> DataFrame:
    """All profiles as rows, in the order of their keys: a constant table, small enough to broadcast."""
    rows = sorted([*built_in(), *(extra or [])], key=lambda p: (p.locality, p.authority, p.type))
    return spark.createDataFrame([tuple(list(v) if isinstance(v, tuple) else v for v in asdict(p).values()) for p in rows], _ROW)


def find(locality: str, authority: str, type_: str) -> Profile:
    """The profile of a key, that of a federal law if there is none."""
    known = {(p.locality, p.authority, p.type): p for p in built_in()}
    return known.get((locality, authority, type_)) or known["br", "federal", "lei"]


def override(profile: Profile, **changes) -> Profile:
    """A profile with some fields replaced; lists become tuples."""
    return replace(profile, **{k: tuple(v) if isinstance(v, list) else v for k, v in changes.items() if v is not None})


def merge_overrides(first: dict, second: dict) -> dict:
    """Overrides one after another: each field of the second, where it has one."""
    return {**first, **{k: v for k, v in second.items() if v is not None}}


OVERRIDABLE = [f.name for f in fields(Profile) if f.name not in ("locality", "authority", "type")]
_JSON = ", ".join(x for x in _ROW.split(", ") if x.split()[0] in OVERRIDABLE)


def overrides_from_json(text: Column) -> Column:
    """Struct of the overridable fields of a JSON text; absent ones are null."""
    return F.from_json(text, _JSON)


def with_overrides(profiles_: DataFrame, given: DataFrame) -> DataFrame:
    """Profiles with overrides by key; given: locality, authority, type, json."""
    parsed = given.select("locality", "authority", "type", overrides_from_json(F.col("json")).alias("o"))
    joined = profiles_.join(parsed, ["locality", "authority", "type"], "left")
    return joined.select("locality", "authority", "type", *(F.coalesce(F.col(f"o.{c}"), F.col(c)).alias(c) for c in OVERRIDABLE))


def to_json(profiles_: DataFrame) -> DataFrame:
    return profiles_.select("locality", "authority", "type", F.to_json(F.struct(*OVERRIDABLE)).alias("json"))


def lookup(documents: DataFrame, profiles_: DataFrame) -> DataFrame:
    """Documents with the profile of their (locality, authority, type), null fields if unknown."""
    return documents.join(F.broadcast(profiles_), ["locality", "authority", "type"], "left")


def lookup_by_suffix(documents: DataFrame, profiles_: DataFrame) -> DataFrame:
    """Documents (authority, sigla) with the types of profiles of that authority that end in ;sigla."""
    known = profiles_.select("authority", "type", N.subtype(F.col("type")).alias("sigla")).where("sigla is not null")
    return documents.join(F.broadcast(known), ["authority", "sigla"])


def lookup_by_urn(documents: DataFrame, profiles_: DataFrame) -> DataFrame:
    """Documents (urn) with the key that begins their urn."""
    parts = documents.withColumn("u", N.urn_parts(F.col("urn"))).select("*", "u.locality", "u.authority", "u.type").drop("u")
    return parts.join(F.broadcast(profiles_.select("locality", "authority", "type", "heading_optional", "summary_optional", "is_draft")), ["locality", "authority", "type"])


def authorities(profiles_: DataFrame) -> DataFrame:
    return profiles_.select("authority").distinct()


def types_of(profiles_: DataFrame) -> DataFrame:
    return profiles_.select("authority", "type").distinct()


def dump(profiles_: DataFrame) -> DataFrame:
    """One line for each profile and field."""
    shown = F.array(*(F.struct(F.lit(c).alias("field"), F.to_json(F.struct(F.col(c).alias("v"))).alias("value")) for c in OVERRIDABLE))
    return profiles_.select(F.concat_ws(":", "locality", "authority", "type").alias("key"), F.inline(shown))
