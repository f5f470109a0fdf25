"""Text, number and date functions as column expressions."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from normloom.functions.levels import case

#: Characters read as a dash (fixed values).
DASHES = "‐‑‒–—―−­⁃﹘﹣－"


@cache
def accent_table() -> tuple[str, str]:
    """Lower-case letters whose decomposition is one letter and combining marks, and those letters."""
    source, target = [], []
    for code in range(0xC0, 0x2000):
        c = chr(code)
        plain = "".join(x for x in unicodedata.normalize("NFD", c) if not "̀" <= x <= "ͯ")
        if c == c.lower() and plain != c and len(plain) == 1:
            source.append(c)
            target.append(plain)
    return "".join(source), "".join(target)


def normalize(text: Column) -> Column:
    """Lower case without accents, one kind of dash, single spaces, trimmed."""
    source, target = accent_table()
    low = F.translate(F.lower(text), source + DASHES, target + "-" * len(DASHES))
    spaced = F.regexp_replace(F.regexp_replace(low, "[̀-ͯ]", ""), r"[\s\p{Z}]+", " ")
    return F.trim(spaced)


def clean_source(text: Column) -> Column:
    """Control characters and mis-encoded quotes, spaces and dashes of office exports."""
    marked = F.replace(text, F.lit("&#146;"), F.lit("`"))
    return F.translate(marked, "\u0092‬‭–\u0096\u0007\u001f", "`  --")


def squeeze(text: Column) -> Column:
    """Single spaces, none at the ends nor just inside curly quotes."""
    one = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.regexp_replace(F.regexp_replace(one, "“ ", "“"), " ”", "”")


# --- numerals ---------------------------------------------------------------

_ROMAN = [("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"), ("", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"), ("", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM")]
#: A roman numeral in lower case; groups: thousands, hundreds, tens, units.
ROMAN = r"(m*)(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})"


def roman(n: Column) -> Column:
    """Roman numeral of a positive number, null otherwise."""
    parts = [F.repeat(F.lit("M"), F.floor(n / 1000).cast("int"))]
    for k in (2, 1, 0):
        digit = F.pmod(F.floor(n / 10**k), F.lit(10)).cast("int")
        parts.append(F.element_at(F.array(*map(F.lit, _ROMAN[k])), digit + 1))
    return F.when(n > 0, F.concat(*parts))


def roman_value(text: Column) -> Column:
    """Number of a roman numeral in any case, null if it is none."""
    low = F.lower(text)
    whole = f"^{ROMAN}$"
    total = F.length(F.regexp_extract(low, whole, 1)) * 1000
    for k in (2, 1, 0):
        digits = {x.lower(): d * 10**k for d, x in enumerate(_ROMAN[k])}
        total = total + case(F.regexp_extract(low, whole, 4 - k), digits)
    return F.when(low.rlike(whole) & (low != ""), total.cast("int"))


def letters(n: Column, width: int = 7) -> Column:
    """Bijective base 26 in lower case: 1 is a, 27 is aa."""
    state = F.struct(n.cast("long").alias("n"), F.lit("").alias("s"))

    def step(a: Column, _: Column) -> Column:
        low = F.pmod(a["n"] - 1, F.lit(26))
        more = F.concat(F.chr(low + 97), a["s"])
        rest = F.floor((a["n"] - 1) / 26).cast("long")
        return F.when(a["n"] > 0, F.struct(rest.alias("n"), more.alias("s"))).otherwise(a)

    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), F.lit(width)), state, step)["s"])


def letters_value(text: Column) -> Column:
    """Number of a letter sequence: a is 1, z is 26, aa is 27; null beyond 6 letters, which are a word."""
    chars = F.filter(F.split(F.lower(text), ""), lambda c: c != "")
    some = F.aggregate(chars, F.lit(0), lambda n, c: n * 26 + F.ascii(c) - 96)
    return F.when(F.length(text) <= 1, F.when(text != "", F.ascii(F.lower(text)) - 96).otherwise(0)).when(F.length(text) <= 6, some)


def integer(text: Column) -> Column:
    """Digits with optional thousands dots; null if they are too many for a number."""
    return F.replace(text, F.lit("."), F.lit("")).try_cast("int")


def numeral(n: Column) -> Column:
    """Decimal numeral, with thousands dots only above 1000."""
    return F.when(n > 1000, F.translate(F.format_number(n, 0), ",", ".")).otherwise(n.cast("string"))


def ordinal(n: Column) -> Column:
    """Numeral with an ordinal sign below 10."""
    return F.concat(numeral(n), F.when(n < 10, F.lit("º")).otherwise(F.lit("")))


def complement(c: Column) -> Column:
    """Complement as shown: 0 is -A; null is empty."""
    return F.coalesce(F.concat(F.lit("-"), F.upper(letters(c + 1))), F.lit(""))


#: Ordinal words, masculine (fixed values).
_UNITS = ["", "primeiro", "segundo", "terceiro", "quarto", "quinto", "sexto", "sétimo", "oitavo", "nono"]
_TENS = ["", "décimo", "vigésimo", "trigésimo", "quadragésimo", "quinquagésimo", "sexagésimo", "septuagésimo", "octogésimo", "nonagésimo"]


def ordinal_words(n: Column, feminine: bool = False, style: str = "lower") -> Column:
    """Ordinal in words, 1 to 99, else null; style: lower, upper or initial."""
    end = "a" if feminine else "o"
    words = lambda values, d: F.element_at(F.array(*(F.lit(w[:-1] + end if w else "") for w in values)), d.cast("int") + 1)
    text = F.trim(F.concat_ws(" ", words(_TENS, F.floor(n / 10)), words(_UNITS, F.pmod(n, F.lit(10)))))
    shown = {"lower": text, "upper": F.upper(text), "initial": F.initcap(text)}[style]
    return F.when(n.between(1, 99), shown)


def ordinal_word_value(text: Column) -> Column:
    """1 to 10 from a normalised ordinal word of either gender, 1 from unico and unica."""
    stems = ["primeir", "segund", "terceir", "quart", "quint", "sext", "setim", "oitav", "non", "decim"]
    values = {"unico": 1, "unica": 1} | {s + g: i + 1 for i, s in enumerate(stems) for g in "oa"}
    return case(text, values)


# --- dates ------------------------------------------------------------------

#: Names of the months (fixed values).
MONTHS = ["janeiro", "fevereiro", "março", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro"]


def parse_date(text: Column) -> Column:
    """A date written yyyy-mm-dd, else null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date"))


def render_date(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM-dd")


def long_date(date: Column) -> Column:
    """Day, month in words and year."""
    month = F.element_at(F.array(*map(F.lit, MONTHS)), F.month(date))
    return F.concat(F.dayofmonth(date).cast("string"), F.lit(" de "), month, F.lit(" de "), F.year(date).cast("string"))


def parse_timestamp(text: Column) -> Column:
    """A moment written yyyy-mm-ddthh.mm, else null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}t\d{2}\.\d{2}$"), F.try_to_timestamp(F.upper(text), F.lit("yyyy-MM-dd'T'HH.mm")))


def render_timestamp(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd't'HH.mm")


# --- predicates --------------------------------------------------------------

def may_be_title(text: Column) -> Column:
    """No full stop, semicolon or colon."""
    return ~text.rlike("[;.:]")


def is_omission(text: Column) -> Column:
    """Only dots, ellipses, brackets and spaces, with an ellipsis among them."""
    return text.rlike(r"^[\s.…()]*$") & text.rlike(r"…|\.\.\.|\(\.\.\.\)")


#: End of quoted text: a note, a closing mark, a note, either note optional. Groups 1 and 2: the notes.
CLOSING = r"(?:\((ac|nr)\))? ?(?:[”“\"]|'')\s*(?:\((ac|nr)\)\.?)?\s*$"


def closes_quote(norm: Column) -> Column:
    return norm.rlike(CLOSING)


def closing_note(norm: Column) -> Column:
    """ac or nr of the end of quoted text, else null."""
    note = F.concat(F.regexp_extract(norm, CLOSING, 1), F.regexp_extract(norm, CLOSING, 2))
    return F.when(note != "", F.substring(note, 1, 2))


def opens_quote(norm: Column, in_list: bool = False) -> Column:
    return norm.rlike("^[\"“”]" if in_list else "^(?:[\"“”]|'')")


def embolden(text: Column, pattern: str) -> Column:
    """Matches of a pattern between b tags."""
    return F.regexp_replace(text, pattern, "<b>$0</b>")


def escape_xml(text: Column) -> Column:
    out = text
    for c, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(c), F.lit(name))
    return out


def split_patterns(text: Column) -> Column:
    """A list of patterns separated by per cent signs."""
    return F.filter(F.split(text, "%"), lambda p: p != "")
