"""One document's lines in order to its nodes: plain functions, run over Arrow batches of whole documents.

A document takes time in proportion to its lines: what a node stands in is a
list of at most one open provision a level, and numbers are counters.
"""

from __future__ import annotations

import gc
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.json as pj

from normloom.functions import labels as L
from normloom.functions import text as X
from normloom.functions.levels import BY_KIND, closure, direct

#: Kinds of blocks that are no text.
SOLID = ("table", "image")
#: Texts whose reading is kept, of those that come again (items, repeated formulas).
CACHE = 20_000
#: Lines that are nested at once, as far as documents allow.
BATCH = 20_000

_LABEL = {"at": pa.int32(), "kind": pa.string(), "level": pa.int32(), "num": pa.int32(), "comp": pa.int32(), "is_unique": pa.bool_(), "name": pa.string(), "lid": pa.string(), "tag": pa.string()}
_FLAT = {"ctx": pa.int32(), "unit": pa.string(), "title": pa.string(), "content": pa.string(), "open_quote": pa.bool_(), "close_quote": pa.bool_(), "note": pa.string(), "omitted": pa.bool_(), "parent_at": pa.int32(), "parent_level": pa.int32(), "run_parent": pa.int32(), "id": pa.string(), "parent_id": pa.string()}
#: Of the closing tags: whether no node stands in this one, and the elements around that end after it.
_CLOSING = {"leaf": pa.bool_(), "due": pa.list_(pa.string())}
#: Of a node among its siblings and the nodes of its id, for validation.
_AMONG = {"prev_level": pa.int32(), "prev_num": pa.int32(), "prev_comp": pa.int32(), "nth_level": pa.int32(), "n_kind": pa.int32(), "n_numbered": pa.int32(), "numbered": pa.bool_(), "nth_kind": pa.int32(), "n_same": pa.int32(), "forms": pa.int32(), "nth_same": pa.int32()}
RUN = pa.struct([("text", pa.string()), ("b", pa.bool_()), ("i", pa.bool_()), ("sup", pa.bool_()), ("sub", pa.bool_()), ("href", pa.string())])
TYPES = _LABEL | _FLAT | _CLOSING | _AMONG | {"ord": pa.int32(), "runs": pa.list_(RUN), "path": pa.list_(pa.struct(list(_LABEL.items()))), "ancestry": pa.list_(pa.struct([("at", pa.int32()), ("tag", pa.string())]))}
#: Columns of an outline, in order; those of closing tags, siblings and `ord` are given on request.
COLUMNS = ["at", "ctx", "unit", "kind", "level", "num", "comp", "is_unique", "name", "title", "content", "open_quote", "close_quote", "note", "omitted", "runs", "parent_at", "parent_level", "path", "ancestry", "run_parent", "id", "parent_id"]
AMONG = [*_AMONG]

# --- text -------------------------------------------------------------------

_SPACES = "\t\n\x0b\x0c\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_TABLE = {**dict(zip(*X.accent_table())), **dict.fromkeys(X.DASHES, "-"), **dict.fromkeys(map(chr, range(0x300, 0x370)), ""), **dict.fromkeys(_SPACES, " ")}
_NOT_ASCII = re.compile("[^\x00-\x7f]")
_MARKS = "\u0300-\u036f"
_BLANKS = re.compile(r"[ \t\n\x0b\x0c\r]+")
_AFTER_SPACE = re.compile(f"([{_SPACES}])[{_MARKS}]+")
_ANY_SPACES = re.compile(f"[{_SPACES}]+")
_ODD_BLANKS = re.compile(r"[\t\n\x0b\x0c\r]|  ")
_OPENS = re.compile("(?:[\"“”]|'')")
_OPENING = re.compile("^\\s*(?:[\"“”]|'')", re.A)
_CLOSES = re.compile(X.CLOSING, re.A)
_TAIL = re.compile("(?i)(?:\\((?:ac|nr)\\))? ?(?:[”“\"]|'')\\s*(?:\\((?:ac|nr)\\)\\.?)?\\s*$", re.A)
_OMITTED = re.compile(r"[\s.…()]*$", re.A)
_STOP = re.compile("[;.:]")
_ONLY = re.compile(r"1u(?=_|$)")


def _plain(m: re.Match) -> str:
    return _TABLE.get(m[0], m[0])


def normalize(text: str) -> str:
    """As functions.text.normalize."""
    low = text.lower()
    if not low.isascii():
        low = _NOT_ASCII.sub(_plain, low)
    return (_BLANKS.sub(" ", low) if _ODD_BLANKS.search(low) else low).strip(" ")


def squeeze(text: str) -> str:
    """As functions.text.squeeze."""
    one = (_BLANKS.sub(" ", text) if _ODD_BLANKS.search(text) else text).strip(" ")
    return one if one.isascii() else one.replace("“ ", "“").replace(" ”", "”")


@lru_cache(1000)
def _skipped(taken: int) -> re.Pattern:
    return re.compile(f"^[{_MARKS}]*(?:[^{_MARKS}][{_MARKS}]*){{{taken}}}")


# --- labels: the grammar of functions.labels, alternatives told apart by how a text starts --------

_P = {name: re.compile(getattr(L, name) + L._TAIL, re.A) for name in ("ARTICLE", "PARAGRAPH_WORD", "PARAGRAPH", "CLAUSE", "LETTER", "ITEM", "PENALTY", "OTHER", "PART", "BOOK", "GROUPING")}
_ROMAN = re.compile(X.ROMAN)
_VALUE = {"m": 1000, "d": 500, "c": 100, "l": 50, "x": 10, "v": 5, "i": 1}
_ORDINALS = {s: k + 1 for k, s in enumerate(["primeir", "segund", "terceir", "quart", "quint", "sext", "setim", "oitav", "non", "decim"])} | {"unic": 1}


def _integer(text: str) -> int | None:
    n = int(text.replace(".", ""))
    return n if n < 2**31 else None


@lru_cache(10_000)
def _roman(text: str) -> int | None:
    if not text or not _ROMAN.fullmatch(text):
        return None
    n = [_VALUE[c] for c in text]
    return sum(-a if a < b else a for a, b in zip(n, [*n[1:], 0]))


def _letters(text: str) -> int | None:
    if len(text) > 6:
        return None
    n = 0
    for c in text:
        n = n * 26 + ord(c) - 96
    return n


def _comp(text: str | None) -> int | None:
    n = _letters(text) if text else None
    return None if n is None else n - 1


def parse(norm: str, compatible: bool = False) -> tuple[tuple, int] | None:
    """(kind, level, num, comp, is_unique, name), characters taken: as functions.labels.parse."""
    if not norm:
        return None
    c = norm[0]
    if c == "a" and (m := _P["ARTICLE"].match(norm)):
        return ("article", 110, _ORDINALS[m[1]] if m[1] else _integer(m[2]), _comp(m[3]), m[1] == "unic", None), m.end()
    if c == "p" and (m := _P["PARAGRAPH_WORD"].match(norm)):
        return ("paragraph", 120, _ORDINALS[m[1]], _comp(m[2]), m[1] == "unic", None), m.end()
    if c == "§" and (m := _P["PARAGRAPH"].match(norm)):
        return ("paragraph", 120, _integer(m[1]), _comp(m[2]), False, None), m.end()
    if c in "mdclxvi" and (m := _P["CLAUSE"].match(norm)):
        return ("clause", 130, _roman(m[1]), _comp(m[6]), False, None), m.end()
    if ")" in norm and (m := _P["LETTER"].match(norm)):
        return ("letter", 140, _letters(m[1]) if m[1] else int(m[2]), _comp(m[3]), False, None), m.end()
    if "0" <= c <= "9":
        m = _P["ITEM"].match(norm)
        return ("item", 150, _integer(m[1]), _comp(m[2]), False, None), m.end()
    if c in "pim" and "-" in norm:
        if m := _P["PENALTY"].match(norm):
            return ("penalty", 160, None, None, False, None), m.end()
        if m := _P["OTHER"].match(norm):
            return ("generic", 160, 0, None, False, m[1].title()), m.end()
    if c == "p" and (m := _P["PART"].match(norm)):
        return ("part", 10, 1 if m[1] else _ORDINALS[m[2]] if m[2] else None, _comp(m[4]), bool(m[1]) or m[2] == "unic", m[3].upper() if m[3] else None), m.end()
    if c == "l" and (m := _P["BOOK"].match(norm)):
        n = _roman(m[1])
        return ("book", 20, n, _comp(m[2]), False, m[1].upper() if n is None else None), m.end()
    if c in "tsc" and (m := _P["GROUPING"].match(norm)):
        kind = "chapter" if compatible and m[1] == "subcapitulo" else L._GROUPING[m[1]]
        return (kind, BY_KIND[kind].level, 1 if m[2] else _roman(m[3]), _comp(m[8]), bool(m[2]), None), m.end()
    return None


_BELOW = {110: "clause", 120: "clause", 130: "letter", 140: "item"}
_NUMBERED = frozenset(x.kind for x in BY_KIND.values() if x.many)


def _lid(kind: str, num: int | None, comp: int | None, unique: bool) -> str | None:
    if kind == "penalty":
        return "pena"
    if kind == "paragraph" and num is None:
        return "cpt"
    if kind not in BY_KIND:
        return None
    return f"{BY_KIND[kind].prefix}{'' if num is None else num}{'u' if unique else ''}{'' if comp is None else f'-{comp + 1}'}"


# --- lines ------------------------------------------------------------------

class Line:
    __slots__ = ("pos", "raw", "item", "solid", "runs", "source", "norm", "inside", "open_quote", "close_quote", "note", "first", "ctx", "kind", "level", "num", "comp", "is_unique", "name", "content", "omitted", "unit", "last", "texts", "pieces", "heading", "title", "is_title")


def _run(text: str) -> dict:
    return {"text": text, "b": False, "i": False, "sup": False, "sub": False, "href": None}


def _cut(runs: list[dict], at: int, n: int) -> list[dict]:
    """Runs of n characters from a character on."""
    out = []
    for r in runs:
        size = len(r["text"])
        text = r["text"][max(at, 0) : max(at + n, 0)]
        if text:
            out.append(r | {"text": text})
        at -= size
    return out


def _merged_runs(pieces: list[dict]) -> list[dict]:
    out: list[dict] = []
    for r in pieces:
        if out and r | {"text": ""} == out[-1] | {"text": ""}:
            out[-1] = r | {"text": out[-1]["text"] + r["text"]}
        else:
            out.append(r)
    return out


@lru_cache(CACHE)
def _seen(raw: str) -> tuple[str, str, bool, bool, str | None]:
    """A text in NFC, normalised, whether it opens and closes a quote, and the note where it closes one."""
    if not raw.isascii() and not unicodedata.is_normalized("NFC", raw):
        raw = unicodedata.normalize("NFC", raw)
    norm = normalize(raw)
    opens = norm[:1] in ("'", '"', "“", "”") and _OPENS.match(norm) is not None
    closing = _CLOSES.search(norm) if '"' in norm or "”" in norm or "“" in norm or "''" in norm else None
    note = closing and (closing[1] or closing[2])
    return raw, norm, opens, closing is not None, note.upper() if note else None


@lru_cache(CACHE)
def _labelled(raw: str, norm: str, compatible: bool) -> tuple[tuple, int, str, bool]:
    """The label at the start of a text, the characters it takes, what follows, and whether that is an omission."""
    found = parse(norm, compatible)
    own, taken = found or (_NO_LABEL, 0)
    content = squeeze(raw) if found is None else _after(raw, norm, taken)
    return own, taken, content, _is_omission(content)


_NO_LABEL = (None,) * 6


def _is_omission(content: str) -> bool:
    return ("…" in content or "..." in content) and _OMITTED.match(content) is not None


def _after(raw: str, norm: str, taken: int) -> str:
    squeezed = squeeze(raw)
    if len(squeezed) == len(norm):
        return squeezed[taken:].strip(" ")
    # the label ends at the same character, combining marks that normalising took out not counted
    spaced = _ANY_SPACES.sub(" ", _AFTER_SPACE.sub(r"\1", raw)).strip(" ")
    return squeeze(_skipped(taken).sub("", spaced))


@lru_cache(CACHE)
def _read(raw: str, compatible: bool) -> tuple:
    """A text outside of quotes: in NFC, normalised, whether it opens and closes a quote, the note, and as _labelled."""
    raw, norm, opens, closes, note = _seen.__wrapped__(raw)
    own, _, content, omission = _labelled.__wrapped__(raw.strip(" "), norm, compatible)
    return raw, norm, opens, closes, note, own, content, omission


@lru_cache(CACHE)
def _unquoted(raw: str, opens: bool, closes: bool, compatible: bool) -> tuple:
    """A text without the quotes that it opens and closes: as _labelled, without the characters taken."""
    if opens:
        raw = _OPENING.sub("", raw)
    if closes:
        raw = _TAIL.sub("", raw)
    own, _, content, omission = _labelled.__wrapped__(raw.strip(" "), normalize(raw), compatible)
    return own, content, omission


def read(raws: list[str], compatible: bool) -> list[Line]:
    """As quoted and recognised, of lines that are nothing but text."""
    out: list[Line] = []
    opened = was_inside = was_closed = was_blank = kept_inside = False
    ctx = 0
    for pos, raw in enumerate(raws):
        raw, norm, opens, closes, note, own, content, omission = _read(raw, compatible)
        x = Line()
        if opens or opened:
            opened = not closes
            open_quote = not was_inside or was_closed
            blank = norm == ""
            keep = not blank or was_blank
            was_inside, was_closed, was_blank = True, closes, blank
            if not keep:
                continue
            x.open_quote, x.close_quote, x.note = open_quote, closes, note if closes else None
            x.first = not kept_inside
            kept_inside = True
            ctx += x.first
            x.ctx = ctx
            if open_quote or closes:
                own, content, omission = _unquoted(raw, open_quote, closes, compatible)
            if content == "" and (own[0] is None or own[1] > 110):
                omission = True
        else:
            was_inside, was_closed, was_blank = False, closes, norm == ""
            if was_blank:
                continue
            x.open_quote = x.close_quote = x.first = kept_inside = False
            x.note, x.ctx = None, 0
        x.pos, x.solid, x.runs = pos, None, None
        x.kind, x.level, x.num, x.comp, x.is_unique, x.name = own
        x.content, x.omitted = content, omission
        x.unit = "provision" if x.kind is not None else "omission" if omission else "paragraph"
        out.append(x)
    return out


def quoted(rows: list[tuple], styled: bool) -> list[Line]:
    """Lines with their quoted runs marked, blank ones taken out and runs numbered."""
    out: list[Line] = []
    opened = False  # a quote is open after the line before
    was_inside = was_closed = was_blank = kept_inside = False
    ctx = 0
    for pos, raw, item, block, runs in rows:
        solid = block if block in SOLID else None
        if raw is None:
            if not solid:
                continue
            raw = ""
        raw, norm, opens, closes, note = _seen(raw)
        inside = opens or opened
        opened = inside and not closes
        blank = norm == "" and not solid
        keep = not blank or (was_blank and inside)
        open_quote = inside and not (was_inside and not was_closed)
        was_inside, was_closed, was_blank = inside, closes, blank
        if not keep:
            continue
        x = Line()
        x.pos, x.item, x.solid, x.runs, x.inside, x.open_quote = pos, item, solid, runs, inside, open_quote
        x.source = raw if styled else None
        x.close_quote = inside and closes
        x.note = note if x.close_quote else None
        x.first = inside and not kept_inside
        kept_inside = inside
        ctx += x.first
        x.ctx = ctx if inside else 0
        if open_quote or x.close_quote:
            if open_quote:
                raw = _OPENING.sub("", raw)
            if x.close_quote:
                raw = _TAIL.sub("", raw)
            norm = normalize(raw)
        x.raw, x.norm = raw.strip(" "), norm
        out.append(x)
    return out


def recognised(lines: list[Line], styled: bool, compatible: bool) -> None:
    """Labels, content and unit of each line."""
    level = None  # of the last label that is no element of a list
    for x in lines:
        if x.solid:
            own, taken, content = _NO_LABEL, 0, squeeze(x.raw)
            omission = _is_omission(content)
        else:
            own, taken, content, omission = _labelled(x.raw, x.norm, compatible)
        if x.item is not None:
            kind = _BELOW.get(level)
            own, taken = ((kind, BY_KIND[kind].level, x.item, None, False, None) if kind else _NO_LABEL), 0
            content = _after(x.raw, x.norm, 0)
            omission = _is_omission(content)
        elif own[1] is not None:
            level = own[1]
        x.kind, x.level, x.num, x.comp, x.is_unique, x.name = own
        x.content = content
        if styled:
            at = x.source.find(content, taken)
            if content and at >= 0:
                x.runs = None if x.runs is None else _cut(x.runs, at, len(content))
            else:
                x.runs = [_run(content)]
        x.omitted = omission or (x.ctx > 0 and content == "" and (x.kind is None or x.level > 110))
        x.unit = x.solid or ("provision" if x.kind is not None else "omission" if x.omitted else "paragraph")


def _grouping(x: Line) -> bool:
    return x.unit == "provision" and x.level < 110


def merged(lines: list[Line], styled: bool) -> list[Line]:
    """Join lines that belong together: repeated omissions, names of groupings, and text that goes on.

    A paragraph goes on from a provision if that ends in a comma, semicolon or
    dash, or if it starts in lower case itself; paragraphs after a grouping are
    its name.  A paragraph without stop before a provision is its title.
    """
    heads: list[Line] = []
    prev, grouped, head = None, None, None
    for x in lines:
        unit = x.unit
        joins = False
        if unit != "paragraph":
            grouped = unit == "provision" and x.level < 110
        if unit != "provision" and prev is not None and prev.ctx == x.ctx and not prev.close_quote:
            if unit == "omission":
                joins = prev.unit == "omission"
            elif unit == "paragraph" and not x.open_quote:
                if grouped:
                    joins = True
                elif grouped is not None:
                    going_on = prev.content[-1:] in (",", ";", "-") and prev.content != "" and prev.unit not in SOLID
                    joins = going_on or (x.content != "" and unicodedata.category(x.content[0]) == "Ll")
        pieces = None
        if styled:
            pieces = ([_run(" ")] if joins and x.content != "" else []) + (x.runs or [])
        if not joins:
            head = x
        # an island that a stray paragraph heads falls apart again
        if not joins or head.unit == "paragraph":
            heads.append(x)
            # no line holds itself: nothing would free it while the collector is off
            x.last, x.texts, x.pieces = None, None, pieces
        else:
            if head.texts is None:
                head.texts = [head.content]
            head.texts.append(x.content)
            head.last = x
            if styled:
                head.pieces += pieces
        prev = x
    out: list[Line] = []
    title = None
    for k, x in enumerate(heads, 1):
        if x.texts is not None:
            x.close_quote, x.note = x.last.close_quote, x.last.note
            if x.unit != "omission":
                x.content = " ".join(t for t in x.texts if t)
        x.heading = x.title = None
        if _grouping(x):
            x.heading, x.content = x.content or None, ""
        if styled:
            pieces = [r for r in x.pieces if r["text"] != ""]
            x.runs = _merged_runs(pieces[1:] if pieces and pieces[0]["text"] == " " else pieces)
        if x.unit == "paragraph" and k < len(heads) and x.content != "" and not x.close_quote and heads[k].unit == "provision" and heads[k].ctx == x.ctx and not _STOP.search(x.content):
            title = x
            continue
        if title is not None:
            x.title, x.open_quote, x.first = title.content, x.open_quote or title.open_quote, x.first or title.first
            title = None
        out.append(x)
    return out


# --- nodes ------------------------------------------------------------------

#: What a node is kept as, in this order.
_KEPT = ["at", "ctx", "unit", "kind", "level", "num", "comp", "is_unique", "name", "title", "content", "open_quote", "close_quote", "note", "omitted", "runs", "lid", "tag", "parent_at", "parent_level", "run_parent", "id", "parent_id", "ord"]


def listed(lines: list[Line]) -> list[tuple]:
    """Nodes before they are nested: an article becomes two (itself and its caput), a run gets its amendment.

    at, ctx, unit, kind, level, num, comp, unique, name, title, content, open, close, note, omitted, runs, part_text
    """
    nodes: list[tuple] = []
    for x in lines:
        at = 4 * x.pos
        if x.first:
            nodes.append((at - 1, 0, "amendment", "amendment", 1000, None, None, False, None, None, "", False, False, None, False, None, None))
        name = x.name if x.heading is None else x.heading
        if x.kind == "article":
            nodes.append((at, x.ctx, x.unit, "article", 110, x.num, x.comp, x.is_unique, name, x.title, "", x.open_quote, False, None, False, None, x.name))
            nodes.append((at + 1, x.ctx, "provision", "paragraph", 120, None, None, False, None, None, x.content, False, x.close_quote, x.note, x.omitted, x.runs, None))
        else:
            nodes.append((at, x.ctx, x.unit, x.kind or x.unit, x.level, x.num, x.comp, bool(x.is_unique), name, x.title, x.content, x.open_quote, x.close_quote, x.note, x.omitted, x.runs, x.name))
    return nodes


class Nodes:
    """Columns of the nodes of whole documents; paths and ancestries as numbers of nodes."""

    def __init__(self, columns: list[str]) -> None:
        self.columns = columns
        self.wants = set(columns)
        self.doc_id: list = []
        self.rows: list[tuple] = []
        self.values: dict[str, list] = {c: [] for c in [*_AMONG, "leaf", "due"]}
        self.path, self.path_ends = [], [0]
        self.chain, self.chain_ends = [], [0]

    def batches(self, doc_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        yield self.batch(doc_type)

    def batch(self, doc_type: pa.DataType) -> pa.RecordBatch:
        v = dict(zip(_KEPT, zip(*self.rows))) if self.rows else dict.fromkeys(_KEPT, ())
        v |= self.values
        arrays = {"doc_id": pa.array(self.doc_id, doc_type)}
        cache = {}

        def flat(c: str) -> pa.Array:
            if c not in cache:
                cache[c] = pa.array(v[c], TYPES[c])
            return cache[c]

        for c in self.columns:
            if c in ("path", "ancestry"):
                names = list(_LABEL) if c == "path" else ["at", "tag"]
                taken, ends = (self.path, self.path_ends) if c == "path" else (self.chain, self.chain_ends)
                structs = pa.StructArray.from_arrays([flat(n) for n in names], names)
                arrays[c] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs.take(pa.array(taken, pa.int32())))
            else:
                arrays[c] = flat(c)
        return pa.RecordBatch.from_arrays(list(arrays.values()), list(arrays))

    def add(self, doc, lines: list[Line]) -> None:
        """Nest a document's lines."""
        self._nest(doc, listed(lines))

    def _nest(self, doc, nodes: list[tuple]) -> None:
        base = len(self.rows)
        append = self.rows.append
        wants_path = "path" in self.wants
        wants_leaf = "leaf" in self.wants
        wants_chain = wants_leaf or "ancestry" in self.wants
        # for omissions: the level of the provision that follows within a run or between two stray paragraphs
        following: dict[int, int] = {}
        if any(n[2] == "omission" for n in nodes):
            seen: dict = {}
            for k in range(len(nodes) - 1, -1, -1):
                ctx, unit = nodes[k][1:3]
                if unit == "omission":
                    following[k] = seen.get(ctx) or 0
                elif unit == "provision":
                    seen[ctx] = nodes[k][4]
                elif unit == "paragraph":
                    for c in [c for c in seen if (c > 0) == (ctx > 0)]:
                        del seen[c]
        # open provisions of each run, and outside of all: level, at, id, path, and the numbers of the nodes around those in them
        stacks: dict[int, list[tuple]] = {0: []}
        counters: dict[tuple, int] = {}
        n_parts = part_num = part_nth = 0
        fixed_part = False
        last_any = last_level = run_at = None
        run = (None, None, "", [], [])
        none: list[int] = []
        inner = none
        self.chains = chains = []
        for k, (at, ctx, unit, kind, level, num, comp, unique, name, title, content, opens, closes, note, omitted, runs, part_text) in enumerate(nodes):
            me = base + k
            if ctx not in stacks:
                stacks[ctx] = []
            stack = stacks[ctx]
            up = None  # the nearest of the open provisions around
            if unit == "provision":
                while stack and stack[-1][0] >= level:
                    stack.pop()
                if stack:
                    up = stack[-1]
                if kind == "part":
                    # parts: GERAL is 1, ESPECIAL 2, other names the number before plus one
                    n_parts += 1
                    given = num if num is not None else 1 if part_text == "GERAL" else 2 if part_text == "ESPECIAL" else None
                    if given is not None:
                        fixed_part, part_num, part_nth = True, given, n_parts
                    num = part_num + n_parts - part_nth if fixed_part else n_parts
                tag = ("Caput" if num is None else "Paragrafo") if kind == "paragraph" else L.ELEMENTS[kind]
            elif unit == "amendment":
                tag = "Alteracao"
                run_at = at
                if stack:
                    up = stack[-1]
            elif unit == "omission":
                tag = "Omissis"
                depth = following[k] if following[k] > 110 else 115
                up = next((x for x in reversed(stack) if x[0] < depth), None)
            elif unit == "paragraph":
                # a stray paragraph ends the reach of the provisions before it
                tag = "p"
                for c, open_ in stacks.items():
                    if (c > 0) == (ctx > 0):
                        open_.clear()
            else:
                tag = unit
            if unit == "amendment":
                parent, parent_level = last_any, last_level
            elif up is not None:
                parent, parent_level = up[1], up[0]
            else:
                parent = run_at if ctx > 0 else None
                parent_level = None if parent is None else 1000
            # units are named from their article on, or from what is outermost
            whole = up or (run if ctx > 0 else None)
            ids = "" if whole is None else whole[2]
            node_id = None
            if unit == "provision" or unit == "amendment":
                if kind == "generic" or kind == "amendment":
                    num = counters[parent, kind] = counters.get((parent, kind), 0) + 1
                lid = _lid(kind, num, comp, unique)
                if level == 110:
                    whole = run if ctx > 0 else None
                    ids = "" if whole is None else whole[2]
                node_id = ids = f"{ids}_{lid}" if ids else lid
            else:
                lid = None
                if unit == "omission":
                    nth = counters[parent, kind] = counters.get((parent, kind), 0) + 1
                    node_id = f"{ids}_omi{nth}"
            path = None
            if wants_path:
                path = [] if whole is None else whole[3]
                if node_id is not None and unit != "omission":
                    path = [*path, me]
                self.path += path
                self.path_ends.append(len(self.path))
            if wants_chain:
                around = up or (run if ctx > 0 else None)
                chain = none if around is None else around[4]
                chains.append(chain)
                inner = [*chain, me]
            if unit == "provision":
                if ctx == 0:
                    last_any, last_level = at, level
                stack.append((level, at, ids, path, inner))
            elif unit == "amendment":
                run = (level, at, ids, path, inner)
            append((at, ctx, unit, kind, level, num, comp, unique, name, title, content, opens, closes, note, omitted, runs, lid, tag, parent, parent_level, run_at if ctx > 0 else None, node_id, ids if unit == "paragraph" else None, k + 1))
        self.doc_id += [doc] * len(nodes)
        if "ancestry" in self.wants:
            for chain in chains:
                self.chain += chain
                self.chain_ends.append(len(self.chain))
        if wants_leaf:
            leaf, due = self.values["leaf"].append, self.values["due"].append
            tags = [r[17] for r in self.rows[base:]]
            for k, (chain, after) in enumerate(zip(chains, [*chains[1:], none])):
                if after is chain:
                    leaf(True)
                    due(none)
                    continue
                kept, most = len(chain), len(after)
                while kept > 0 and (kept > most or after[kept - 1] != chain[kept - 1]):
                    kept -= 1
                leaf(not (most > len(chain) and after[len(chain)] == base + k))
                due([tags[i - base] for i in reversed(chain[kept:])])
        if "n_same" in self.wants:
            self._among(base)

    def _among(self, base: int) -> None:
        """The sibling before, counts of siblings, equal ids."""
        out = self.values
        rows = self.rows[base:]
        v = dict(zip(_KEPT, zip(*rows)))
        n = range(len(rows))
        before, nth_level, kinds, numbered_of = {}, Counter(), defaultdict(int), Counter()
        same_of, forms, keys = Counter(), defaultdict(set), {}
        for i in n:
            provision = v["unit"][i] == "provision"
            ranked = provision and v["ctx"][i] == 0
            group = (ranked, v["parent_at"][i])
            last = before.get(group) if ranked else None
            before[group] = i
            for c in ("level", "num", "comp"):
                out[f"prev_{c}"].append(None if last is None else v[c][last])
            nth_level[group, v["level"][i]] += 1
            out["nth_level"].append(nth_level[group, v["level"][i]])
            kind = v["kind"][i]
            kinds[group, kind] += 1
            out["nth_kind"].append(kinds[group, kind])
            numbered = kind in _NUMBERED and not (kind == "paragraph" and v["num"][i] is None)
            out["numbered"].append(numbered)
            numbered_of[group, kind] += numbered
            key = _ONLY.sub("1", v["id"][i]) if provision else None
            keys[i] = key
            same_of[key] += 1
            forms[key].add(v["id"][i])
            out["nth_same"].append(same_of[key])
        for i in n:
            group = ((v["unit"][i] == "provision" and v["ctx"][i] == 0), v["parent_at"][i]), v["kind"][i]
            out["n_kind"].append(kinds[group])
            out["n_numbered"].append(numbered_of[group])
            out["n_same"].append(0 if keys[i] is None else same_of[keys[i]])
            out["forms"].append(len(forms[keys[i]] - {None}))


#: What follows the last amendment of an id: as functions.norms.link_target.
_TARGET = re.compile(r".*_alt[0-9]+_(.*)")


class Made:
    """Rows made of each document's nodes, of the columns and types of a subclass."""

    TYPES: dict[str, pa.DataType] = {}
    #: Columns of nodes without which a row can't be made.
    NEEDS: list[str] = []

    def __init__(self, columns: list[str]) -> None:
        self.columns = columns
        self.doc_id: list = []
        self.rows: list[tuple] = []

    def add(self, doc, lines: list[Line]) -> None:
        nodes = Nodes(self.NEEDS)
        nodes.add(doc, lines)
        rows = self.of(nodes)
        self.rows += rows
        self.doc_id += [doc] * len(rows)

    def of(self, nodes: Nodes) -> list[tuple]:
        raise NotImplementedError

    def batches(self, doc_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        yield self.batch(doc_type)

    def batch(self, doc_type: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) if self.rows else [()] * len(self.columns)
        arrays = [pa.array(self.doc_id, doc_type), *(pa.array(v, self.TYPES[c]) for c, v in zip(self.columns, columns))]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", *self.columns])


class Runs(Made):
    """Each amendment: where it is, the provision around and its text, and what the ids of its own provisions point to."""

    TYPES = {"run_parent": pa.int32(), "parent_at": pa.int32(), "around": pa.string(), "fragments": pa.list_(pa.string())}

    def of(self, nodes: Nodes) -> list[tuple]:
        out: dict[int, tuple] = {}
        texts: dict[int, str] = {}
        for r in nodes.rows:
            at, ctx, unit = r[:3]
            if unit == "amendment":
                out[at] = (at, r[18], texts.get(r[18]), {})
            elif unit == "provision":
                if ctx > 0:
                    m = _TARGET.match(r[21])
                    out[r[20]][3][m and m[1]] = None
                else:
                    texts[at] = r[10]
        return [(*x, list(fragments)) for *x, fragments in out.values()]


# --- labels as text -----------------------------------------------------------

def _letters_text(n: int) -> str | None:
    """Bijective base 26 of at most seven letters, as functions.text.letters."""
    if n <= 0:
        return None
    out = ""
    while n > 0 and len(out) < 7:
        n, low = divmod(n - 1, 26)
        out = chr(97 + low) + out
    return out


def _numeral(n: int) -> str:
    return f"{n:,}".replace(",", ".") if n > 1000 else str(n)


def _roman_text(n: int) -> str | None:
    return "M" * (n // 1000) + "".join(X._ROMAN[k][n // 10**k % 10] for k in (2, 1, 0)) if n > 0 else None


@lru_cache(CACHE)
def display(kind: str, num: int | None, comp: int | None, unique: bool, name: str | None) -> str | None:
    """As functions.labels.display, spaces at the ends taken off."""
    if kind == "penalty":
        return "Pena –"
    if kind == "amendment" or (kind == "paragraph" and num is None):
        return ""
    if kind == "generic":
        return None if name is None else f"{name} –".strip(" ")
    if kind == "article" and unique:
        return "Artigo único."
    if kind == "paragraph" and unique:
        return "Parágrafo único."
    letters = None if comp is None else _letters_text(comp + 1)
    c = "" if letters is None else "-" + letters.upper()
    roman = None if num is None or num <= 0 else _roman_text(num) + c
    if kind in ("article", "paragraph", "letter", "item"):
        if num is None:
            return None
        if kind == "letter":
            return None if num <= 0 else f"{_letters_text(num)}{c})"
        if kind == "item":
            return f"{num}{c}."
        return f"{'Art.' if kind == 'article' else '§'} {_numeral(num)}{'º' if num < 10 else ''}{c}{'' if num < 10 and comp is None else '.'}"
    if kind == "clause":
        return None if roman is None else f"{roman} –"
    if kind not in BY_KIND:
        return None
    only = "Única" if kind in ("section", "subsection") else "ÚNICA" if kind == "part" else "ÚNICO"
    shown = only if unique else roman if name is None else name
    return None if shown is None else f"{BY_KIND[kind].word} {shown}".strip(" ")


def shown_label(r: tuple) -> str:
    """The label of a provision as printed, empty where it has none."""
    named = r[8] if r[5] is None and r[3] in ("part", "book", "generic") else None
    return display(r[3], r[5], r[6], r[7], named) or ""


def path_text(path: list[tuple]) -> str | None:
    """As functions.labels.path_text, of nodes from the root on."""
    out, unit = "", False
    for r in reversed(path):
        kind, num = r[3], r[5]
        one = "caput" if kind == "paragraph" and num is None else f"alteração {num}" if kind == "amendment" else display(kind, num, r[6], r[7], r[8])
        if one is None or kind not in BY_KIND:
            return None
        group = r[4] < 110
        if out == "":
            out = one
        elif group and unit:
            out += f" ({BY_KIND[kind].in_} {one})"
        else:
            out += f" {BY_KIND[kind].of} {one}"
        unit = not group
    return out


# --- bodies -------------------------------------------------------------------

def escape(text: str) -> str:
    if "&" in text:
        text = text.replace("&", "&amp;")
    if "<" in text:
        text = text.replace("<", "&lt;")
    if ">" in text:
        text = text.replace(">", "&gt;")
    return text.replace('"', "&quot;") if '"' in text else text


class Bodies(Made):
    """The body of each document: pieces of its nodes with the closing tags that are due after each."""

    TYPES = {"body": pa.string()}
    NEEDS = ["leaf"]

    def piece(self, r: tuple) -> tuple[str, str]:
        """The opening of a node with its text, and the name of its element."""
        raise NotImplementedError

    def of(self, nodes: Nodes) -> list[tuple]:
        out = []
        chains, names = nodes.chains, []
        for k, r in enumerate(nodes.rows):
            opening, name = self.piece(r)
            names.append(name)
            out.append(opening)
            chain, after = chains[k], chains[k + 1] if k + 1 < len(chains) else ()
            if after is chain:
                out.append(f"</{name}>")
                continue
            kept, most = len(chain), len(after)
            while kept > 0 and (kept > most or after[kept - 1] != chain[kept - 1]):
                kept -= 1
            if not (most > len(chain) and after[len(chain)] == k):
                out.append(f"</{name}>")
            out += [f"</{names[i]}>" for i in reversed(chain[kept:])]
        return [("".join(out),)] if nodes.rows else []


@lru_cache(CACHE)
def _xml_label(kind: str, num: int | None, comp: int | None, unique: bool, name: str | None) -> str:
    label = display(kind, num, comp, unique, name)
    return f"<Rotulo>{escape(label)}</Rotulo>" if label else ""


class XmlBodies(Bodies):
    """Nested XML."""

    def piece(self, r: tuple) -> tuple[str, str]:
        _, _, unit, kind, level, num, comp, unique, name, title, content, opens, closes, note, omitted, _, _, tag, _, _, _, node_id, _, _ = r
        out = "<" + tag if node_id is None else f'<{tag} id="{escape(node_id)}"'
        if omitted:
            out += ' textoOmitido="s"'
        if opens:
            out += ' abreAspas="s"'
        if closes:
            out += ' fechaAspas="s"'
        out += ">" if note is None else f' notaAlteracao="{escape(note.upper())}">'
        if title:
            out += f"<TituloDispositivo>{escape(title)}</TituloDispositivo>"
        if unit == "provision":
            out += _xml_label(kind, num, comp, unique, name if num is None and kind in ("part", "book", "generic") else None)
            if level < 110 and name:
                out += f"<NomeAgrupador>{escape(name)}</NomeAgrupador>"
            if content and not omitted:
                out += f"<p>{escape(content)}</p>"
        elif unit == "paragraph":
            out += escape(content)
        elif unit == "table":
            out += f"<tr><td>{escape(content)}</td></tr>"
        return out, tag


class HtmlBodies(Bodies):
    """Nested HTML, all of div elements."""

    def piece(self, r: tuple) -> tuple[str, str]:
        _, _, unit, kind, level, _, _, _, name, title, content, opens, closes, note, _, _, _, _, _, _, _, node_id, _, _ = r
        out = f'<div class="{kind}">' if node_id is None else f'<div class="{kind}" id="{escape(node_id)}">'
        label = shown_label(r) if unit == "provision" else ""
        lead = "" if title is None else f'<span class="title">{escape(title)}</span> '
        if label:
            lead += f'<span class="label">{escape(label)}</span> '
        quoted = f"{'“' if opens else ''}{(name if level is not None and level < 110 else content) or ''}{'”' if closes else ''}{'' if note is None else f' ({note})'}"
        return f"{out}<p>{lead}{escape(quoted)}</p>" if quoted else out + lead, "div"


# --- problems -----------------------------------------------------------------

_DIRECT, _CLOSURE = direct(), closure()
_LIST = re.compile(r"<(?:ol|li)\b")


def _may_be_first(level: int, num: int | None, comp: int | None, name: str | None) -> bool:
    """As functions.levels.may_be_first."""
    if level in (110, 160):
        return True
    if level == 120:
        return num is None
    return (num == 1 and comp is None) or (level in (10, 20) and num is None and name is not None)


def _follows(level: int, num: int | None, comp: int | None, before_num: int | None, before_comp: int | None) -> bool:
    """As functions.levels.follows, of siblings of one level."""
    if level in (10, 20, 1000):
        return True
    if num is None:
        return False
    if before_num is None:
        return level == 120 and num == 1 and comp is None
    if comp is None:
        return num == before_num + 1 or (level == 140 and before_num == 10 and num == 12 and before_comp is None)
    return num == before_num and comp == (0 if before_comp is None else before_comp + 1)


class Problems(Made):
    """The rules that nodes break, as operators.validate.rules has them: code, at, position, rule."""

    TYPES = {"code": pa.int32(), "at": pa.int32(), "position": pa.string(), "rule": pa.string()}
    NEEDS = ["path"]

    def of(self, nodes: Nodes) -> list[tuple]:
        rows, ends = nodes.rows, nodes.path_ends
        out: list[tuple] = []

        def path(k: int) -> list[tuple]:
            return [rows[i] for i in nodes.path[ends[k] : ends[k + 1]]]

        def hit(code: int, rule: str) -> None:
            out.append((code, r[0], r[21] if r[21] is not None else path_text(path(k)), rule))

        before: dict = {}  # of the siblings: the last provision
        levels: set = set()
        kinds: dict = {}
        only: list[int] = []
        ids: list[tuple] = []  # key, number
        for k, r in enumerate(rows):
            at, ctx, unit, kind, level, num, comp, unique, name = r[:9]
            content = r[10]
            if unit == "provision":
                node_id = r[21]
                ids.append((_ONLY.sub("1", node_id) if "1u" in node_id else node_id, k))
                if ctx == 0:
                    parent = r[18]
                    last = before.get(parent)
                    before[parent] = r
                    kinds[parent, kind] = kinds.get((parent, kind), 0) + 1
                    if unique:
                        only.append(k)
                    if last is not None and last[4] == level:
                        n, c = last[5:7]
                        key, was = (-1 if num is None else num, -1 if comp is None else comp), (-1 if n is None else n, -1 if c is None else c)
                        if was > key:
                            hit(2, "inverted_order")
                        else:
                            if was == key and kind != "penalty" and kind != "generic":
                                hit(5, "repeated_label")
                            if level != 160 and not _follows(level, num, comp, n, c):
                                hit(3, "discontinuity")
                    elif (parent, level) not in levels and not _may_be_first(level, num, comp, name):
                        hit(4, "bad_first")
                    levels.add((parent, level))
                if kind == "letter":
                    around = path(k)
                    if len(around) > 1:
                        kind_around = next((x[3] for x in reversed(around) if x[4] != 140), None)
                        if kind_around is not None and kind_around not in ("clause", "amendment"):
                            hit(7, "letter_not_under_clause")
            elif unit == "amendment":
                if sum(x[3] == "amendment" for x in path(k)) > 1:
                    hit(7, "nested_amendment")
            elif unit == "paragraph":
                hit(16, "stray_text")
            if (unit == "provision" or unit == "amendment") and r[19] is not None and (r[19], level) not in _DIRECT:
                if ctx == 0:
                    hit(7, "bad_position")
                elif r[19] < 1000 and (r[19], level) not in _CLOSURE:
                    hit(7, "bad_position_in_amendment")
            if ctx == 0 and (r[14] or unit == "omission"):
                hit(20, "omission_outside")
            tagged = content is not None and "<" in content
            if kind == "table" or (tagged and "<table" in content.lower()):
                hit(21, "table")
            if tagged and _LIST.search(content.lower()):
                hit(18, "list_markup")
        for k in only:
            r = rows[k]
            if kinds[r[18], r[3]] > BY_KIND[r[3]].many:
                hit(6, "unique_not_alone")
        same: dict[str, list[int]] = {}
        if len({key for key, _ in ids}) < len(ids):
            for key, k in ids:
                same.setdefault(key, []).append(k)
        for alike in same.values():
            k = alike[0]
            r = rows[k]
            if len(alike) > 1 and not (r[1] > 0 and r[3] == "paragraph" and len(alike) == 2 and len({rows[i][21] for i in alike}) == 2):
                hit(19, "repeated_path")
        return out


class Paths(Made):
    """Each node with its path as text."""

    TYPES = {"ctx": pa.int32(), "id": pa.string(), "shown": pa.string()}
    NEEDS = ["path"]

    def of(self, nodes: Nodes) -> list[tuple]:
        rows, path, ends = nodes.rows, nodes.path, nodes.path_ends
        return [(r[1], r[21], path_text([rows[i] for i in path[ends[k] : ends[k + 1]]])) for k, r in enumerate(rows)]


class Kinds(Made):
    """How many nodes of each kind there are inside and outside of quoted runs, and in how many documents: sums, of no document.

    A node's kind and run don't depend on what it stands in, so nothing is nested.
    """

    TYPES = {"kind": pa.string(), "quoted": pa.bool_(), "n": pa.int64(), "n_docs": pa.int64()}

    def __init__(self, columns: list[str]) -> None:
        super().__init__(columns)
        self.n: Counter = Counter()
        self.n_docs: Counter = Counter()

    def add(self, doc, lines: list[Line]) -> None:
        found = Counter((x[3], x[1] > 0) for x in listed(lines))
        self.n.update(found)
        if doc is not None:
            self.n_docs.update(found.keys())

    def batch(self, doc_type: pa.DataType) -> pa.RecordBatch:
        self.rows = [(*key, n, self.n_docs[key]) for key, n in self.n.items()]
        self.doc_id = [None] * len(self.rows)
        return super().batch(doc_type)


class Features(Made):
    """What each document has, as operators.outline.feature_flags."""

    TYPES = {"provisions": pa.int64(), **dict.fromkeys(("table", "amendment", "title", "penalty", "image", "summary"), pa.bool_())}

    def of(self, nodes: Nodes) -> list[tuple]:
        if not nodes.rows:
            return []
        n, title, summary = 0, False, False
        units, kinds = set(), set()
        for r in nodes.rows:
            units.add(r[2])
            kinds.add(r[3])
            n += r[2] in ("provision", "omission", "amendment") and not (r[4] is not None and r[4] < 110)
            title = title or r[9] is not None
            summary = summary or "ementa" in r[10].lower()
        return [(n, "table" in kinds, "amendment" in units, title, "penalty" in kinds, "image" in kinds, summary)]


# --- JSON ---------------------------------------------------------------------

_ESCAPES = {k: f"\\u{k:04X}" for k in range(32)} | {ord(c): "\\" + e for c, e in zip('"\\\b\f\n\r\t', '"\\bfnrt')}
_ESCAPED = re.compile('["\\\\\x00-\x1f]')
_BOOL = ("false", "true")


def json_text(text: str) -> str:
    """A string as Spark writes it into JSON."""
    return f'"{text.translate(_ESCAPES)}"' if _ESCAPED.search(text) else f'"{text}"'


def _json_field(name: str, value: str | int | None) -> str:
    """A field with its comma, nothing of a null."""
    return "" if value is None else f',"{name}":{value if isinstance(value, int) else json_text(value)}'


@lru_cache(CACHE)
def _json_label(unit: str, kind: str, level: int | None, num: int | None, comp: int | None, unique: bool, name: str | None, lid: str | None, tag: str) -> tuple[str, str]:
    """A node's label as fields of the node, and of its element in paths."""
    label = f'"kind":{json_text(kind)}{_json_field("level", level)}{_json_field("num", num)}{_json_field("comp", comp)},"is_unique":{_BOOL[unique]}{_json_field("name", name)}'
    return f'"unit":{json_text(unit)},{label}', f'{label}{_json_field("lid", lid)}{_json_field("tag", tag)}'


@lru_cache(CACHE)
def _json_state(opens: bool, closes: bool, note: str | None, omitted: bool) -> str:
    return f',"open_quote":{_BOOL[opens]},"close_quote":{_BOOL[closes]}{_json_field("note", note)},"omitted":{_BOOL[omitted]}'


def _json_escaped(texts: tuple) -> pa.Array:
    """Strings with what JSON escapes, without quotes around."""
    made = pa.array(texts, pa.string())
    if pc.any(pc.match_substring_regex(made, _ESCAPED.pattern)).as_py():
        made = pa.array([None if t is None else json_text(t)[1:-1] for t in texts], pa.string())
    return made


def _concat(*pieces: str | pa.Array, null_handling: str = "emit_null") -> pa.Array:
    return pc.binary_join_element_wise(*(pa.scalar(x) if isinstance(x, str) else x for x in (*pieces, "")), null_handling=null_handling)


class NodeJson(Nodes):
    """Each node as JSON: what to_json gives of an outline's columns but runs, nulls left out.

    Put together a column at a time, paths and ancestries from the elements of the nodes around.
    """

    TYPES = {"at": pa.int32(), "node": pa.string()}
    #: Nodes in a batch, and bytes of their paths and texts as far as single nodes allow: JSON is much longer than the lines.
    ROWS, SIZE = 8_000, 1 << 25

    def __init__(self, columns: list[str]) -> None:
        super().__init__(["path", "ancestry"])

    def batches(self, doc_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        if not self.rows:
            return
        v = dict(zip(_KEPT, zip(*self.rows)))
        at = pa.array(v["at"], pa.int32())
        own, step = zip(*map(_json_label, *(v[c] for c in ("unit", "kind", "level", "num", "comp", "is_unique", "name", "lid", "tag"))))
        begin = _concat('{"at":', at.cast(pa.string()))
        steps = _concat(begin, ",", pa.array(step), "}")
        elements = _concat(begin, ',"tag":"', pa.array(v["tag"]), '"}')
        sizes = pc.binary_length(steps)
        todo = [(k, min(k + self.ROWS, len(self.rows))) for k in reversed(range(0, len(self.rows), self.ROWS))]
        while todo:
            a, b = todo.pop()
            taken = pa.array(self.path[self.path_ends[a] : self.path_ends[b]], pa.int32())
            if b - a > 1 and (pc.sum(sizes.take(taken)).as_py() or 0) + sum(map(len, v["content"][a:b])) > self.SIZE:
                todo += [((a + b) // 2, b), (a, (a + b) // 2)]
                continue
            ints = lambda c: pa.array(v[c][a:b], pa.int32()).cast(pa.string())  # noqa: B023, E731
            node = _concat(
                '{"ctx":', ints("ctx"), ",", pa.array(own[a:b]), _concat(',"title":"', _json_escaped(v["title"][a:b]), '"'), ',"content":"', _json_escaped(v["content"][a:b]), '"',
                pa.array(list(map(_json_state, *(v[c][a:b] for c in ("open_quote", "close_quote", "note", "omitted"))))),
                _concat(',"parent_at":', ints("parent_at")), _concat(',"parent_level":', ints("parent_level")),
                ',"path":[', self._listed(steps, taken, self.path_ends[a : b + 1]),
                '],"ancestry":[', self._listed(elements, pa.array(self.chain[self.chain_ends[a] : self.chain_ends[b]], pa.int32()), self.chain_ends[a : b + 1]), "]",
                # ids and elements are made of letters, digits and signs that need no escapes
                _concat(',"run_parent":', ints("run_parent")), *(_concat(f',"{c}":"', pa.array(v[c][a:b], pa.string()), '"') for c in ("id", "parent_id")), "}",
                null_handling="skip",
            )
            yield pa.RecordBatch.from_arrays([pa.array(self.doc_id[a:b], doc_type), at[a:b], node], ["doc_id", "at", "node"])

    def _listed(self, pieces: pa.Array, taken: pa.Array, ends: list[int]) -> pa.Array:
        offsets = pc.subtract(pa.array(ends, pa.int32()), pa.scalar(ends[0], pa.int32()))
        return pc.binary_join(pa.ListArray.from_arrays(offsets, pieces.take(taken)), ",")


def read_back(batches: Iterator[pa.RecordBatch], fields: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Fields of nodes written as JSON, parsed out of the text of each."""
    parse = pj.ParseOptions(explicit_schema=pa.schema(fields), unexpected_field_behavior="ignore")
    for batch in batches:
        nodes = batch.column("node")
        whole = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(nodes)], pa.int32()), nodes), "\n")[0].as_buffer()
        # one block, since none may end within a node
        found = pj.read_json(pa.BufferReader(whole), pj.ReadOptions(use_threads=False, block_size=whole.size + 1), parse).combine_chunks()
        if found.num_rows != len(nodes):
            raise ValueError(f"{len(nodes)} nodes written, {found.num_rows} read")
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(found.column(c).chunk(0) for c in fields)], ["doc_id", *fields])


def outlined(batches: Iterator[pa.RecordBatch], columns: list[str], styled: bool, compatible: bool, sink: type = Nodes) -> Iterator[pa.RecordBatch]:
    """Nodes of lines that come document by document and in order, or what another sink makes of them."""
    gc.disable()  # no cycles are made, and going through all rows for them takes a third of the time
    try:
        yield from _outlined(batches, columns, styled, compatible, sink)
    finally:
        gc.enable()


def _outlined(batches: Iterator[pa.RecordBatch], columns: list[str], styled: bool, compatible: bool, sink: type) -> Iterator[pa.RecordBatch]:
    doc_type = None
    nodes, doc, rows, done = sink(columns), None, [], 0
    plain = False

    def end() -> None:
        if plain:
            lines = read(rows, compatible)
        else:
            lines = quoted(rows, styled)
            recognised(lines, styled, compatible)
        nodes.add(doc, merged(lines, styled))

    for batch in batches:
        doc_type = batch.schema.field("doc_id").type
        names = batch.schema.names
        plain = "text" in names
        if plain:
            given = zip(batch.column("doc_id").to_pylist(), (t.split("\n") for t in batch.column("text").to_pylist()))
        else:
            none = [None] * batch.num_rows
            given = ((d, [row]) for d, *row in zip(*(batch.column(c).to_pylist() if c in names else none for c in ("doc_id", "pos", "raw", "list_item", "block", "runs"))))
        for d, more in given:
            if d != doc:
                if rows:
                    end()
                    done += len(rows)
                    if done >= BATCH:
                        yield from nodes.batches(doc_type)
                        nodes, done = sink(columns), 0
                doc, rows = d, []
            rows += more
    if rows:
        end()
        yield from nodes.batches(doc_type)
