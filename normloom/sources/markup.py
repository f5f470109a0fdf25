"""Office and web formats as blocks with styled runs: HTML, DOCX, ODT.  One Python pass a document."""

from __future__ import annotations

import io
import unicodedata
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame

BLOCKS = "doc_id long, pos int, kind string, raw string, runs array<struct<text:string,b:boolean,i:boolean,sup:boolean,sub:boolean,href:string>>, list_item int, problem int"
HTML, XHTML, DOCX, ODT, TEXT = "text/html", "application/xhtml+xml", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/vnd.oasis.opendocument.text", "text/plain"
#: Formats that need a converter of the user's.
RTF, DOC = "text/rtf", "application/msword"
_PARAGRAPHS = frozenset("p h1 h2 h3 h4 blockquote center".split())
_PLAIN = frozenset("div body html section article main font tbody thead tr td th ul dl dt dd h5 h6 header footer nav aside".split())
_VOID = frozenset("br hr img input meta link col area base source wbr".split())
Run = tuple[str, bool, bool, bool, bool, str | None]


def merge_runs(runs: list[Run]) -> list[Run]:
    """Runs of one style joined, white space collapsed across them and trimmed at the ends."""
    out: list[Run] = []
    for text, *style in runs:
        text = unicodedata.normalize("NFC", text)
        text = " ".join(f"|{text}|".split())[1:-1] if text.strip() else (" " if text else "")
        if out and out[-1][0].endswith(" "):
            text = text.lstrip(" ")
        if not text:
            continue
        if out and (list(out[-1][1:]) == style or text == " "):
            out[-1] = (out[-1][0] + text, *out[-1][1:])
        else:
            out.append((text, *style))
    if out:
        out[0] = (out[0][0].lstrip(" "), *out[0][1:])
        out[-1] = (out[-1][0].rstrip(" "), *out[-1][1:])
    return [r for r in out if r[0]]


class _Reader(HTMLParser):
    """Blocks of a page, tolerant of unclosed and crossed tags."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, list[Run], int | None]] = []
        self.runs: list[Run] = []
        self.styles: list[tuple[str, dict]] = []
        self.lists: list[list] = []
        self.table = self.hidden = 0
        self.item: int | None = None

    def flush(self, kind: str = "paragraph", keep_empty: bool = False) -> None:
        runs = merge_runs(self.runs)
        if runs or keep_empty:
            self.blocks.append((kind, runs, self.item))
            self.item = None
        self.runs = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        given = dict(attrs)
        if tag in ("script", "style", "head", "title"):
            self.hidden += 1
        elif tag == "table":
            if not self.table:
                self.flush()
            self.table += 1
        elif tag in ("ol", "ul"):
            self.flush()
            self.lists.append([tag, 0])
        elif tag == "li":
            self.flush()
            if self.lists:
                self.lists[-1][1] += 1
                self.item = self.lists[-1][1] if self.lists[-1][0] == "ol" else None
        elif tag == "img":
            self.flush()
            self.blocks.append(("image", [], None))
        elif tag == "br":
            self.runs.append((" ", False, False, False, False, None))
        elif tag in _PARAGRAPHS or tag in _PLAIN:
            if self.table:  # cells and their paragraphs are apart
                self.runs.append((" ", False, False, False, False, None))
            else:
                self.flush()
        elif tag not in _VOID:
            style = {"b": tag in ("b", "strong"), "i": tag in ("i", "em"), "sup": tag == "sup", "sub": tag == "sub"}
            if tag == "span" and given.get("style"):
                rules = dict(x.replace(" ", "").lower().split(":", 1) for x in given["style"].split(";") if ":" in x)
                style = {"b": rules.get("font-weight") in ("bold", "700"), "i": rules.get("font-style") == "italic", "sup": rules.get("vertical-align") == "super", "sub": rules.get("vertical-align") == "sub"}
            self.styles.append((tag, style | {"href": given.get("href") if tag in ("a", "span") else None}))

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style", "head", "title"):
            self.hidden = max(0, self.hidden - 1)
        elif tag == "table":
            self.table = max(0, self.table - 1)
            if not self.table:
                self.flush("table", True)
        elif tag in ("ol", "ul"):
            self.flush()
            if self.lists:
                self.lists.pop()
        elif tag in _PARAGRAPHS and not self.table:
            self.flush(keep_empty=True)
        elif tag in _PLAIN or tag == "li":
            if not self.table:
                self.flush()
        else:
            for k in range(len(self.styles) - 1, -1, -1):
                if self.styles[k][0] == tag:
                    del self.styles[k]
                    break

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            flag = lambda name: any(s[name] for _, s in self.styles)
            self.runs.append((data, flag("b"), flag("i"), flag("sup"), flag("sub"), next((s["href"] for _, s in reversed(self.styles) if s["href"]), None)))


def collapse_empty(blocks: list[tuple]) -> list[tuple]:
    """Runs of empty paragraphs as one."""
    return [b for k, b in enumerate(blocks) if b[0] != "paragraph" or b[1] or not k or blocks[k - 1][0] != "paragraph" or blocks[k - 1][1]]


def read_html(content: bytes) -> list[tuple]:
    reader = _Reader()
    text = content.decode("utf-8", "replace").replace("\u0096", "-")
    reader.feed(text)
    reader.close()
    reader.flush()
    return collapse_empty(reader.blocks)


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_docx(content: bytes) -> list[tuple]:
    """Paragraphs of word/document.xml with bold, italic, superscript and subscript runs."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as bundle, bundle.open("word/document.xml") as source:
        for _, p in ElementTree.iterparse(source):
            if p.tag != f"{_W}p":
                continue
            runs: list[Run] = []
            for r in p.iter(f"{_W}r"):
                props = r.find(f"{_W}rPr")
                on = lambda name: props is not None and (x := props.find(_W + name)) is not None and x.get(f"{_W}val", "1").lower() not in ("0", "false", "off")  # noqa: B023, E731
                align = props.find(f"{_W}vertAlign").get(f"{_W}val", "") if props is not None and props.find(f"{_W}vertAlign") is not None else ""
                for part in r:
                    text = {f"{_W}t": part.text or "", f"{_W}tab": " ", f"{_W}br": " "}.get(part.tag, "")
                    runs.append((text.replace("\xa0", " ").replace("\n", " "), on("b"), on("i"), align == "superscript", align == "subscript", None))
            out.append(("paragraph", merge_runs(runs), None))
            p.clear()
    return collapse_empty(out)


_TEXT = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"


def read_odt(content: bytes) -> list[tuple]:
    """Paragraphs and headings of content.xml, without styles."""
    with zipfile.ZipFile(io.BytesIO(content)) as bundle, bundle.open("content.xml") as source:
        tree = ElementTree.parse(source)
    found = [x for x in tree.iter() if x.tag in (f"{_TEXT}p", f"{_TEXT}h")]
    return collapse_empty([("paragraph", merge_runs([("".join(x.itertext()), False, False, False, False, None)]), None) for x in found])


def read_text(content: bytes) -> list[tuple]:
    """Paragraphs of plain text: lines up to a blank one, joined by a space in their order."""
    paragraphs: list[list[str]] = [[]]
    for line in content.decode("utf-8", "replace").splitlines():
        if line.strip():
            paragraphs[-1].append(line.strip())
        elif paragraphs[-1]:
            paragraphs.append([])
    return [("paragraph", merge_runs([(" ".join(p), False, False, False, False, None)]), None) for p in paragraphs if p]


READERS: dict[str, Callable[[bytes], list[tuple]]] = {HTML: read_html, XHTML: read_html, DOCX: read_docx, ODT: read_odt, TEXT: read_text}


def blocks(documents: DataFrame, converters: dict[str, Callable[[bytes], list[tuple]]] | None = None) -> DataFrame:
    """Blocks of documents (doc_id, mime, content), read by their MIME type.

    `converters` adds or replaces readers.  A document of another type, or one
    that its reader fails on, gives one row with problem 15.
    """
    readers = READERS | (converters or {})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("pos", pa.int32()), ("kind", pa.string()), ("raw", pa.string()), ("runs", pa.list_(pa.struct([("text", pa.string()), ("b", pa.bool_()), ("i", pa.bool_()), ("sup", pa.bool_()), ("sub", pa.bool_()), ("href", pa.string())]))), ("list_item", pa.int32()), ("problem", pa.int32())])
        for batch in batches:
            rows = []
            for doc, mime, content in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "mime", "content"))):
                try:
                    found = readers[mime](content or b"")
                except Exception:  # any fault of a document is that document's problem, not the job's
                    rows.append({"doc_id": doc, "pos": None, "kind": None, "raw": None, "runs": None, "list_item": None, "problem": 15})
                    continue
                for k, (kind, runs, item) in enumerate(found):
                    rows.append({"doc_id": doc, "pos": k, "kind": kind, "raw": "".join(r[0] for r in runs), "runs": [dict(zip(("text", "b", "i", "sup", "sub", "href"), r)) for r in runs], "list_item": item, "problem": None})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return documents.select("doc_id", "mime", "content").mapInArrow(work, BLOCKS)
