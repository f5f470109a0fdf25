"""Main text of web pages by two-pass block rules.

A linear scan of the markup cuts the page into blocks of text at block-level
tags and at doubled line breaks, and records for each its share of linked
characters, its share of stop words and the containers around it.  Text inside
navigation, headers, footers, sidebars, forms, scripts, styles, comments and
elements whose class, id or role names such a part is boilerplate.

First pass, context free: a block is bad if most of it is links, if it is
boilerplate by its container, or if it stands outside of the article element
that its page has; good if it is long and has many stop words; near-good if it
has some (in an article element, also if it has few); short if it is short;
otherwise bad.  Second pass: near-good and short blocks take the label of the
nearest decided blocks before and after them that no boilerplate container
holds; at an end of the text, one of them tells.  If they differ, a block in an
article element is good, as is a near-good one, and a heading takes the label of
what follows; in an article element it takes two bad ones to make a block bad.

Character references are decoded, white space inside a block becomes one space,
ends are trimmed and blocks joined by two newlines in page order.  Edge cases:
null or empty html gives an empty text; unclosed, crossed and unknown tags are
tolerated; a tag that the page's end cuts off is no text, a quote that never
closes is an ordinary character; pages of any length are whole and scanned in
linear time; repeated rows and ids each get a row, a null id or url stays null;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normloom.llm.common import map_text, table

#: Lengths and shares of the first pass.
SHORT, LONG = 70, 200
STOP_LOW, STOP_HIGH = 0.05, 0.25
LINKS = 0.4

#: Stop words of the languages (fixed values).
STOP_WORDS = frozenset(
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their them they this to was we were which will with you what how who "
    "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas plus pour qu que qui sa se ses son sur un une vous "
    "als am auch auf aus bei das dem den der des die durch ein eine einem einen einer er es für haben hat ich ihr im ist mit nach nicht noch oder sein sich sie sind so über um und uns von vor war wie wir zu zum zur "
    "al como con cuando del el ella ellos entre era esta este esto ha hay las lo los más me mi muy no nos o para pero por porque se ser si sin sobre su sus también te tiene todo tu uno y ya".split()
)
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page at all.
_HIDDEN = frozenset("script style noscript template iframe object svg math canvas audio video head title select textarea button".split())
#: Elements that hold boilerplate.
_SIDE = frozenset("nav header footer aside form menu dialog".split())
_ARTICLE = frozenset(("article", "main"))
#: Tags that end an open element of the same kind.
_SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_NAMED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|comment-\w+|cookies?|consent|disqus|footer|header|login|masthead|menu|meta|modal|nav|navbar|navigation|newsletter|notice|notices|pagination|popup|promo\w*|recommend\w*|related|replies|respond|share|sharing|sidebar|signup|social|sponsor\w*|subscribe|tags|teaser|toolbar|widget)(?:$|[\s_-])",
    re.I,
)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
_TOKEN = re.compile(r"<(?:(/?)([A-Za-z][^\s/>]*)|!--|!\[CDATA\[|[!?])")
#: The end of a tag, or the start of a quoted value in it.
_IN_TAG = re.compile(r">|=\s*[\"']")
_ATTRIBUTE = re.compile(r"([^\s=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|(\S+)))?|=")
#: Elements whose content is no markup, up to their end tag.
_RAW = {x: re.compile(rf"</{x}\s*>", re.I) for x in ("script", "style", "textarea", "noscript", "iframe", "template")}
_WORD = re.compile(r"\w+")
_BREAK = "\n"


class Block:
    __slots__ = ("text", "linked", "side", "article", "heading", "label")

    def __init__(self, text: str, linked: int, side: bool, article: bool, heading: bool):
        self.text, self.linked, self.side, self.article, self.heading, self.label = text, linked, side, article, heading, ""


def _side(name: str, attributes: str) -> bool:
    if name in _SIDE:
        return True
    if attributes and name not in _ARTICLE and name not in ("body", "html", "p", "h1"):
        for key, a, b, c in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), a or b or c
            if key in ("class", "id") and _NAMED.search(value) or key == "role" and value.lower() in _ROLES or key.rstrip("/") == "hidden" or key == "aria-hidden" and value.lower() == "true":
                return True
    return False


def _tag_end(html: str, at: int) -> int:
    """Where the tag whose attributes start at `at` has its >, -1 if the page ends before."""
    while (m := _IN_TAG.search(html, at)) is not None:
        if m.group() == ">":
            return m.start()
        close = html.find(m.group()[-1], m.end())  # if there is none, no later search can find that quote either
        at = close + 1 if close >= 0 else m.end()
    return -1


def blocks(html: str) -> list[Block]:
    """Blocks of text in page order."""
    out: list[Block] = []
    stack: list[tuple[str, int]] = []  # open elements: name, and 1 boilerplate, 2 article, 4 link, 8 heading, 16 hidden
    outer: list[int] = []  # places in the stack of those that are not inline
    opened: Counter[str] = Counter()
    counts = {1: 0, 2: 0, 4: 0, 8: 0, 16: 0}
    parts: list[str] = []
    linked: list[str] = []
    at, n = 0, len(html)

    def flush() -> None:
        text = " ".join(unescape("".join(parts)).split()) if parts else ""
        if text:
            links = len(" ".join(unescape("".join(linked)).split())) if linked else 0
            out.append(Block(text, links, counts[1] > 0, counts[2] > 0, counts[8] > 0))
        parts.clear()
        linked.clear()

    def close(index: int) -> None:
        for name, flags in stack[index:]:
            opened[name] -= 1
            for f in counts:
                if flags & f:
                    counts[f] -= 1
        del stack[index:]
        while outer and outer[-1] >= index:
            outer.pop()

    def add(text: str) -> None:
        if text and not counts[16] and not (parts and parts[-1] == _BREAK and text.isspace()):
            parts.append(text)
            if counts[4]:
                linked.append(text)

    while at < n:
        m = _TOKEN.search(html, at)
        if m is None:
            add(html[at:])
            break
        add(html[at : m.start()])
        name = m.group(2)
        if name is None:  # a comment, a marked section or a declaration
            kind = m.group()
            end = html.find("-->" if kind == "<!--" else "]]>" if kind == "<![CDATA[" else ">", m.end())
            if kind == "<![CDATA[" and end >= 0:
                add(html[m.end() : end].replace("&", "&amp;").replace("<", "&lt;"))
            at = n if end < 0 else end + (1 if kind in ("<!", "<?") else 3)
            continue
        stop = _tag_end(html, m.end())
        if stop < 0:
            break
        attributes, at = html[m.end() : stop], stop + 1
        name = name.lower()
        if name == "br":  # one is white space, two in a row end the block
            if parts and parts[-1] == _BREAK:
                flush()
            elif parts:
                parts.append(_BREAK)
        elif name not in _INLINE:
            flush()
        if m.group(1):
            if opened[name]:
                k = len(stack) - 1
                while stack[k][0] != name:
                    k -= 1
                close(k)
            continue
        if name in _VOID:
            continue
        if name in _RAW:
            end = _RAW[name].search(html, at)
            at = end.end() if end else n
            continue
        if (ends := _SELF_CLOSING.get(name)) and outer and stack[outer[-1]][0] in ends:
            close(outer[-1])
        if attributes.endswith("/"):
            continue
        flags = 0
        if name in _HIDDEN:
            flags |= 16
        if name in _ARTICLE:
            flags |= 2
        if _side(name, attributes) and not (name == "header" and counts[2]):  # an article's own header is its title
            flags |= 1
        if name == "a":
            flags |= 4
        if len(name) == 2 and name[0] == "h" and name[1] in "123456":
            flags |= 8
        for f in counts:
            if flags & f:
                counts[f] += 1
        if name not in _INLINE:
            outer.append(len(stack))
        opened[name] += 1
        stack.append((name, flags))
    flush()
    return out


def first_label(b: Block, has_article: bool) -> str:
    """good, bad, near or short, from the block alone."""
    size = len(b.text)
    if b.side or b.linked > LINKS * size or has_article and not b.article or not b.article and "\xa9" in b.text and size < LONG:
        return "bad"
    if size < SHORT:
        return "short" if b.article or b.linked < size / 2 else "bad"
    words = [w.lower() for w in _WORD.findall(b.text)]
    stops = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if stops >= STOP_HIGH:
        return "good" if size > LONG else "near"
    return "near" if b.article or stops >= STOP_LOW else "bad"


def classify(found: list[Block]) -> None:
    """Set the label of each block to good or bad."""
    has_article = any(b.article and not b.side for b in found)
    own = [b for b in found if not b.side]  # neighbours of each other
    first = [first_label(b, has_article) for b in own]
    decided = ("good", "bad")
    before, last = [], ""
    for b, x in zip(own, first):
        if has_article and not b.article:  # what surrounds the article tells nothing about it
            before.append("")
            continue
        before.append(last)
        last = x if x in decided else last
    last = ""
    for b, x, left in zip(reversed(own), reversed(first), reversed(before)):
        if has_article and not b.article:
            b.label = "bad"
        elif x in decided:
            b.label = last = x
        elif b.article:
            b.label = "bad" if left == last == "bad" else "good"
        elif len(sides := {left, last} - {""}) == 1:
            b.label = sides.pop()
        else:
            b.label = "good" if sides and (x == "near" or b.heading and last == "good") else "bad"
    for b in found:
        b.label = "bad" if b.side else b.label
    # no cut-off: a page on which nothing is good keeps its undecided text
    if not any(b.label == "good" for b in own):
        for b, x in zip(own, first):
            if x in ("near", "short"):
                b.label = "good"


def main_text(html: str | None) -> str:
    if not html:
        return ""
    found = blocks(html)
    classify(found)
    return "\n\n".join(b.text for b in found if b.label == "good")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = [main_text(x) for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    columns = [F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")]
    return map_text(pages.select(*columns), work, "page_id long, url string, text string, n_chars long")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
