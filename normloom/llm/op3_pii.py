"""Personal data by a semi-Markov conditional random field.

Exact patterns give the base spans: e-mail addresses, IP addresses, payment
cards (Luhn) and international phone numbers.  Beside them a semi-Markov CRF
reads regions around tokens with a digit or an at sign.  A candidate segment is
a run of at most `LONGEST` tokens; its score is a weighted sum of features of
the whole span (lengths, character shares, checksums, octets, the words before
it), so boundaries and types are chosen together by a dynamic program with
bounded entity length.  Weights maximise the conditional likelihood of
generated, labelled sequences; the same forward and backward recursions that
train them give the probability of each decoded span, and spans over
`CONFIDENCE` that touch no base span are added.  The CRF also knows secrets
(access keys, tokens, passwords), which no base pattern covers.

Patterns are read off maximal runs and the dynamic program goes over a region of
any length in pieces that carry its state, so time is linear in a text and
memory in its tokens; nothing is cut at a piece's end.

Offsets are code points, ends exclusive.  Edge cases: a null or empty text has
no spans and stays as it is when masked; texts of any length are whole; repeated
rows and ids each get a row, a null id stays null; an empty table gives an empty
result; `find` ignores other columns, `mask` keeps them.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normloom.llm import textvec as V
from normloom.llm.common import map_text, table

KINDS = ("email", "ip", "card", "phone", "secret")
#: The base patterns (fixed values of the contract).
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Runs that hold all matches of two of them: what may follow an at sign, and numbers joined by dots.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Tokens of an entity at most.
LONGEST = 6
#: Probability from which a decoded span that is not a base span is added.
CONFIDENCE = 0.9
#: Tokens whose segments are scored at once.
PIECE = 2000

_SIGN = re.compile(r"[0-9@]")
_EDGE = "\"'`()[]{}<>,;:!?"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _ip_ok(text: str) -> bool:
    return all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in text.split("."))


def _card_ok(text: str) -> bool:
    digits = text.replace(" ", "").replace("-", "")
    return 16 <= len(digits) <= 19 and luhn(digits)


def _phone_ok(text: str) -> bool:
    return 8 <= sum(c in "0123456789" for c in text) <= 15


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """Numbers joined by dots, four by four from the left."""
    for m in _NUMBERS.finditer(text):
        if m.group().count(".") >= 3:
            ends = [x.end() for x in re.finditer("[0-9]+", m.group())]
            starts = [0, *(e + 1 for e in ends[:-1])]
            for k in range(0, len(ends) - 3, 4):
                yield m.start() + starts[k], m.start() + ends[k + 3]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the exact patterns, by kind, then start."""
    out = [(0, a, b) for a, b in _emails(text)]
    if not _SIGN.search(text):
        return out
    out += [(1, a, b) for a, b in _addresses(text) if _ip_ok(text[a:b])]
    out += [(2, m.start(), m.end()) for m in CARD.finditer(text) if _card_ok(m.group())]
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if _phone_ok(m.group())]
    return out


# --- the random field ------------------------------------------------------

_FEATURES = 24


@cache
def _context(word: str) -> int:
    """Class of the word before a segment."""
    low = word.lower().strip(_EDGE + ".=\"'")
    for k, names in enumerate((("token", "key", "secret", "password", "passwd", "pwd", "api_key", "apikey"), ("tel", "phone", "call", "fax", "mobile"), ("card", "visa", "carte", "karte", "tarjeta"), ("version", "page", "chapter", "no", "nr", "section", "art"))):
        if low in names:
            return k
    return -1


def segment_features(span: str, before: str, tokens: int) -> np.ndarray:
    """Features of a whole candidate span."""
    f = np.zeros(_FEATURES)
    n = len(span)
    digits = "".join(c for c in span if "0" <= c <= "9")
    letters = sum(c.isalpha() for c in span)
    f[0] = 1
    f[1] = tokens - 1
    f[2] = min(n, 60) / 20
    f[3] = len(digits) / n
    f[4] = letters / n
    f[5] = EMAIL.fullmatch(span) is not None
    f[6] = IP.fullmatch(span) is not None and _ip_ok(span)
    card = CARD.fullmatch(span) is not None
    f[7] = card and _card_ok(span)
    f[8] = card and 13 <= len(digits) <= 19
    phone = PHONE.fullmatch(span) is not None
    f[9] = phone and _phone_ok(span)
    f[10] = span[0] == "+"
    f[11] = "@" in span
    f[12] = 8 <= len(digits) <= 15
    f[13] = len(digits) == 0
    mixed = bool(digits) and letters > 0 and re.fullmatch(r"[A-Za-z0-9_+/=-]+", span) is not None
    f[14] = mixed and n >= 16
    f[15] = mixed and n >= 16 and span.upper() == span
    f[16] = mixed and n >= 16 and re.fullmatch(r"[0-9a-f]+", span) is not None
    kind = _context(before)
    if kind >= 0:
        f[17 + kind] = 1
    f[21] = any(c in ".-() " for c in span)
    f[22] = span[0] in _EDGE or span[-1] in _EDGE + "."
    f[23] = tokens > 1 and not (phone or card)
    return f


def words_before(tokens: list[str]) -> list[str]:
    """For each token the last one before it that is no mark."""
    out, last = [], ""
    for t in tokens:
        out.append(last)
        last = last if t in _EDGE + "=" else t
    return out


class Field:
    """Weights of each kind (and of single plain tokens) over segment features."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    @staticmethod
    def lattice(tokens: list[str], gaps: list[str], low: int = 0, high: int | None = None, before: list[str] | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
        """All segments (start, end) that start in a part of a region, and their features; before: words_before of it."""
        spans, rows = [], []
        before = words_before(tokens) if before is None else before
        for i in range(low, len(tokens) if high is None else high):
            text = ""
            for j in range(i, min(i + LONGEST, len(tokens))):
                text += (gaps[j] if j > i else "") + tokens[j]
                if j > i and gaps[j] not in ("", " ", "-", "="):
                    break
                spans.append((i, j + 1))
                rows.append(segment_features(text, before[i], j + 1 - i))
        return spans, np.array(rows)

    def scores(self, spans: list[tuple[int, int]], rows: np.ndarray) -> np.ndarray:
        """A column for each kind and a last one for plain text (single tokens only)."""
        s = rows @ self.weights.T
        long_ = np.array([b - a > 1 for a, b in spans])
        s = np.hstack([s, np.zeros((len(spans), 1))])
        s[long_, -1] = -np.inf
        return s

    def marginals(self, n: int, spans: list[tuple[int, int]], s: np.ndarray) -> tuple[np.ndarray, float]:
        """Probability of each (segment, kind), and the log partition."""
        forward, backward = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        forward[0] = backward[n] = 0
        whole = np.logaddexp.reduce(s, axis=1)
        for (a, b), w in zip(spans, whole):  # spans are ordered by start
            forward[b] = np.logaddexp(forward[b], forward[a] + w)
        for (a, b), w in zip(reversed(spans), whole[::-1]):
            backward[a] = np.logaddexp(backward[a], backward[b] + w)
        at = np.array([forward[a] + backward[b] for a, b in spans])
        return np.exp(s + at[:, None] - forward[n]), float(forward[n])

    def decode(self, tokens: list[str], gaps: list[str]) -> list[tuple[int, int, int, float]]:
        """(start, end, kind, probability) of the entities of the best segmentation."""
        n = len(tokens)
        best, forward, backward = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        start, kind, gain = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int8), np.zeros(n + 1)
        best[0] = forward[0] = backward[n] = 0
        before = words_before(tokens)
        pieces = [(low, min(low + PIECE, n)) for low in range(0, n, PIECE)]

        def scored(low: int, high: int) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
            spans, rows = self.lattice(tokens, gaps, low, high, before)
            s = self.scores(spans, rows)
            return spans, s, np.logaddexp.reduce(s, axis=1)

        kept = None
        for low, high in pieces:
            kept = spans, s, whole = scored(low, high)
            top = s.argmax(axis=1)
            for (a, b), k, x, w in zip(spans, top.tolist(), s[np.arange(len(s)), top].tolist(), whole.tolist()):
                forward[b] = np.logaddexp(forward[b], forward[a] + w)
                if best[a] + x > best[b]:
                    best[b], start[b], kind[b], gain[b] = best[a] + x, a, k, x
        out, at = [], n
        while at:
            if kind[at] < len(KINDS):
                out.append((int(start[at]), at, int(kind[at]), gain[at]))
            at = int(start[at])
        if not out:
            return []
        for low, high in reversed(pieces):
            spans, _, whole = kept if len(pieces) == 1 else scored(low, high)
            for (a, b), w in zip(reversed(spans), whole[::-1].tolist()):
                backward[a] = np.logaddexp(backward[a], backward[b] + w)
        return [(a, b, k, float(np.exp(forward[a] + x + backward[b] - forward[n]))) for a, b, k, x in reversed(out)]


def split(text: str, start: int, end: int) -> tuple[list[str], list[str], list[int]]:
    """Tokens of a region, the text between each and the one before, and token starts."""
    tokens, gaps, at, last = [], [], [], start
    for m in re.finditer(r"[\"'`(){}\[\]<>,;:!?=]|[^\s\"'`(){}\[\]<>,;:!?=]+", text[start:end]):
        a, b = start + m.start(), start + m.end()
        if b - a > 1 and text[b - 1] == ".":
            b -= 1
        tokens.append(text[a:b])
        gaps.append(text[last:a])
        at.append(a)
        last = b
    return tokens, gaps, at


def _examples(rng: random.Random) -> Iterator[tuple[str, list[tuple[int, int, int]]]]:
    """Generated texts with labelled spans: entities, and numbers that are none."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice(["an", "the", "ou", "ti", "er", "la", "que", "ung", "ción"]) for _ in range(rng.randint(1, 4)))

    def card() -> str:
        body = rng.choice("3456") + digits(rng.choice([14, 14, 14, 15]))
        return body + next(d for d in "0123456789" if luhn(body + d))

    def entity() -> tuple[str, int, str]:
        k = rng.randint(0, 4)
        if k == 0:
            return f"{word()}.{digits(2)}@{word()}.example.{rng.choice(['com', 'org'])}", 0, ""
        if k == 1:
            return ".".join(str(rng.randint(0, 255)) for _ in range(4)), 1, ""
        if k == 2:
            c = card()
            return rng.choice([c, " ".join(c[i : i + 4] for i in range(0, len(c), 4)), "-".join(c[i : i + 4] for i in range(0, len(c), 4))]), 2, ""
        if k == 3:
            return rng.choice([f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", f"+{rng.randint(30, 49)} {digits(3)} {digits(7)}", f"+{digits(11)}"]), 3, ""
        form = rng.randint(0, 2)
        if form == 0:
            return "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)), 4, ""
        value = "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([18, 32, 40])))
        return value, 4, rng.choice(["token = ", 'token = "', "password=", "secret: ", "api_key="])

    def other() -> str:
        return rng.choice([
            digits(rng.randint(1, 7)), f"{rng.randint(1, 9)}.{rng.randint(0, 9)}", f"version {rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 9)}",
            f"{rng.randint(1900, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", f"{rng.randint(1, 999)},{digits(3)}", f"@{word()}", f"{word()}{digits(2)}",
            digits(rng.randint(8, 15)), digits(16)[:-1] + "x", f"{rng.randint(256, 999)}.{rng.randint(256, 999)}.1.2", f"{digits(4)} {digits(4)}", f"http://{word()}.example/{digits(5)}", f"{digits(2)}:{digits(2)}", word() + word() + word() + word() + word(),
        ])

    for _ in range(500):
        text, spans = word(), []
        for _ in range(rng.randint(1, 3)):
            text += " "
            if rng.random() < 0.5:
                e, kind, lead = entity()
                text += lead
                spans.append((kind, len(text), len(text) + len(e)))
                text += e + ('"' if lead.endswith('"') else "") + rng.choice(["", "", ".", ","])
            else:
                text += other()
            text += " " + word()
        yield text, spans


@cache
def field() -> Field:
    """The trained field: conditional likelihood by Adam on generated sequences."""
    data = []
    for text, spans in _examples(random.Random(7)):
        tokens, gaps, at = split(text, 0, len(text))
        index = {(at[i], at[j - 1] + len(tokens[j - 1])): (i, j) for i in range(len(tokens)) for j in range(i + 1, min(i + LONGEST, len(tokens)) + 1)}
        gold = {index[a, b]: k for k, a, b in spans if (a, b) in index}
        segments, rows = Field.lattice(tokens, gaps)
        if len(gold) == len(spans) and all(g in segments for g in gold):
            wanted = np.zeros((len(segments), len(KINDS)))
            for k, s in enumerate(segments):
                if s in gold:
                    wanted[k, gold[s]] = 1
            data.append((len(tokens), segments, rows, wanted))
    weights = np.zeros((len(KINDS), _FEATURES))
    weights[:, 0] = -2
    m, v = np.zeros_like(weights), np.zeros_like(weights)
    rng = np.random.default_rng(5)
    for step in range(1, 241):
        model, gradient = Field(weights), np.zeros_like(weights)
        for k in rng.choice(len(data), 16, replace=False):
            n, segments, rows, wanted = data[k]
            p, _ = model.marginals(n, segments, model.scores(segments, rows))
            gradient += (wanted - p[:, :-1]).T @ rows
        gradient = gradient / 16 - 1e-3 * weights
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        weights = weights + (0.2 if step < 180 else 0.05) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(weights)


def regions(text: str) -> Iterator[tuple[int, int]]:
    """Runs of tokens with a digit or an at sign, with the two tokens before."""
    begin = end = -1
    for m in _SIGN.finditer(text):
        if m.start() < end:
            continue
        a = m.start()
        while a and not text[a - 1].isspace():
            a -= 1
        b = m.end()
        while b < len(text) and not text[b].isspace():
            b += 1
        if begin < 0 or text[end:a].strip():
            if begin >= 0:
                yield begin, end
            begin = a
            for _ in range(2):  # two tokens of context, not into the region before
                c = begin
                while c and text[c - 1].isspace():
                    c -= 1
                while c and not text[c - 1].isspace() and begin - c < 80:
                    c -= 1
                if c < end:
                    break
                begin = c
        end = b
    if begin >= 0:
        yield begin, end


def added_spans(text: str, base: list[tuple[int, int, int]], model: Field) -> list[tuple[int, int, int]]:
    """Confident spans of the field that touch no base span."""
    out = []
    taken: list[tuple[int, int]] = []  # base spans, overlapping ones as one
    for a, b in sorted((a, b) for _, a, b in base):
        if taken and a < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
        else:
            taken.append((a, b))
    for start, end in regions(text):
        tokens, gaps, at = split(text, start, end)
        for i, j, kind, p in model.decode(tokens, gaps):
            a, b = at[i], at[j - 1] + len(tokens[j - 1])
            k = bisect_left(taken, (b, 0)) - 1  # the last that starts before b
            if p >= CONFIDENCE and (k < 0 or taken[k][1] <= a):
                out.append((kind, a, b))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def spans_of(text: str | None, model: Field) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans, of a text."""
    if not text or not _SIGN.search(text):
        return [], []
    base = base_spans(text)
    return base, base + added_spans(text, base, model)


def _pieces(batch: pa.RecordBatch, column: str | int) -> Iterator[pa.RecordBatch]:
    """Rows of a batch, so many at a time that a worker holds few texts as objects beside it."""
    for i, j in V.pieces(V.text_buffers(batch.column(column))[1]):
        yield batch.slice(i, j - i)


def find(documents: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, base and all spans of each whole text."""
    model = field()
    names = ["doc_id", *(f"n_{k}" for k in KINDS[:4]), "base", "spans"]

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for own in _pieces(batch, "text"):
            rows = [spans_of(x, model) for x in own.column("text").to_pylist()]
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in rows], pa.int64()) for k in range(4)]
            texts = [pa.array([joined(r[k]) for r in rows], pa.string()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([own.column("doc_id"), *counts, *texts], names=names)

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string"
    return map_text(documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), work, schema)


def masked(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """The text with every span replaced by its kind in brackets; overlapping spans merge."""
    if not spans:
        return text
    out, last, reach = [], 0, 0
    for a, b, kind in sorted((a, b, k) for k, a, b in spans):
        if a < reach:
            reach = max(reach, b)
            last = reach
            continue
        out += [text[last:a], f"[{KINDS[kind].upper()}]"]
        last = reach = b
    return "".join([*out, text[last:]])


def mask(documents: DataFrame) -> DataFrame:
    """doc_id-preserving rewrite: the same rows and columns, personal data masked in `text`."""
    model, columns = field(), documents.columns
    at = columns.index("text")

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for own in _pieces(batch, at):
            arrays = list(own.columns)
            arrays[at] = pa.array([masked(x, spans_of(x, model)[1]) for x in own.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    return map_text(documents.withColumn("text", F.col("text").cast("string")), work, documents.withColumn("text", F.col("text").cast("string")).schema)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")
