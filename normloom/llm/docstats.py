"""Per-document text statistics, computed over whole texts with array expressions."""

from __future__ import annotations

import numpy as np

from normloom.llm import textvec as V

#: Characters that count as symbols (a fixed value of the op6 contract).
SYMBOLS = b"#*$%&|<>"
#: Words of a repeated window (a fixed value of the op6 contract).
REPEAT = 8

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[0xC0:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!?.,;:")] = True
_START = np.ones(256, bool)
_START[0x80:0xC0] = False


def _per_document(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _first_of_each(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs for the first time."""
    first = np.zeros(len(keys), bool)
    first[np.unique(keys, return_index=True)[1]] = True
    return first


def _repeated(words: np.ndarray, owner: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Per document, words in REPEAT-word windows that the document has twice or more."""
    n = len(words)
    covered = np.zeros(n + 1, np.int64)
    windows = V.window_hashes(words, REPEAT)
    if len(windows):
        whole = np.flatnonzero(owner[: len(windows)] == owner[REPEAT - 1 :])
        keys = V.mix(windows[whole] ^ (owner[whole].astype(V.U64) * V.U64(0x9E3779B97F4A7C15)))
        _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
        at = whole[counts[inverse] > 1]
        np.add.at(covered, at, 1)
        np.add.at(covered, at + REPEAT, -1)
    return _per_document(np.cumsum(covered[:n]) > 0, bounds)


def statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Arrays with a value for each document of a chunk; all 0 for an empty text."""
    member = ~V.SPACE[data]
    starts, ends, bounds = V.word_spans(member, offsets)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    words = V.word_hashes(data, starts, ends)
    salt = owner.astype(V.U64) * V.U64(0xC2B2AE3D27D4EB4F)
    line_starts, line_ends, line_bounds = V.word_spans(data != 10, offsets)
    filled = np.zeros(len(data) + 1, np.int64)
    np.cumsum(member, out=filled[1:])
    with_word = filled[line_ends] > filled[line_starts]
    line_owner = np.repeat(np.arange(len(offsets) - 1), np.diff(line_bounds))
    lines = V.mix(V.word_hashes(data, line_starts, line_ends) ^ (line_owner.astype(V.U64) * V.U64(0x9E3779B97F4A7C15)))
    again = np.zeros(len(lines), bool)
    again[with_word] = ~_first_of_each(lines[with_word])
    count = lambda flags: _per_document(flags, offsets)
    return {
        "n_words": np.diff(bounds),
        "word_chars": count(member & _START[data]),
        "n_symbols": count(_SYMBOL[data]),
        "n_lines": _per_document(with_word, line_bounds),
        "n_dup_lines": _per_document(again, line_bounds),
        "n_repeat_words": _repeated(words, owner, bounds),
        "n_again": _per_document(~_first_of_each(V.mix(words ^ salt)), bounds),
        "n_upper": count(_UPPER[data]),
        "n_letters": count(_LETTER[data]),
        "n_digits": count(_DIGIT[data]),
        "n_marks": count(_MARK[data]),
    }


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_again", "n_upper", "n_letters", "n_digits", "n_marks"]
