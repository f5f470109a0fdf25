"""Vectorised text primitives shared by the Arrow-batch operators.

Everything here works on the UTF-8 bytes of a whole batch at once: word
boundaries, word hashes and rolling window hashes are array expressions, so no
Python object is made per word.  Hashes depend on fixed constants only, never
on the process, so executors agree about them.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

try:
    _malloc_trim = ctypes.CDLL(None).malloc_trim
except AttributeError:  # another C library, which keeps less
    _malloc_trim = None


def _trim() -> None:
    if _malloc_trim is not None:
        _malloc_trim(0)
    pa.default_memory_pool().release_unused()


U64 = np.uint64
#: Bytes of text worked on at once; temporary arrays take about 40 times this.
CHUNK_BYTES = 1_000_000

#: Odd multiplier of the earlier of two hashes that are combined.
_NEXT = U64(0x9E3779B97F4A7C17)
_SECOND = U64(0xC2B2AE3D27D4EB4F)
#: Byte ranges up to this long are their own key.
EXACT_BYTES = 15
_MASK = np.array([(1 << 8 * k) - 1 for k in range(8)], U64)

#: ASCII white space: space and TAB to CR.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising permutation of 64-bit values."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and document offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most `most` bytes each (or one document).

    Between them the memory of freed arrays goes back to the system, which
    would otherwise keep it for each worker that was once busy.
    """
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        _trim()
        i = j


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of the integer ranges [start, start + length)."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def word_spans(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and per-document bounds of runs of True within documents."""
    n = len(member)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    if n:
        before[0] = False
        before[1:] = member[:-1]
    starts = np.flatnonzero(member & (~before | edge[:n]))
    after = np.zeros(n, bool)
    after[:-1] = member[1:]
    ends = np.flatnonzero(member & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys of each byte range, the first of them a hash by itself.

    Up to `EXACT_BYTES` bytes the pair is a permutation of the bytes and their
    number, so equal pairs mean equal bytes; beyond, it is a BLAKE2b digest.
    """
    size = ends - starts
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + 9, "<u8", padded, strides=(1,))  # the 8 bytes from each byte on
    first, second = eight[starts].astype(U64), np.zeros(len(starts), U64)
    short = size < 8
    first[short] &= _MASK[size[short]]
    more = np.flatnonzero(size > 8)
    second[more] = eight[starts[more] + 8] & _MASK[np.minimum(size[more] - 8, 7)]
    second |= np.minimum(size, 255).astype(U64) << U64(56)
    long_ = np.flatnonzero(size > EXACT_BYTES)
    if len(long_):
        raw = data.tobytes()
        digests = b"".join([blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(starts[long_].tolist(), ends[long_].tolist())])
        pairs = np.frombuffer(digests, "<u8").reshape(-1, 2)
        first[long_], second[long_] = pairs[:, 0], pairs[:, 1] | U64(255 << 56)
    first = mix(first ^ mix(second ^ _SECOND))
    return first, mix(second + first * _NEXT)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range."""
    return word_keys(data, starts, ends)[0]


def window_hashes(words: np.ndarray, k: int, second: bool = False) -> np.ndarray:
    """Hash of each run of k consecutive words (of the whole array); the second one is independent of the first.

    Runs of 1, 2, 4, ... words are mixed from their halves, and a run of k from
    those that make it up, so no sum of terms can cancel.
    """
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    level, reach, rest, done, out = mix(words + _SECOND) if second else words, 1, k, 0, None
    while rest:
        if rest & 1:
            part = level[done : done + n]
            out = part if out is None else mix(out * _NEXT + part)
            done += reach
        rest >>= 1
        if rest:
            level = mix(level[:-reach] * _NEXT + level[reach:])
            reach *= 2
    return out


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of each document's k-word shingles, A-Z lower-cased.

    With fewer than k words, the whole sequence is the one shingle; without
    words the set is empty.
    """
    data = LOWER[data]
    starts, ends, bounds = word_spans(~SPACE[data], offsets)
    words = word_hashes(data, starts, ends)
    windows = window_hashes(words, k)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(windows[a : b - k + 1]))
        elif b > a:
            out.append(window_hashes(words[a:b], b - a) ^ U64(b - a))
        else:
            out.append(np.zeros(0, U64))
    return out
