"""Byte-level BPE encoding and decoding.

Pre-tokenisation is vectorised.  Code points of a chunk map to a class array
(letter, number, white space, other, with one or two characters of lookahead
folded in).  Each class is a function from automaton state to automaton state;
the closure of these functions under composition is a small monoid, so an
associative scan over monoid elements gives the state before every character,
and a table lookup says where a piece starts.  No regular expression is used.
The byte slices between starts feed a bounded cache of merged pieces, keyed by
128-bit keys: the bytes themselves up to 15, a BLAKE2b digest beyond, so no
piece is taken for another.  New pieces are merged side by side in matrices.

`encode` keeps the byte offset of every token's end, and `decode` turns ids
back into bytes by table.

Edge cases: a null or empty text has no tokens; texts of any length are whole;
long pieces are merged with a heap in n log n steps; repeated rows and ids each
get a row, a null id stays null; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normloom.llm import textvec as V
from normloom.llm.common import map_text, table
from normloom.llm.hashtable import Table

#: Slots of a worker's cache of merged pieces, as a power of 2; it is emptied when half full.
CACHE_BITS = 21
#: Width of a row in the blocked scan.
BLOCK = 64
#: Pieces up to this long are merged in matrices of one length, longer ones with a heap.
MATRIX_BYTES = 48
#: Rank of a pair that does not merge.
NONE = 1 << 40

# States: after a letter, number, other, a space that the next run takes, white
# space, an apostrophe with 1 or 2 letters to come, a piece that just ended.
_L, _N, _O, _P, _W, _C1, _C2, _END = range(8)
# Classes: letter, number, other, space before non-space, white space before
# white space or the end, other white space before non-space, apostrophe of a
# one- or two-letter contraction. Eight more: the same as a document's first.
_CL, _CN, _CO, _CS, _CW, _CV, _CA1, _CA2 = range(8)


@cache
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Composition table, element of each class, state that each element gives
    from the start state, and whether a class starts a piece in a state."""
    step = np.zeros((16, 8), np.int64)
    start = np.ones((16, 8), bool)
    for state in range(8):
        step[_CL, state] = {_C2: _C1, _C1: _END}.get(state, _L)
        start[_CL, state] = state not in (_L, _P, _C1, _C2)
        step[_CN, state], start[_CN, state] = _N, state not in (_N, _P)
        step[_CO, state], start[_CO, state] = _O, state not in (_O, _P)
        step[_CS, state] = _P
        step[_CW, state], start[_CW, state] = _W, state != _W
        step[_CV, state] = _END
        for c, to in ((_CA1, _C1), (_CA2, _C2)):
            joined = state in (_O, _P)
            step[c, state], start[c, state] = _O if joined else to, not joined
    for c in range(8):
        step[8 + c, :] = step[c, _END]
    known = {tuple(range(8)): 0}
    queue = [tuple(range(8))]
    generators = [tuple(row) for row in step.tolist()]
    for f in queue:
        for g in generators:
            h = tuple(g[x] for x in f)
            if h not in known:
                known[h] = len(known)
                queue.append(h)
    maps = list(known)
    compose = np.array([[known[tuple(g[x] for x in f)] for g in maps] for f in maps], np.int16)
    return compose, np.array([known[g] for g in generators], np.int16), np.array([f[_END] for f in maps], np.int8), start


def _scan(elements: np.ndarray, compose: np.ndarray) -> np.ndarray:
    """Compositions of all prefixes of `elements`, in blocks."""
    n, size = len(elements), len(compose)
    flat = compose.ravel()
    rows = -(-n // BLOCK)
    grid = np.zeros(rows * BLOCK, np.int16)
    grid[:n] = elements
    grid = np.ascontiguousarray(grid.reshape(rows, BLOCK).T)
    for j in range(1, BLOCK):
        grid[j] = flat[grid[j - 1].astype(np.int32) * size + grid[j]]
    if rows > 1:
        before = np.zeros(rows, np.int16)
        before[1:] = _scan(grid[-1, :-1], compose) if rows > 2 else grid[-1, :1]
        grid = flat[before.astype(np.int32)[None, :] * size + grid]
    return grid.T.ravel()[:n]


@cache
def _classes() -> np.ndarray:
    """0 letter, 1 number, 2 other, 3 white space for each code point."""
    out = np.full(0x110000, 2, np.int8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = 0
        elif kind == "N":
            out[c] = 1
    #: Code points with the White_Space property (fixed values).
    out[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = 3
    return out


def piece_starts(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Code-point positions where a piece starts; firsts: document starts."""
    n = len(points)
    kind = _classes()[points]
    first = np.zeros(n + 1, bool)
    first[firsts] = True
    first[n] = True
    after1 = np.full(n + 2, 0, points.dtype)  # the next characters of the same document, else 0
    after1[: n - 1] = np.where(first[1:n], 0, points[1:])
    after2 = np.where(after1[:n] == 0, 0, after1[1 : n + 1])
    blank = kind == 3
    solid_next = np.zeros(n, bool)
    solid_next[: n - 1] = ~blank[1:] & ~first[1:n]
    cls = kind.copy()
    cls[blank] = _CW
    cls[blank & solid_next] = _CV
    cls[(points == 32) & solid_next] = _CS
    quote = np.flatnonzero(points == 39)
    if len(quote):
        a, b = after1[quote], after2[quote]
        one = np.isin(a, [ord(x) for x in "stmd"])
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        cls[quote[one]] = _CA1
        cls[quote[two]] = _CA2
    cls[first[:n]] += 8
    compose, element, state_of, start = _monoid()
    prefix = _scan(element[cls], compose)
    before = np.full(n, _END, np.int8)
    before[1:] = state_of[prefix[:-1]]
    return np.flatnonzero(start[cls, before] | first[:n])


class Vocabulary:
    """Ranks of a tiktoken file, and merged pieces kept by their 128-bit key."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.ranks = ranks
        self.byte_ids = np.array([ranks[bytes([x])] for x in range(256)], np.int64)
        pairs = {}
        for piece, rank in ranks.items():
            for k in range(1, len(piece)):
                a, b = ranks.get(piece[:k]), ranks.get(piece[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        keys = np.fromiter(pairs, V.U64, len(pairs))
        self.pairs = Table(20)
        self.pairs.put(keys, keys, np.fromiter(pairs.values(), np.int64, len(pairs)))
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for piece, rank in ranks.items():
            self.lengths[rank] = len(piece)
        self.text = np.frombuffer(b"".join(sorted(ranks, key=ranks.get)), np.uint8)
        self.text_at = np.cumsum(self.lengths) - self.lengths
        self._forget()

    def _forget(self) -> None:
        """Empty the cache but for the vocabulary's own pieces, which are never merged."""
        self.known = Table(CACHE_BITS)
        own = np.array(sorted(self.ranks.values()), np.int64)
        starts, ends = self.text_at[own], self.text_at[own] + self.lengths[own]
        self.known.put(*V.word_keys(self.text, starts, ends), np.arange(len(own)))
        self.count = np.ones(len(own), np.int64)
        self.at = np.arange(len(own))
        self.ids = own

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        shape = left.shape
        keys = (left.ravel() << 32 | right.ravel()).astype(V.U64)
        found = self.pairs.get(keys, keys)
        found[found < 0] = NONE
        return found.reshape(shape)

    def _merge_matrix(self, ids: np.ndarray, counts: np.ndarray) -> None:
        """Merge rows of ids in place: the lowest, leftmost pair of each row in every round."""
        ranks = np.full((len(ids), ids.shape[1] - 1), NONE)
        inside = np.arange(1, ids.shape[1])[None, :] < counts[:, None]
        ranks[inside] = self._rank(ids[:, :-1][inside], ids[:, 1:][inside])
        rows = np.arange(len(ids))
        work = ids
        while True:
            at = ranks.argmin(axis=1)
            low = ranks[np.arange(len(rows)), at]
            going = low != NONE
            if not going.all():
                done = ~going
                ids[rows[done], : work.shape[1]] = work[done]
                rows, work, ranks, at, low = rows[going], work[going], ranks[going], at[going], low[going]
            if not len(rows):
                return
            each = np.arange(len(rows))
            counts[rows] -= 1
            work[each, at] = low
            width = work.shape[1]
            for m in np.unique(at).tolist():  # rows that merge at the same place move together
                same = np.flatnonzero(at == m)
                work[same, m + 1 : width - 1] = work[same, m + 2 : width]
                ranks[same, m : width - 2] = ranks[same, m + 1 : width - 1]
            ranks[:, -1] = NONE
            for shift in (-1, 0):  # the pairs before and after the merged token
                near = np.flatnonzero((at + shift >= 0) & (at + shift + 1 < counts[rows]))
                col = at[near] + shift
                ranks[near, col] = self._rank(work[near, col], work[near, col + 1])

    def _merge_long(self, piece: bytes) -> list[int]:
        ranks, n = self.ranks, len(piece)
        end, after, prior = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or (j := after[i]) >= n or end[j] != stop:
                continue
            end[i], after[i], alive[j] = stop, after[j], False
            if after[i] < n:
                prior[after[i]] = i
                if (r := ranks.get(piece[i : end[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[after[i]]))
            if (h := prior[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Merge distinct new pieces and append them to the cache's arrays."""
        size = ends - starts
        counts, flat = size.copy(), []
        for low, high in zip((0, 8, 12, 16, 24), (8, 12, 16, 24, MATRIX_BYTES)):
            group = np.flatnonzero((size > low) & (size <= high))
            for at in range(0, len(group), 20_000):
                part = group[at : at + 20_000]
                grid = np.minimum(starts[part][:, None] + np.arange(high)[None, :], len(data) - 1)
                ids, left = self.byte_ids[data[grid]], size[part].copy()
                self._merge_matrix(ids, left)
                counts[part] = left
                flat.append((part, ids[np.arange(high)[None, :] < left[:, None]]))
        for row in np.flatnonzero(size > MATRIX_BYTES).tolist():
            ids = np.array(self._merge_long(data[starts[row] : ends[row]].tobytes()), np.int64)
            counts[row] = len(ids)
            flat.append((np.array([row]), ids))
        at = np.zeros(len(size), np.int64)
        base = len(self.ids)
        for part, ids in flat:
            at[part] = base + np.cumsum(counts[part]) - counts[part]
            base += len(ids)
        self.ids = np.concatenate([self.ids, *(ids for _, ids in flat)])
        self.count, self.at = np.concatenate([self.count, counts]), np.concatenate([self.at, at])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of a chunk of documents, and the bounds of each document's ids."""
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        full = np.flatnonzero(np.diff(offsets))
        starts = lead[piece_starts(points, np.searchsorted(lead, offsets[full]))]
        ends = np.append(starts[1:], len(data))
        first, second = V.word_keys(data, starts, ends)
        if self.known.size > 1 << (CACHE_BITS - 1) or len(self.ids) > 1 << (CACHE_BITS + 2):
            self._forget()
        found = self.known.get(first, second)
        new = np.flatnonzero(found < 0)
        if len(new):
            keys, index = np.unique(np.stack([first[new], second[new]], 1).view("V16").ravel(), return_index=True)
            pick = new[index]
            base = len(self.count)
            self._learn(data, starts[pick], ends[pick])
            if self.known.size + len(pick) > (1 << CACHE_BITS) * 3 // 4:  # one chunk of mostly new pieces
                order = np.argsort(keys)
                found[new] = base + order[np.searchsorted(keys[order], np.stack([first[new], second[new]], 1).view("V16").ravel())]
                out = self._gather(found, starts, offsets)
                self._forget()
                return out
            self.known.put(first[pick], second[pick], base + np.arange(len(pick)))
            found[new] = self.known.get(first[new], second[new])
        return self._gather(found, starts, offsets)

    def _gather(self, found: np.ndarray, starts: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = self.count[found]
        total = np.concatenate([[0], np.cumsum(counts)])
        return self.ids[V.ranges(self.at[found], counts)], total[np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of a sequence of ids, and the byte offset where each id ends."""
        lengths = self.lengths[ids]
        return self.text[V.ranges(self.text_at[ids], lengths)], np.cumsum(lengths)


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _encoded(batch: pa.RecordBatch, vocab: Vocabulary) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    data, offsets = V.text_buffers(batch.column("text"))
    for i, j in V.pieces(offsets):
        yield batch.slice(i, j - i), *vocab.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def encode(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, token_ends (byte offset of each token's end) per document."""
    path = path or default_path()

    def work(batch):
        vocab = vocabulary(path)
        for own, ids, bounds in _encoded(batch, vocab):
            ends = vocab.decode(ids)[1]
            before = np.concatenate([[0], ends])[np.repeat(bounds[:-1], np.diff(bounds))]
            lists = [pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), pa.array(x, t)).cast(pa.list_(t)) for x, t in ((ids, pa.int32()), (ends - before, pa.int64()))]
            yield pa.RecordBatch.from_arrays([own.column("doc_id"), *lists], names=["doc_id", "ids", "token_ends"])

    return map_text(documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), work, "doc_id long, ids array<int>, token_ends array<long>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the decoded bytes; null ids count as none."""
    path = path or default_path()

    def work(batch):
        vocab = vocabulary(path)
        raw = [vocab.decode(np.array(x or [], np.int64))[0].tobytes() for x in batch.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raw, pa.binary())], names=["doc_id", "decoded"])

    return map_text(encoded.select("doc_id", "ids"), work, "doc_id long, decoded binary")


def round_trip(documents: DataFrame, path: str | None = None) -> DataFrame:
    """Encode, decode and digest: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    path = path or default_path()
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    digest = lambda raw, cuts: pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(cuts, cuts[1:])], pa.string())

    def work(batch):
        vocab = vocabulary(path)
        for own, ids, bounds in _encoded(batch, vocab):
            text, ends = vocab.decode(ids)
            cuts = np.concatenate([[0], ends])[bounds].tolist()
            columns = [pa.array(np.diff(bounds), pa.int64()), digest(ids.astype("<u4").tobytes(), (4 * bounds).tolist()), digest(text.tobytes(), cuts)]
            yield pa.RecordBatch.from_arrays([own.column("doc_id"), *columns], names=names)

    columns = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_text(columns, work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
