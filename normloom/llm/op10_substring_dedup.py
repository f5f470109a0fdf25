"""Removal of long passages that earlier documents have.

A window is 50 consecutive words.  Its anchor is the least hash of its 26-word
runs: equal windows have equal anchors, and neighbouring windows mostly share
theirs, so a text has about one anchor for 13 windows.  A first pass counts
anchors in count-min sketches, one for each input partition, sent as sorted
cell numbers and merged by range of cells; what remains is a bitmap of the
cells counted twice or more.  A window occurs no more often than its anchor and
sketches only overestimate, so no repeated window is lost.  A second pass groups
exactly, by 128-bit hash, only the windows whose cells are all set, finds each
one's smallest document, and tells the others which of their windows to remove.
A window of very many documents is told to them by broadcast, not by shuffle.

Documents that are equal word for word are settled before: only the smallest
of each goes through the passes, and every word of the others is in a window
that the smallest has (if there are 50).

The bitmap has at most `DEPTH` times 2**`CELL_BITS` bits whatever the input, so
it is broadcast; with more windows than it can tell apart, more of them are
grouped exactly, and the result is the same.

Edge cases: a null text has no words; a text of fewer than 50 words loses none;
passages repeated only within a document stay; rows that share a doc_id, with
equal texts or not, are judged and reported each by its own text, and no row
has a smaller id than another of its own id; a row without id loses nothing and
takes nothing from others; texts of any length are whole; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normloom.llm import textvec as V
from normloom.llm.common import cut, map_text, skew_join, small, table

#: Words of a window (a fixed value of the contract).
WINDOW = 50
#: Words of the runs of which a window's anchor is the least.
RUN = 26
#: Rows of the sketch, and cells of a row at most, as a power of 2.
DEPTH, CELL_BITS = 2, 28
#: Cells merged by one task, as a power of 2.
RANGE_BITS = 22
#: Ids told to every task at most; more are joined by shuffle.
TOLD = 1_000_000



def _words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each piece of a batch: first and last row, bytes, word starts, ends, per-document bounds, word hashes."""
    data, offsets = V.text_buffers(column)
    for i, j in V.pieces(offsets):
        own = data[offsets[i] : offsets[j]]
        starts, ends, bounds = V.word_spans(~V.SPACE[own], offsets[i : j + 1] - offsets[i])
        yield i, j, own, starts, ends, bounds, V.word_hashes(own, starts, ends)


def _whole_windows(bounds: np.ndarray, window: int) -> np.ndarray:
    """Word positions at which a window within one document starts."""
    return V.ranges(bounds[:-1], np.maximum(np.diff(bounds) - window + 1, 0))


def anchors(words: np.ndarray, at: np.ndarray, window: int, run: int) -> np.ndarray:
    """Least hash of the `run`-word runs inside each window that starts at a position of `at`."""
    least, reach, span = V.window_hashes(words, run), 1, window - run + 1
    while 2 * reach <= span:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    return np.minimum(least[at], least[at + span - reach])


def texts_of(documents: DataFrame) -> DataFrame:
    """doc_id, text and own: with doc_id the key of a row, whatever ids repeat."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("own", F.xxhash64("text"))


def sequences(documents: DataFrame) -> DataFrame:
    """doc_id, own, number of words and a digest of the word sequence."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i, j, own, starts, ends, bounds, _ in _words(batch.column("text")):
            first, last = bounds[:-1].tolist(), bounds[1:].tolist()
            blob = np.where(V.SPACE[own], np.uint8(32), own)
            keep = ~V.SPACE[own]
            keep[1:] |= keep[:-1]  # one separator after each word
            packed = blob[keep].tobytes()
            at = np.concatenate([[0], np.cumsum(keep)])
            begin = at[starts] if len(starts) else np.zeros(0, np.int64)
            finish = at[ends] if len(ends) else begin
            digests = [hashlib.md5(packed[begin[a] : finish[b - 1]]).digest() if b > a else b"" for a, b in zip(first, last)]
            yield pa.RecordBatch.from_arrays([*(batch.slice(i, j - i).column(c) for c in ("doc_id", "own")), pa.array(np.diff(bounds), pa.int64()), pa.array(digests, pa.binary())], names=["doc_id", "own", "n_words", "sequence"])

    return map_text(documents, work, "doc_id long, own long, n_words long, sequence binary")


def cells(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    """Cell of each window in a row of the sketch."""
    return V.mix(keys ^ V.U64(0x51ED2701A6F3C9 * (row + 1))) >> V.U64(64 - bits)


def _pack(sorted_cells: np.ndarray, counts: np.ndarray) -> bytes:
    """Cells of a range as differences, doubled, with a last bit for a count over 1; 7 bits a byte."""
    gaps = np.diff(sorted_cells, prepend=sorted_cells[:1] * 0).astype(np.uint64) * 2 + (counts > 1)
    size = 1 + sum((gaps >= np.uint64(1 << s)).astype(np.int64) for s in (7, 14, 21))
    out = np.zeros(int(size.sum()), np.uint8)
    at = np.cumsum(size) - size
    for k in range(4):
        has = size > k
        part = (gaps[has] >> np.uint64(7 * k)) & np.uint64(127)
        out[at[has] + k] = part.astype(np.uint8) | np.where(size[has] > k + 1, 128, 0).astype(np.uint8)
    return out.tobytes()


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(blob, np.uint8)
    last = np.flatnonzero(raw < 128)
    first = np.concatenate([[0], last[:-1] + 1])
    value = np.zeros(len(last), np.int64)
    for k in range(4):
        inside = first + k <= last
        value[inside] |= (raw[first[inside] + k] & 127).astype(np.int64) << (7 * k)
    return np.cumsum(value >> 1), 1 + (value & 1)


def repeated_cells(documents: DataFrame, windows: int, window: int = WINDOW, most_bits: int = CELL_BITS) -> tuple[int, list[np.ndarray]]:
    """Bits of a row, and for each row of the sketch the bitmap of cells counted twice or more."""
    bits = min(most_bits, max(10, int(windows).bit_length()))  # about 13 cells an anchor
    low = min(bits, RANGE_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def send() -> Iterator[pa.RecordBatch]:
            keys = np.concatenate(held)
            for row in range(DEPTH):
                at, n = np.unique(cells(keys, row, bits), return_counts=True)
                parts = np.searchsorted(at, np.arange(0, (1 << bits) + 1, 1 << low).astype(np.uint64))
                spans = [(p, a, b) for p, (a, b) in enumerate(zip(parts[:-1].tolist(), parts[1:].tolist())) if b > a]
                blobs = [_pack(at[a:b].astype(np.int64) - (p << low), n[a:b]) for p, a, b in spans]
                yield pa.RecordBatch.from_arrays([pa.array([row << 32 | p for p, *_ in spans], pa.int64()), pa.array(blobs, pa.binary())], names=["part", "cells"])

        for batch in batches:
            for *_, bounds, words in _words(batch.column("text")):
                at = _whole_windows(bounds, window)
                if not len(at):
                    continue
                keys = anchors(words, at, window, min(RUN, window))
                # once for each stretch of windows with one anchor
                new = np.append(True, (keys[1:] != keys[:-1]) | (at[1:] != at[:-1] + 1))
                held.append(keys[new])
                size += len(held[-1])
                if size > 4_000_000:
                    yield from send()
                    held, size = [], 0
        if size:
            yield from send()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}  # rows come sorted by part: one array at a time
        current = None
        for batch in batches:
            for part, blob in zip(batch.column("part").to_pylist(), batch.column("cells").to_pylist()):
                if part != current:
                    if current is not None:
                        yield finished(current, counts.pop(current))
                    current, counts[part] = part, np.zeros(1 << low, np.uint8)
                at, n = _unpack(blob)
                own = counts[part]
                own[at] = np.minimum(own[at] + n, 2)
        if current is not None:
            yield finished(current, counts.pop(current))

    def finished(part: int, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([np.packbits(counts > 1, bitorder="little").tobytes()], pa.binary())], names=["part", "bitmap"])

    sent = documents.mapInArrow(count, "part long, cells binary")
    merged = sent.repartition(DEPTH << (bits - low), "part").sortWithinPartitions("part").mapInArrow(merge, "part long, bitmap binary")
    maps = [np.zeros(1 << max(0, bits - 3), np.uint8) for _ in range(DEPTH)]
    width = max(1, (1 << low) >> 3)
    for r in merged.toLocalIterator():  # DEPTH bitmaps of at most 2**CELL_BITS bits in all
        at = (r["part"] & 0xFFFFFFFF) * width
        maps[r["part"] >> 32][at : at + width] = np.frombuffer(r["bitmap"], np.uint8)
    return bits, maps


def candidate_windows(documents: DataFrame, bits: int, maps: list[np.ndarray], window: int = WINDOW) -> DataFrame:
    """doc_id, own, position and 128-bit key of each window whose anchor's cells are all counted twice or more."""
    told = documents.sparkSession.sparkContext.broadcast(maps)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i, j, *_, bounds, words in _words(batch.column("text")):
            at = _whole_windows(bounds, window)
            if not len(at):
                continue
            anchor = anchors(words, at, window, min(RUN, window))
            for row, bitmap in enumerate(told.value):
                cell = cells(anchor, row, bits)
                flagged = (bitmap[(cell >> V.U64(3)).astype(np.int64)] >> (cell & V.U64(7)).astype(np.uint8)) & 1 > 0
                at, anchor = at[flagged], anchor[flagged]
            if len(at):
                owner = np.searchsorted(bounds, at, "right") - 1
                keys, second = V.window_hashes(words, window), V.window_hashes(words, window, True)
                row = pa.array(owner + i)
                arrays = [*(batch.column(c).take(row) for c in ("doc_id", "own")), pa.array((at - bounds[owner]).astype(np.int32)), *(pa.array(k[at].view(np.int64)) for k in (keys, second))]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "own", "at", "k1", "k2"])

    return map_text(documents, work, "doc_id long, own long, at int, k1 long, k2 long")


def removed_windows(candidates: DataFrame) -> DataFrame:
    """doc_id, own and the sorted positions of its windows that a smaller document has; candidates are cut."""
    # the smallest and largest document of each window, pre-aggregated before the shuffle
    seen = candidates.groupBy("k1", "k2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("n"))
    shared = cut(seen.where("most > least").select("k1", "k2", "least", "n"))
    hits = skew_join(candidates, shared, ["k1", "k2"]).where("doc_id > least")
    return hits.groupBy("doc_id", "own").agg(F.array_sort(F.collect_set("at")).alias("windows"))


def removals(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text, own, windows (positions to remove) and copy (equal to a smaller document)."""
    texts = texts_of(documents)
    keyed = cut(sequences(texts))
    firsts = cut(keyed.where(F.col("n_words") >= window).groupBy("sequence").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1"))
    copies = skew_join(keyed, firsts, ["sequence"]).where("doc_id > first_id")
    copies = cut(copies.select(F.col("doc_id").alias("copy_id"), F.col("own").alias("copy_own")).distinct())
    totals = keyed.agg(F.sum(F.greatest(F.col("n_words") - window + 1, F.lit(0))).alias("n")).first()
    told, is_copy = small(copies, most=TOLD), (F.col("doc_id") == F.col("copy_id")) & (F.col("own") == F.col("copy_own"))
    kept = texts.join(told, is_copy, "left_anti").where(F.col("text").isNotNull())
    bits, maps = repeated_cells(kept, totals["n"] or 0, window)
    hits = cut(removed_windows(cut(candidate_windows(kept, bits, maps, window))))
    marked = texts.join(told, is_copy, "left").withColumn("copy", F.col("copy_id").isNotNull()).drop("copy_id", "copy_own")
    hit = hits.withColumnsRenamed({"doc_id": "hit_id", "own": "hit_own"})
    return marked.join(small(hit, most=TOLD // 20), (F.col("doc_id") == F.col("hit_id")) & (F.col("own") == F.col("hit_own")), "left").drop("hit_id", "hit_own")


def cleaned(marked: DataFrame, digest: bool = False, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words, joined by one space (or their SHA-256)."""
    name = "kept_sha256" if digest else "kept"

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        copies, windows = batch.column("copy").to_pylist(), batch.column("windows")
        for i, j, own, starts, ends, bounds, _ in _words(batch.column("text")):
            n = len(starts)
            gone = np.zeros(n + 1, np.int64)
            for row in range(i, j):
                a, b = bounds[row - i], bounds[row - i + 1]
                if copies[row] and b - a >= window:
                    gone[a] += 1
                    gone[b] -= 1
                elif windows[row].is_valid:
                    at = a + np.asarray(windows[row].values, np.int64)
                    at = at[at + window <= b]
                    np.add.at(gone, at, 1)
                    np.add.at(gone, at + window, -1)
            stay = np.cumsum(gone[:n]) == 0
            removed = np.concatenate([[0], np.cumsum(~stay)])[bounds]
            blob = own.tobytes()
            where = np.flatnonzero(stay)
            pieces = [blob[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist())]
            cuts = np.searchsorted(where, bounds).tolist()
            kept = [b" ".join(pieces[a:b]) for a, b in zip(cuts, cuts[1:])]
            texts = [hashlib.sha256(x).hexdigest() for x in kept] if digest else [x.decode() for x in kept]
            yield pa.RecordBatch.from_arrays([batch.slice(i, j - i).column("doc_id"), pa.array(np.diff(bounds), pa.int64()), pa.array(np.diff(removed), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "n_words", "n_removed", name])

    return map_text(marked, work, f"doc_id long, n_words long, n_removed long, {name} string")


def substring_dedup(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept."""
    return cleaned(removals(documents, window), window=window)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(removals(table(spark, sf_dir, "documents")), digest=True)
