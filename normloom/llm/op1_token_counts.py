"""Token counts of a unigram tokenizer without making its tokens.

The pieces of a public SentencePiece vocabulary and their scores are read as a
unigram model: the segmentation with the highest sum of scores.  An
Aho-Corasick automaton enumerates every piece that ends at each character, and
a dynamic program carries only the best score and its number of pieces.  Ties
go to the piece that starts first, as in the tokenizers' own lattice walk; a
character that is no piece costs the least score less 10 and counts its UTF-8
bytes (byte fallback).  Scores are whole numbers and summed exactly.

No piece of the vocabulary continues from another character into a word mark,
which is checked when it is loaded, so the best path of a text is that of its
space-led units one after another.  Counts of units are kept by 128-bit key:
the bytes themselves up to 15, a BLAKE2b digest beyond.

Edge cases: a null or empty text has 0 tokens; units and texts of any length are
whole; repeated rows and ids each get a row, a null id stays null; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normloom.llm import textvec as V
from normloom.llm.common import map_text, table
from normloom.llm.hashtable import Table

#: Slots of a worker's cache of unit counts, as a power of 2; it is emptied when half full.
CACHE_BITS = 21
#: Word mark that stands for a space in the pieces.
MARK = "▁"
_MARK = MARK.encode()


class Unigram:
    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        self.scores = {p.piece: int(p.score) for p in model.pieces if p.type == 1}
        if any(MARK in p.lstrip(MARK) for p in self.scores):
            raise ValueError("a piece goes on from a word into the next")
        self.unknown = min(self.scores.values()) - 10
        self.automaton = ahocorasick.Automaton()
        for piece, score in self.scores.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.known = Table(CACHE_BITS)

    def count(self, unit: str) -> int:
        """Pieces of the best path through one unit, spaces already marked."""
        n, unknown = len(unit), self.unknown
        score, pieces = [0] * (n + 1), [0] * (n + 1)
        filled = 0  # positions up to here are settled
        best, number, single = None, 0, False

        def settle(at: int) -> None:
            nonlocal best, number, single
            if not single and (best is None or score[at - 1] + unknown > best):
                best, number = score[at - 1] + unknown, pieces[at - 1] + len(unit[at - 1].encode())
            score[at], pieces[at] = best, number
            best, number, single = None, 0, False

        for end, (length, gain) in self.automaton.iter(unit):
            while filled < end:
                filled += 1
                settle(filled)
            start = end + 1 - length
            if best is None or score[start] + gain > best:
                best, number = score[start] + gain, pieces[start] + 1
            single = single or length == 1
        while filled < n:
            filled += 1
            settle(filled)
        return pieces[n]

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Token counts of a chunk of documents."""
        if not len(data):
            return np.zeros(len(offsets) - 1, np.int64)
        raw = data.tobytes()
        if _MARK in raw:  # a literal mark is a space to the tokenizer
            parts = [raw[a:b].replace(_MARK, b" ") for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
            data, offsets = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])
        full = np.diff(offsets) > 0
        data = np.insert(data, offsets[:-1][full], 32)  # the tokenizer's own leading space
        offsets = offsets + np.concatenate([[0], np.cumsum(full)])
        space = data == 32
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        begins[offsets[:-1][full]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(data))
        first, second = V.word_keys(data, starts, ends)
        if self.known.size > 1 << (CACHE_BITS - 1):
            self.known = Table(CACHE_BITS)
        found = self.known.get(first, second)
        new = np.flatnonzero(found < 0)
        if len(new):
            _, index, inverse = np.unique(np.stack([first[new], second[new]], 1).view("V16").ravel(), return_index=True, return_inverse=True)
            pick = new[index]
            blob = data.tobytes()
            fresh = np.array([self.count(blob[a:b].decode().replace(" ", MARK)) for a, b in zip(starts[pick].tolist(), ends[pick].tolist())], np.int64)
            found[new] = fresh[inverse]
            if self.known.size + len(pick) < (1 << CACHE_BITS) * 3 // 4:
                self.known.put(first[pick], second[pick], fresh)
        total = np.concatenate([[0], np.cumsum(found)])
        return np.diff(total[np.searchsorted(starts, offsets)])


@cache
def unigram(path: str) -> Unigram:
    return Unigram(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def token_counts(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and n_tokens of each whole text."""
    path = path or default_path()

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        model = unigram(path)
        data, offsets = V.text_buffers(batch.column("text"))
        for i, j in V.pieces(offsets):
            counts = model.counts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            yield pa.RecordBatch.from_arrays([batch.slice(i, j - i).column("doc_id"), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    return map_text(documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), work, "doc_id long, n_tokens long")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
