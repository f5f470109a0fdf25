"""Toxicity by multiple-instance learning.

A text is a bag of sentences.  The score of a sentence is the logistic of a sum
of weights of its words and of their first letters, and the score of the text is
their noisy-or: one minus the product of the sentences' chances of being
harmless.  The weights are trained by gradient steps on that document likelihood
from document labels alone, so the sentences that carry the label are found on
the way, and `judged` lists them.  Words outside the learned vocabulary weigh
nothing, and a sentence without any of its words is harmless, so long texts gain
no score by length.

Labels are learned from rows with crc32(doc_id as text) mod 3 <> 1 only, at most
`SAMPLE` of them, those with the smallest hash of their id.  Executors count the
signs of these rows and turn them into sentences of sign numbers; the driver
gets the best `VOCABULARY` signs and at most `ENTRIES` sign numbers, of rows in
the order of their hash, and trains on these.  Scores cover every text whole.
Labels, language, source and id are no inputs.

Edge cases: a null or empty text has the least score and no spans; texts of any
length are whole; repeated rows and ids each get a row, and count once in the
fit; a null id has no label; duplicate labels of an id count once, as toxic if
any says so; without toxic labels every text has the least score; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from normloom.llm.common import cut, map_text, table
from normloom.llm.op5_quality_classifier import held_out

#: Labelled rows that the fit takes at most.
SAMPLE = 8_000
#: Sign numbers that reach the driver at most, rows whole.
ENTRIES = 4_000_000
#: Score from which a sentence is listed.
OFFENDING = 0.5
#: Signs (words and beginnings) that the model has at most: those with the strongest association.
VOCABULARY = 600
#: Labelled documents that a sign is in at least, and standard errors of its association.
LEAST, ERRORS = 4, 4.0
#: Letters of the beginnings that count as signs besides whole words.
BEGINNINGS = (3, 4, 5)
#: A sentence's log-odds before its signs; training may lower it.
BIAS = -4.0
THRESHOLD = 0.7
STEPS, RATE, DECAY = 300, 0.1, 1.0
#: Factor of the prior weights, and documents that halve it.
PRIOR, SUPPORT = 1.5, 10
#: Score of a text without any sign.
LEAK = 1e-3

_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")


def signs(word: str) -> list[str]:
    """The word and its beginnings, which a star marks."""
    return [word, *(word[:k] + "*" for k in BEGINNINGS if len(word) > k)]


def noisy_or(chances: Iterable[float]) -> float:
    harmless = 1 - LEAK
    for p in chances:
        harmless *= 1 - p
    return 1 - harmless


@dataclass
class Model:
    weights: dict[str, float]
    bias: float

    def __post_init__(self) -> None:
        self.heads = {w[: BEGINNINGS[0]] for w in self.weights}
        self.known: dict[str, float | None] = {}

    def weight(self, word: str) -> float | None:
        """Sum of the weights of a word's signs, None if it has none."""
        if word not in self.known:
            found = [w for x in signs(word) if (w := self.weights.get(x)) is not None]
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[word] = sum(found) if found else None
        return self.known[word]

    def sentence(self, text: str) -> float:
        heads, k = self.heads, BEGINNINGS[0]
        found = [w for x in _WORD.findall(text) if x[:k] in heads and (w := self.weight(x)) is not None]
        return 1 / (1 + exp(-min(30, max(-30, sum(found) + self.bias)))) if found else 0.0

    def scored(self, text: str) -> Iterator[tuple[int, int, float]]:
        """Start, end and score of each sentence that has any sign."""
        low = text.lower()
        if len(low) != len(text):  # a letter whose lower case is longer stays
            low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
        for m in _SENTENCE.finditer(low):
            if p := self.sentence(m.group()):
                yield m.start(), m.end(), p

    def score(self, text: str) -> float:
        return noisy_or(p for *_, p in self.scored(text))


def signs_of(text: str) -> set[str]:
    """Distinct signs of a text."""
    return {sign for w in set(_WORD.findall(text.lower())) for sign in signs(w)}


def bag(text: str, words: dict[str, int], heads: set[str]) -> list[list[int]]:
    """Sign numbers of each sentence that has any."""
    out = []
    for m in _SENTENCE.finditer(text.lower()):
        found = [k for x in _WORD.findall(m.group()) if x[: BEGINNINGS[0]] in heads for sign in signs(x) if (k := words.get(sign)) is not None]
        if found:
            out.append(found)
    return out


def _heads(words: Iterable[str]) -> set[str]:
    return {w[: BEGINNINGS[0]] for w in words}


def strongest(counts: DataFrame, n0: int, n1: int, size: int = VOCABULARY) -> list[tuple[str, int, int]]:
    """The signs of the strongest association with the label; counts: sign, k0, k1 (documents of either label)."""
    p0, p1 = F.col("k0") / n0, F.col("k1") / n1
    z = (p1 - p0) / F.sqrt((p0 * (1 - p0) + 1 / n0) / n0 + (p1 * (1 - p1) + 1 / n1) / n1)
    clear = (z >= ERRORS) | ((F.col("k1") >= LEAST) & (F.col("k0") == 0))
    found = counts.withColumn("z", z).where((F.col("k1") > 0) & (F.col("k0") + F.col("k1") >= LEAST) & clear)
    return [(r["sign"], r["k0"], r["k1"]) for r in found.orderBy(F.desc("z"), "sign").limit(size).collect()]


def priors(chosen: list[tuple[str, int, int]], n0: int, n1: int) -> dict[str, float]:
    """Prior weight of each sign: the log-odds of the label given it, shared among the signs of one beginning.

    Without it, words that always come together would leave all weight to one.
    """
    alike = Counter(w[: BEGINNINGS[0]] for w, *_ in chosen)
    odds = {w: PRIOR * k1 / (k1 + SUPPORT) * np.log((k1 + 0.5) / (n1 + 1) * (n0 + 1) / (k0 + 0.5)) for w, k0, k1 in chosen}
    return {w: float(x) / alike[w[: BEGINNINGS[0]]] for w, x in odds.items()}


def train(columns: np.ndarray, rows: np.ndarray, owner: np.ndarray, toxic: np.ndarray, prior: dict[str, float]) -> Model:
    """Noisy-or maximum likelihood by Adam: columns and rows give the sign and sentence of each entry, owner each sentence's text."""
    vocabulary, start = list(prior), np.array(list(prior.values()))
    weights, bias = start.copy(), BIAS
    m, v = np.zeros(len(weights) + 1), np.zeros(len(weights) + 1)
    for step in range(1, STEPS + 1):
        z = np.bincount(rows, weights[columns], minlength=len(owner)) + bias
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        harmless = np.exp(np.bincount(owner, np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=len(toxic))) * (1 - LEAK)
        # d log-likelihood / dz of a sentence: its score, times the pull of its document's label
        pull = np.where(toxic == 1, harmless / np.maximum(1 - harmless, 1e-9), -1.0)
        gradient_z = pull[owner] * p / len(toxic)
        g = np.append(np.bincount(columns, gradient_z[rows], minlength=len(weights)) - DECAY * (weights - start) / len(toxic), gradient_z.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = RATE * (0.2 if step > STEPS * 3 // 4 else 1) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        weights, bias = weights + move[:-1], min(bias + move[-1], BIAS)
    return Model(dict(zip(vocabulary, weights.tolist())), float(bias))


def sample_of(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """order, text and toxic of the labelled rows that the fit takes, cut; equal rows once."""
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(3, 1)).groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    picked = marked.orderBy(F.xxhash64("label_id"), "label_id").limit(sample)  # ids only, so many at most
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("own", F.xxhash64("text"))
    rows = texts.join(F.broadcast(picked), F.col("doc_id") == F.col("label_id"))
    order = ["order", "doc_id", "own"]
    named = cut(rows.select(F.xxhash64("doc_id").alias("order"), "doc_id", "own").distinct().orderBy(*order).limit(sample))
    named = named.select(F.row_number().over(Window.orderBy(*order)).alias("n"), F.col("doc_id").alias("id_"), F.col("own").alias("own_"))
    taken = rows.join(F.broadcast(named), (F.col("doc_id") == F.col("id_")) & (F.col("own") == F.col("own_")))
    return cut(taken.dropDuplicates(["n"]).select("n", F.coalesce("text", F.lit("")).alias("text"), "toxic"))


def learn(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, entries: int = ENTRIES) -> Model:
    """The model of the sample's rows; the driver gets counts and sign numbers, never texts."""
    rows = sample_of(documents, labels, sample)
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n0, n1 = max(1, n.get(0, 0)), max(1, n.get(1, 0))

    def count(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        inside: tuple[Counter, Counter] = (Counter(), Counter())
        for text, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            inside[y].update(signs_of(text))
        found = list(inside[0] | inside[1])
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), *(pa.array([c[x] for x in found], pa.int64()) for c in inside)], names=["sign", "k0", "k1"])

    counted = map_text(rows, count, "sign string, k0 long, k1 long").groupBy("sign").agg(F.sum("k0").alias("k0"), F.sum("k1").alias("k1"))
    prior = priors(strongest(counted, n0, n1), n0, n1) if n.get(1) else {}
    if not prior:
        return Model({}, BIAS)
    words, heads = {w: k for k, w in enumerate(prior)}, _heads(prior)

    def number(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = [bag(text, words, heads) for text in batch.column("text").to_pylist()]
        lists = [pa.array(x, pa.list_(pa.int32())) for x in ([[k for s in b for k in s] for b in found], [[len(s) for s in b] for b in found])]
        yield pa.RecordBatch.from_arrays([batch.column("n"), batch.column("toxic"), *lists], names=["n", "toxic", "signs", "sizes"])

    numbered = cut(map_text(rows, number, "n int, toxic int, signs array<int>, sizes array<int>"))
    sizes = sorted((r["n"], r["size"]) for r in numbered.select("n", F.size("signs").alias("size")).collect())
    fits = np.cumsum([s for _, s in sizes]) <= entries
    last = max((n_ for (n_, _), ok in zip(sizes, fits) if ok), default=0)
    got = numbered.where(F.col("n") <= last).orderBy("n").toArrow()
    per = [got.column(c).combine_chunks() for c in ("signs", "sizes")]
    columns, lengths = (x.flatten().to_numpy() for x in per)
    sentences = np.array([len(x) for x in got.column("sizes").to_pylist()], np.int64)
    owner = np.repeat(np.arange(len(sentences)), sentences)
    return train(columns, np.repeat(np.arange(len(lengths)), lengths), owner, got.column("toxic").to_numpy(), prior)


def judged(documents: DataFrame, model: Model, least: float = OFFENDING) -> DataFrame:
    """doc_id, score and spans of each document: start:end (code points) of its offending sentences, comma-joined."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        scores, spans = [], []
        for text in batch.column("text").to_pylist():
            found = list(model.scored(text)) if text else []
            scores.append(noisy_or(p for *_, p in found))
            spans.append(",".join(f"{a}:{b}" for a, b, p in found if p >= least))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(spans, pa.string())], names=["doc_id", "score", "spans"])

    return map_text(documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), work, "doc_id long, score double, spans string")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    out = judged(documents, learn(documents, table(spark, sf_dir, "labels")))
    predicted = F.when(F.col("score") >= THRESHOLD, 1).otherwise(0)
    return out.select("doc_id", F.coalesce(held_out(3, 1), F.lit(False)).alias("held_out"), "score", predicted.alias("predicted"), "spans")
