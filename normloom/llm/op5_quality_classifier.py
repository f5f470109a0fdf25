"""Quality classifier: regularised quadratic discriminant on document statistics.

Each whole text becomes a vector of transformed statistics (logit-like shares
and logarithms).  A Gaussian is fitted to each class; its covariance is shrunk
towards the pooled one and towards its own diagonal, and factored once.  A
score is the logistic of the difference of the Mahalanobis log-densities plus
the log prior ratio, computed from the cached Cholesky factors.

Labels are learned from rows with crc32(doc_id as text) mod 4 <> 2 only, at most
`SAMPLE` of them, those with the smallest hash of their id; statistics and
scores cover every text whole.  Labels, language, source and id are no inputs.

Edge cases: a null or empty text has all statistics 0 and a score; texts of any
length are whole; repeated rows and ids each get a row, and rows of one id count
each in the fit, in an order that their statistics fix; a null id has no label;
duplicate labels of an id count once, the greater one; without labels of both
classes every score is 0.5; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normloom.llm import docstats
from normloom.llm import textvec as V
from normloom.llm.common import cut, map_text, table

#: Labelled rows that the fit takes at most.
SAMPLE = 50_000
#: Weights of the pooled covariance and of the own diagonal in a class covariance.
POOL, DIAGONAL = 0.5, 0.2
#: Score from which a text counts as label 1.
THRESHOLD = 0.7


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    """A row of transformed statistics for each document."""
    s = {k: np.asarray(v, float) for k, v in s.items()}
    words, chars, lines, letters = (np.maximum(s[k], 1) for k in ("n_words", "word_chars", "n_lines", "n_letters"))

    def share(top: np.ndarray, bottom: np.ndarray) -> np.ndarray:
        """Log of a share, flattened near 0."""
        return np.log(np.minimum(top / bottom, 4) + 0.01)

    return np.stack(
        [
            np.log1p(s["n_words"]),
            np.log(s["word_chars"] / words + 1),
            share(s["n_symbols"], chars),
            share(s["n_dup_lines"], lines),
            share(s["n_repeat_words"], words),
            share(s["n_again"], words),
            share(s["n_words"] - s["n_again"], words),
            share(s["n_upper"], letters),
            share(s["n_digits"], chars),
            share(s["n_marks"], words),
            np.log1p(s["n_words"] / lines),
        ],
        axis=1,
    )


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors and log normalisers of two Gaussians."""

    means: np.ndarray
    factors: np.ndarray
    constants: np.ndarray
    centre: np.ndarray
    scale: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.centre) / self.scale, -8, 8)
        density = []
        for c in (0, 1):
            z = (x - self.means[c]) @ self.factors[c].T
            density.append(self.constants[c] - 0.5 * (z * z).sum(axis=1))
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, pool: float = POOL, diagonal: float = DIAGONAL) -> Discriminant | None:
    """The discriminant of rows x with classes y, None if a class is missing."""
    if min((y == 0).sum(), (y == 1).sum()) == 0:
        return None
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    x = np.clip((x - centre) / scale, -8, 8)
    d = x.shape[1]
    parts = [x[y == c] for c in (0, 1)]
    covariances = [np.atleast_2d(np.cov(p.T, bias=True)) for p in parts]
    pooled = sum(len(p) * c for p, c in zip(parts, covariances)) / len(x)
    means, factors, constants = [], [], []
    for part, own in zip(parts, covariances):
        own = (1 - pool) * own + pool * pooled
        own = (1 - diagonal) * own + diagonal * np.diag(np.diag(own)) + 1e-3 * np.eye(d)
        lower = np.linalg.cholesky(own)
        means.append(part.mean(axis=0))
        factors.append(np.linalg.inv(lower))
        constants.append(np.log(len(part) / len(x)) - np.log(np.diag(lower)).sum())
    return Discriminant(np.array(means), np.array(factors), np.array(constants), centre, scale)


def statistics(documents: DataFrame) -> DataFrame:
    """doc_id and the statistics of each whole text."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, offsets = V.text_buffers(batch.column("text"))
        for i, j in V.pieces(offsets):
            s = docstats.statistics(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            yield pa.RecordBatch.from_arrays([batch.slice(i, j - i).column("doc_id"), *(pa.array(s[c], pa.int64()) for c in docstats.COLUMNS)], names=["doc_id", *docstats.COLUMNS])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in docstats.COLUMNS)
    return map_text(documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), work, schema)


def held_out(modulus: int, remainder: int) -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder


def learn(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Discriminant | None:
    marked = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("label_id")).agg(F.max("quality").alias("quality"))
    rows = stats.where(~held_out(4, 2)).join(marked, F.col("doc_id") == F.col("label_id")).withColumn("order", F.xxhash64("doc_id"))
    got = rows.orderBy("order", "doc_id", *docstats.COLUMNS).limit(sample).select("quality", *docstats.COLUMNS).toPandas()
    return fit(features({c: got[c].to_numpy() for c in docstats.COLUMNS}), got["quality"].to_numpy()) if len(got) else None


def score(stats: DataFrame, model: Discriminant | None) -> DataFrame:
    """doc_id and score."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x = features({c: batch.column(c).to_numpy(zero_copy_only=False) for c in docstats.COLUMNS})
        out = model.score(x) if model else np.full(len(x), 0.5)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out)], names=["doc_id", "score"])

    return map_text(stats, work, "doc_id long, score double")


def quality_scores(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id and score of each document."""
    stats = cut(statistics(documents))  # a few numbers a document, read twice
    return score(stats, learn(stats, labels, sample))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    predicted = F.when(F.col("score") >= THRESHOLD, 1).otherwise(0)
    return out.select("doc_id", F.coalesce(held_out(4, 2), F.lit(False)).alias("held_out"), "score", predicted.alias("predicted"))
