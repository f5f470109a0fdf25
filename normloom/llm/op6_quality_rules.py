"""Quality rules with risk-controlled thresholds.

Exact rules reject a text of fewer than 20 words or with over 30 % of its words
in repeated 8-word windows.  Further rules are cutoffs on document statistics,
taken from fixed grids.  They are chosen for each stratum (one of the most
labelled languages, or all others) by learn-then-test.  Its good labelled rows
are halved by a hash of their id.  On the first half a path is laid from no
cutoff to stricter and stricter ones: each step tightens the rule that rejects
the fewest good documents with it, until over `AIM` of `risk` is used.  On the
second half the steps are tested in that order: the exact (Clopper-Pearson)
upper bound of the share of good documents that all cutoffs together reject
must stay within `risk`.  The first step that fails ends the tests, so a path
needs one error probability for all its steps, and the correction for multiple
tests (Bonferroni) is one for strata only.  The last step that passes is used;
a stratum with too few labels to prove any keeps everything that passes the
exact rules.

Edge cases: a null or empty text has no words and is rejected; a null language
is a stratum of its own; texts of any length are whole; repeated rows and ids
each get a row, a label counts for every row of its id; a null id has no label;
an empty table gives an empty result; other columns are ignored, and kept by
`kept_documents`; with an empty label table only the exact rules hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from normloom.llm import docstats, textvec
from normloom.llm.common import BROADCAST_ROWS, cut, map_text, table

#: Greatest share of good documents of a stratum that learned cutoffs may reject.
RISK = 0.02
#: Chance that any of the bounds is wrong.
DELTA = 0.05
#: Share of `risk` that the path may use on the half of the labels that it is laid on.
AIM = 0.25
#: Strata are the most labelled languages, so many at most; the rest are pooled.
STRATA = 64
#: The stratum of all other languages.
POOLED = ("pooled",)
Stratum = str | None | tuple[str]
#: What a stratum rejects: the level of each rule's cutoff, 0 for none, 1 for the mildest.
Levels = dict[str, int]
#: Rule: numerator, denominator and cutoffs, from the mildest to the strictest.
RULES = {
    "symbols": ("n_symbols", "word_chars", [0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08]),
    "dup_lines": ("n_dup_lines", "n_lines", [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3]),
    "upper": ("n_upper", "n_letters", [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3]),
    "marks": ("n_marks", "n_words", [2.0, 1.5, 1.2, 1.0, 0.8, 0.7]),
    "long_words": ("word_chars", "n_words", [60.0, 40.0, 30.0, 20.0, 15.0]),
    "few_kinds": ("n_again", "n_words", [0.97, 0.95, 0.9, 0.85, 0.8, 0.7]),
    "repeats": ("n_repeat_words", "n_words", [0.3, 0.25, 0.2, 0.15, 0.1]),
}
_OUT = "doc_id long, lang string, " + ", ".join(f"{c} long" for c in docstats.COLUMNS)


def upper_bound(k: int, n: int, delta: float) -> float:
    """Clopper-Pearson upper bound of a binomial rate, k of n, by bisection."""
    if k >= n:
        return 1.0
    from math import exp, lgamma, log, log1p

    comb = [lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) for i in range(k + 1)]
    low, high = k / n, 1.0
    for _ in range(60):
        p = (low + high) / 2
        if p >= 1 or sum(exp(c + i * log(p) + (n - i) * log1p(-p)) for i, c in enumerate(comb)) <= delta:
            high = p
        else:
            low = p
    return high


def document_statistics(documents: DataFrame) -> DataFrame:
    """doc_id, lang and the statistics of each whole text."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, offsets = textvec.text_buffers(batch.column("text"))
        for i, j in textvec.pieces(offsets):
            stats = docstats.statistics(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            own = batch.slice(i, j - i)
            yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("lang"), *(pa.array(stats[c], pa.int64()) for c in docstats.COLUMNS)], names=["doc_id", "lang", *docstats.COLUMNS])

    columns = [F.col("doc_id").cast("long"), F.col("text").cast("string"), (F.col("lang") if "lang" in documents.columns else F.lit(None)).cast("string").alias("lang")]
    return map_text(documents.select(*columns), work, _OUT)


def with_statistics(documents: DataFrame) -> DataFrame:
    """The rows and columns of `documents` with the statistics of each text as fields of `stats_`."""
    schema = StructType([*documents.schema.fields, StructField("stats_", StructType([StructField(c, LongType()) for c in docstats.COLUMNS]))])

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, offsets = textvec.text_buffers(batch.column("text"))
        for i, j in textvec.pieces(offsets):
            stats = docstats.statistics(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            fields = pa.StructArray.from_arrays([pa.array(stats[c], pa.int64()) for c in docstats.COLUMNS], docstats.COLUMNS)
            yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, fields], names=[*batch.schema.names, "stats_"])

    return map_text(documents, work, schema)


def labelled_statistics(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics of the documents with a good label, each once a row.

    While the good ids are few enough to broadcast, only their texts are read
    for it; beyond, all statistics are taken and joined, not the texts.
    """
    good = labels.where(F.col("quality") == 1).select(F.col("doc_id").cast("long").alias("good_id")).where("good_id is not null").distinct()
    is_good = F.col("doc_id").cast("long") == F.col("good_id")
    if good.count() <= BROADCAST_ROWS:
        return document_statistics(documents.join(F.broadcast(good), is_good, "left_semi"))
    return document_statistics(documents).join(good, is_good, "left_semi")


def kept_documents(documents: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """The documents that the rules keep, with their own columns, judged in one scan without a join."""
    chosen = learn(labelled_statistics(documents, labels), risk, delta)
    marked = with_statistics(documents)
    judged = apply(marked.select(F.struct(*documents.columns).alias("own"), F.col("lang").cast("string").alias("lang"), "stats_.*"), chosen)
    return judged.where("kept").select("own.*")


def _beyond(rule: str) -> F.Column:
    """How many cutoffs of the rule's grid the document exceeds."""
    top, bottom, cutoffs = RULES[rule]
    ratio = F.col(top) / F.greatest(F.col(bottom), F.lit(1))
    return sum((F.when(ratio > c, 1).otherwise(0) for c in cutoffs), F.lit(0))


def base_failed() -> F.Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _rejected(steps: np.ndarray, levels: Levels) -> np.ndarray:
    """Which rows (cutoffs exceeded, a column a rule) the levels reject."""
    out = np.zeros(len(steps), bool)
    for k, rule in enumerate(RULES):
        if levels[rule]:
            out |= steps[:, k] > len(RULES[rule][2]) - levels[rule]
    return out


def path(steps: np.ndarray, counts: np.ndarray, most: float) -> list[Levels]:
    """Stricter and stricter levels, each a step of one rule from those before, that reject `most` rows at most."""
    now, out = dict.fromkeys(RULES, 0), []
    while True:
        tries = [now | {rule: now[rule] + 1} for rule in RULES if now[rule] < len(RULES[rule][2])]
        lost = [(int(counts[_rejected(steps, x)].sum()), sum(x.values()) and max(x.values()), k) for k, x in enumerate(tries)]
        if not lost or min(lost)[0] > most:
            return out
        now = tries[min(lost)[2]]
        out.append(now)


def learn(stats: DataFrame, risk: float = RISK, delta: float = DELTA) -> dict[Stratum, Levels]:
    """The proved levels of each stratum; stats: those of good labelled rows.

    What reaches the driver is a count for each stratum, half and combination
    of cutoffs exceeded, whose number the grids bound.
    """
    rules = list(RULES)
    held = stats.where(~base_failed()).select("lang", F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("half"), *(_beyond(r).alias(r) for r in rules))
    counted = cut(held.groupBy("lang", "half", *rules).agg(F.count("*").alias("n")))
    sizes = counted.groupBy("lang").agg(F.sum("n").alias("size")).orderBy(F.desc("size"), "lang").limit(STRATA)
    strata = [r["lang"] for r in sizes.collect()]
    named = [x for x in strata if x is not None]
    own = F.coalesce(F.col("lang").isin(named), F.lit(None in strata))
    rows = counted.groupBy(F.when(own, F.col("lang")).alias("lang"), own.alias("own"), "half", *rules).agg(F.sum("n").alias("n")).collect()
    grouped: dict[Stratum, list] = {}
    for r in rows:
        grouped.setdefault(r["lang"] if r["own"] else POOLED, []).append([r["half"], r["n"], *(r[x] for x in rules)])
    chosen = {}
    for stratum, found in grouped.items():
        table_ = np.array(found, np.int64)
        first, second = table_[table_[:, 0] == 0], table_[table_[:, 0] == 1]
        chosen[stratum] = dict.fromkeys(RULES, 0)
        n = int(second[:, 1].sum())
        for levels in path(first[:, 2:], first[:, 1], AIM * risk * first[:, 1].sum()) if n else []:
            if upper_bound(int(second[_rejected(second[:, 2:], levels), 1].sum()), n, delta / len(grouped)) > risk:
                break
            chosen[stratum] = levels
    return chosen


def apply(stats: DataFrame, chosen: dict[Stratum, Levels]) -> DataFrame:
    """Add base_failed, rejected_by and kept."""
    hits = []
    for rule in RULES:
        limits = {lang: len(RULES[rule][2]) + 1 - x[rule] for lang, x in chosen.items() if x[rule]}
        if limits:
            limit = F.lit(limits.get(POOLED)).cast("int")
            for lang in sorted((x for x in chosen if x != POOLED), key=str):
                limit = F.when(F.col("lang").eqNullSafe(F.lit(lang)), F.lit(limits.get(lang)).cast("int")).otherwise(limit)
            hits.append(F.when(_beyond(rule) >= limit, F.lit(rule)))
    by = F.concat_ws(",", *hits) if hits else F.lit("")
    out = stats.withColumn("base_failed", base_failed()).withColumn("rejected_by", by)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rejected_by") == ""))


def quality_rules(documents: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """doc_id, statistics, base_failed, rejected_by, kept for each document."""
    return apply(document_statistics(documents), learn(labelled_statistics(documents, labels), risk, delta))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by")
