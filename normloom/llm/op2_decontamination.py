"""Benchmark decontamination by winnowing, in DataFrame expressions alone.

Words of a text are hashed, hashes of `GRAM` consecutive words are its k-grams,
and of every `SPAN` consecutive k-grams the least is kept as a fingerprint.
Documents and benchmark items are fingerprinted alike, so any shared run of
`GRAM` + `SPAN` - 1 = 13 words shares a fingerprint.  Items of fewer than 13
words are one window each; their fingerprint is the hash of all their words,
and documents have as further fingerprints the hashes of their runs of just
those lengths, so a common word costs nothing unless it is an item by itself.

A first pass joins fingerprints, nothing else, and names the documents with a
hit.  Only their words are read again: fingerprints that join are extended to
every 13-word window over them, and windows are joined with the benchmark's
word for word, so hash collisions do not matter.

The benchmark side of a join is broadcast when its counted rows are within the
bound; otherwise it is repeated for each of `SALTS` parts of the documents and
both sides are shuffled, so a passage that a third of them has is split.
Windows meet their items by way of distinct item lists, so a passage that many
items share is not multiplied by them.

Edge cases: a null or empty text has no words, is not contaminated and has the
digest of the empty string; an item without words has no window; repeated
items each count by their id, every row of documents is judged by its own text,
also where rows share a doc_id or have none; texts of any length are whole;
other columns are ignored; with an empty benchmark nothing is hit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from normloom.llm.common import cut, table

#: Words of a window, and the contamination rule (fixed values of the contract).
WINDOW = 13
SHARE = 20
#: Words of a k-gram and k-grams of which one is kept; together they span WINDOW words.
GRAM, SPAN = 6, 8
#: What names a row of documents.
KEY = ["doc_id", "own"]
#: Parts of the documents for each of which a benchmark too large to broadcast is repeated.
SALTS = 16
#: Rows of the benchmark's side, and ids of hit documents, that are broadcast at most.
TOLD = 500_000
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: str) -> Column:
    """Words of a text column, A-Z lower-cased; null has none."""
    low = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def rows_of(documents: DataFrame) -> DataFrame:
    """doc_id, text and own: with doc_id the key of a row, whatever ids repeat."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("own", F.xxhash64("text"))


def _with_neighbour(values: Column, shift: int, pick: Callable[..., Column]) -> Callable[[Column, Column], Column]:
    return lambda x, i: pick(x, F.get(values, i + shift))


def _doubled(values: str, size: int, least: bool, out: str) -> list[tuple[str, Column]]:
    """Steps that turn an array into the least (greatest) of each `size` (a power of 2) in a row.

    Sliding minima start at their own index; sliding maxima end at it.
    """
    steps, reach, source = [], 1, values
    while reach < size:
        name = f"{out}{reach}"
        pick = F.least if least else F.greatest
        shift = reach if least else -reach
        before = F.col(source)
        steps.append((name, F.transform(before, _with_neighbour(before, shift, pick))))
        source, reach = name, reach * 2
    return steps


def _grams(h: Column, n: Column | int) -> Column:
    """Hashes of the runs of n words that start at each word; h: hashes of the words, n at most their number."""
    return F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(F.lit(n), *(F.get(h, i + j) for j in range(n))))


def _minima(worded: DataFrame) -> DataFrame:
    """worded (with words and their hashes h) with its k-grams g and the minima of SPAN of them, m."""
    # k-grams from hashes of two words, each read three times
    pairs = F.transform("h", lambda x, i: F.xxhash64(x, F.get("h", i + 1)))
    whole = F.slice("two", 1, F.greatest(F.size("two") - GRAM + 1, F.lit(0)))
    grams = F.transform(whole, lambda x, i: F.xxhash64(x, F.get("two", i + 2), F.get("two", i + 4)))
    df, last = worded.withColumn("two", pairs).withColumn("g", grams).drop("two"), "g"
    for name, step in _doubled("g", SPAN, True, "low"):
        df = df.withColumn(name, step)
        last = name
    # a minimum over fewer than SPAN k-grams, at the end, is of no window
    return df.withColumn("m", F.slice(last, 1, F.greatest(F.size("g") - SPAN + 1, F.lit(0))))


def hashed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))


def prints_of(rows: DataFrame, key: list[str], lengths: list[int]) -> DataFrame:
    """(key, print): the distinct fingerprints of each row's words, and of its runs of the given lengths.

    Generators are outer ones here: from others, Spark infers a filter on the
    array and computes that a second time, words and all, below.
    """
    none = F.array().cast("array<bigint>")
    short = [F.when(F.size("h") >= n, _grams(F.col("h"), n)).otherwise(none) for n in lengths]
    found = _minima(hashed(rows)).select(*key, F.array_distinct(F.concat("m", *short)).alias("prints"))
    return found.select(*key, F.explode_outer("prints").alias("print")).where("print is not null")


def fingerprints(worded: DataFrame, key: list[str]) -> DataFrame:
    """(key, at, print, from_, around): kept k-grams with the words that windows over them can have.

    worded: key, words.  `around` starts at word `from_`.
    """
    df = _minima(hashed(worded))
    # k-gram i is kept if it is the minimum of a window that has it: one that starts at i - SPAN + 1 .. i
    df = df.select(*key, "words", "g", F.concat("m", F.array_repeat(F.try_element_at("m", F.lit(-1)), SPAN - 1)).alias("m"))
    last = "m"
    for name, step in _doubled("m", SPAN, False, "high"):
        df = df.withColumn(name, step)
        last = name
    top = F.col(last)
    marks = F.filter(F.transform("g", lambda x, i: F.when(x == F.get(top, i), i)), lambda i: i.isNotNull())
    g, w = F.col("g"), F.col("words")
    reach = WINDOW - GRAM
    rows = F.transform(marks, lambda i: F.struct(i.alias("at"), F.get(g, i).alias("print"), F.greatest(i - reach, F.lit(0)).alias("from_"), F.slice(w, F.greatest(i - reach, F.lit(0)) + 1, F.least(i, F.lit(reach)) + WINDOW).alias("around")))
    return df.select(*key, F.inline_outer(rows))


def windows_around(hits: DataFrame) -> DataFrame:
    """(doc_id, own, start, length, window): every window over a kept k-gram."""
    around, base, at = F.col("around"), F.col("from_"), F.col("at") - F.col("from_")
    starts = F.filter(F.sequence(at - (WINDOW - GRAM), at), lambda i: (i >= 0) & (i + WINDOW <= F.size(around)))
    rows = F.transform(starts, lambda i: F.struct((base + i).alias("start"), F.lit(WINDOW).alias("length"), F.array_join(F.slice(around, i + 1, WINDOW), " ").alias("window")))
    return hits.select(*KEY, F.inline_outer(rows)).where("window is not null").distinct()


def benchmark_windows(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Windows (window, length, items: number of the sorted list of item ids) and the items' words."""
    items = cut(benchmark.select(F.col("item_id").cast("string").alias("item"), words_of("text").alias("words")).where(F.size("words") > 0))
    count = F.greatest(F.size("words") - WINDOW + 1, F.lit(1))
    length = F.least(F.size("words"), F.lit(WINDOW))
    each = items.select("item", length.alias("length"), F.explode(F.transform(F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice("words", i, length), " "))).alias("window"))
    return cut(each.groupBy("window", "length").agg(F.array_sort(F.collect_set("item")).alias("items"))), items


def _met(rows: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    """Inner join with the benchmark's side, one row a key: by broadcast, or beyond the bound in salted parts."""
    if known.count() <= TOLD:
        return rows.join(F.broadcast(known), on)
    parts = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(*KEY), F.lit(SALTS)).cast("int")).join(parts, [*on, "salt"]).drop("salt")


def of_rows(rows: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """Rows joined with what was found for them, by id (null is an id too) and text."""
    there = found.withColumnsRenamed({c: f"{c}_" for c in KEY})
    told = F.broadcast(there) if found.count() <= TOLD else there
    return rows.join(told, F.col("doc_id").eqNullSafe(F.col("doc_id_")) & (F.col("own") == F.col("own_")), how)


def hit_windows(documents: DataFrame, windows: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, own, start, length, items) of each occurrence of a benchmark window; documents: doc_id, own, text."""
    lengths = sorted(r["n"] for r in items.where(F.size("words") < WINDOW).select(F.size("words").alias("n")).distinct().collect())  # 12 at most
    whole = hashed(items.where(F.size("words") < WINDOW)).select(F.coalesce(*(F.when(F.size("h") == n, F.get(_grams(F.col("h"), n), 0)) for n in lengths or [1])).alias("print"))
    prints = cut(prints_of(items, ["item"], []).select("print").unionByName(whole).distinct())
    worded = documents.select(*KEY, words_of("text").alias("words"))
    hit = cut(_met(prints_of(worded, KEY, lengths), prints, ["print"]).select(*KEY).distinct())
    again = of_rows(documents, hit, "left_semi").select(*KEY, words_of("text").alias("words"))
    long_ = windows_around(_met(fingerprints(again, KEY), prints, ["print"]))
    for n in lengths:
        starts = F.transform(F.sequence(F.lit(0), F.size("words") - n), lambda i: F.struct(i.alias("start"), F.lit(n).alias("length"), F.array_join(F.slice("words", i + 1, n), " ").alias("window")))  # noqa: B023
        starts = F.when(F.size("words") >= n, starts)
        long_ = long_.unionByName(again.select(*KEY, F.inline_outer(starts)).where("window is not null"))
    return _met(long_, windows, ["window", "length"]).select(*KEY, "start", "length", "items").distinct()


def covered(spans: Column) -> Column:
    """Words inside the union of (start, length) spans sorted by start."""
    zero = F.struct(F.lit(0).alias("reach"), F.lit(0).alias("n"))
    return F.aggregate(spans, zero, lambda a, s: F.struct(F.greatest(a["reach"], s["start"] + s["length"]).alias("reach"), (a["n"] + F.greatest(s["start"] + s["length"] - F.greatest(a["reach"], s["start"]), F.lit(0))).alias("n")))["n"]


def decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, own (xxhash64 of the text), n_words, n_hit, n_items, items (sorted ids, comma-joined), contaminated of each document."""
    windows, items = benchmark_windows(benchmark)
    rows = rows_of(documents)
    hits = cut(hit_windows(rows, windows, items))
    spans = hits.groupBy(*KEY).agg(F.array_sort(F.collect_set(F.struct("start", "length"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    sums = cut(spans.select(*KEY, covered(F.col("spans")).cast("long").alias("n_hit"), "items"))
    out = of_rows(rows.select(*KEY, F.size(words_of("text")).cast("long").alias("n_words")), sums, "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        "doc_id",
        "own",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce(F.array_join("items", ","), F.lit("")).alias("items"),
        ((n_hit > 0) & (SHARE * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.col("items").cast("binary"), 256).alias("items_sha256"), "contaminated")
