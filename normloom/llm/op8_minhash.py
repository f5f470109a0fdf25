"""Near-duplicate classes by MinHash, banding, verification and components.

1. Each text becomes its set of hashed five-word shingles and `BANDS` x `ROWS`
   minima of universal hash functions.  Rows with equal sets are one class.
2. Classes that share a band form buckets.  Every member is tied to the bucket's
   smallest; components of these ties (large-star, small-star) are clusters, so
   any two classes of a bucket are in one cluster.
3. Two classes are linked if they share a band and their full sets are similar
   enough, whatever the size of their cluster or bucket.  A cluster within
   `UNIT` classes and `WEIGHT` shingles is one unit of work, read by one task;
   of a larger one each distinct bucket is.  A bucket beyond these bounds is
   dealt into blocks twice, by two hashes, which links nearly all of it at a
   cost in proportion to it; members that are still apart from the bucket's
   largest class (strays) are then compared with every block of it.  A unit's
   sets are joined exactly (size and rare-first prefix filters, a shared band,
   the intersection), pairs that are linked already are skipped, and only the
   edges of a spanning forest come out.
4. Components of the confirmed edges are the result.

Two sets of similarity 0.85 share a band with a chance of 1 - 4e-8.

Edge cases: a null text, or one without words, has an empty set, is linked with
nothing and is its own component; fewer than five words are one shingle; every
row is judged by its own text, also where rows share a doc_id, and has as
component_id the smallest id of the rows that it is linked with; a row without
id is linked with nothing and kept; texts of any length are whole; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from normloom.llm import textvec as V
from normloom.llm.common import cut, map_text, skew_join, small, table
from normloom.llm.components import components

#: Similarity of a link, in hundredths (a fixed value of the contract).
PERCENT = 85
SHINGLE = 5
BANDS, ROWS = 36, 6
#: Classes and shingles that a unit of work holds at most (one longer text has a unit with as little else as can be).
UNIT, WEIGHT = 2000, 4_000_000
#: Rows of (unit, class, bands) that are broadcast at most, about 200 bytes each.
TOLD = 200_000

_rng = np.random.default_rng(8)
_A = _rng.integers(0, 2**31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minima of the universal hashes over a non-empty set."""
    x = (shingles >> V.U64(32)).astype(np.uint32)
    out = None
    for at in range(0, len(x), 1024):
        low = (_A[:, None] * x[None, at : at + 1024] + _B[:, None]).min(axis=1)
        out = low if out is None else np.minimum(out, low)
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    keys = np.zeros((len(signatures), BANDS), V.U64) + np.arange(1, BANDS + 1, dtype=V.U64)
    for r in range(ROWS):
        keys = V.mix(keys * V.U64(0x9E3779B97F4A7C15) ^ signatures[:, r::ROWS].astype(V.U64))
    return keys.view(np.int64)


def sketches(documents: DataFrame) -> DataFrame:
    """doc_id, own, n_shingles, a digest of the set and its band keys (both null if it is empty or has no id)."""
    from hashlib import md5

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, offsets = V.text_buffers(batch.column("text"))
        for i, j in V.pieces(offsets):
            rows = batch.slice(i, j - i)
            sets = V.shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], SHINGLE)
            full = [k for k, (s, x) in enumerate(zip(sets, rows.column("doc_id").to_pylist())) if len(s) and x is not None]
            bands: list = [None] * len(sets)
            digests: list = [None] * len(sets)
            if full:
                for k, keys in zip(full, band_keys(np.stack([signature(sets[k]) for k in full]))):
                    bands[k], digests[k] = keys, md5(sets[k].tobytes()).digest()
            arrays = [rows.column("doc_id"), rows.column("own"), pa.array(map(len, sets), pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "own", "n_shingles", "digest", "bands"])

    return map_text(documents, work, "doc_id long, own long, n_shingles long, digest binary, bands array<long>")


class Forest:
    """Labels of merged members."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: int, b: int) -> bool:
        x, y = self.label[a], self.label[b]
        if x != y:
            self.label[self.label == y] = x
        return bool(x != y)


def links(sets: list[np.ndarray], bands: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Edges of a spanning forest: non-empty sets that share a band and are similar; bands: a row for each set."""
    order = sorted(range(len(sets)), key=lambda k: len(sets[k]))
    sets, bands = [sets[k] for k in order], bands[order]
    sizes = np.array([len(s) for s in sets])
    _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))  # rare first
    token = rank[token]
    at = np.concatenate([[0], np.cumsum(sizes)])
    shared = np.sort(count) > 1
    # tokens of which two sets this similar must share one: the rarest |s| - ceil(t |s|) + 1
    prefix = sizes - (-(-percent * sizes // 100)) + 1
    owners, keys = [], []
    for k in range(len(sets)):
        own = np.sort(token[at[k] : at[k + 1]])
        token[at[k] : at[k + 1]] = own
        head = own[: prefix[k]]
        head = head[shared[head]]
        owners.append(np.full(len(head), k))
        keys.append(head)
    owner, key = np.concatenate(owners), np.concatenate(keys)
    by = np.argsort(key, kind="stable")
    owner, key = owner[by], key[by]
    forest, flag, out = Forest(len(sets)), np.zeros(len(count), bool), []
    for k in range(len(sets) - 1):
        head = keys[k]
        if not len(head):
            continue
        low, high = np.searchsorted(key, head), np.searchsorted(key, head, "right")
        near = np.unique(owner[V.ranges(low, high - low)])
        near = near[(near > k) & (forest.label[near] != forest.label[k]) & (100 * sizes[k] >= percent * sizes[near])]
        near = near[(bands[near] == bands[k]).any(axis=1)]
        if not len(near):
            continue
        flag[token[at[k] : at[k + 1]]] = True
        inside = np.concatenate([[0], np.cumsum(flag[token[V.ranges(at[near], sizes[near])]])])
        ends = np.cumsum(sizes[near])
        both = inside[ends] - inside[ends - sizes[near]]
        flag[token[at[k] : at[k + 1]]] = False
        for other in near[100 * both >= percent * (sizes[k] + sizes[near] - both)].tolist():
            if forest.join(k, other):
                out.append((order[k], order[other]))
    return out


def confirmed(units: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Edges (u, v) between classes of one unit; units: unit, member, bands, text."""

    def edges(ids: list[int], sets: list[np.ndarray], bands: list[np.ndarray]) -> pa.RecordBatch:
        pairs = links(sets, np.concatenate(bands), percent)
        return pa.RecordBatch.from_arrays([pa.array([ids[p[k]] for p in pairs], pa.int64()) for k in (0, 1)], names=["u", "v"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, ids, sets, bands = None, [], [], []
        for batch in batches:  # sorted by unit; what stays of a text is its set
            names, members = (batch.column(c).to_pylist() for c in ("unit", "member"))
            keys = batch.column("bands").flatten().to_numpy().reshape(-1, BANDS)
            data, offsets = V.text_buffers(batch.column("text"))
            own = [s for i, j in V.pieces(offsets) for s in V.shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], SHINGLE)]
            starts = [k for k in range(len(names)) if k == 0 or names[k] != names[k - 1]]
            for a, b in zip(starts, [*starts[1:], len(names)]):
                if names[a] != current:
                    if len(ids) > 1:
                        yield edges(ids, sets, bands)
                    current, ids, sets, bands = names[a], [], [], []
                ids += members[a:b]
                sets += own[a:b]
                bands.append(keys[a:b])
        if len(ids) > 1:
            yield edges(ids, sets, bands)

    return units.select("unit", "member", "bands", "text").repartition("unit").sortWithinPartitions("unit").mapInArrow(work, "u long, v long")


def _blocks(size: Column, weight: Column, unit: int) -> Column:
    """Blocks of which any two are within the bounds of a unit; 1 for what is within them as a whole."""
    halves = F.greatest(F.ceil(size / max(1, unit // 2)), F.ceil(weight / (WEIGHT // 2)))
    return F.when((size <= unit) & (weight <= WEIGHT), 1).otherwise(F.greatest(halves, F.lit(2))).cast("int")


def _dealt(salt: int, blocks: Column) -> Column:
    return F.pmod(F.xxhash64("key", "member", F.lit(salt)), blocks)


def whole_units(placed: DataFrame, unit: int) -> DataFrame:
    """(unit, member) of the clusters within the bounds; placed: member, n_shingles, component."""
    sizes = cut(placed.groupBy("component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("weight")))
    fits = sizes.where(_blocks(F.col("n"), F.col("weight"), unit) == 1).select("component")
    return placed.join(small(fits), "component").select(F.concat(F.lit("c"), F.col("component").cast("string")).alias("unit"), "member")


def bucket_members(placed: DataFrame, whole: DataFrame, buckets: DataFrame, unit: int) -> DataFrame:
    """(key, member, blocks) of the distinct buckets of the other clusters."""
    large = cut(buckets.select("key", "member").join(placed.select("member", "n_shingles").join(whole.select("member"), "member", "left_anti"), "member"))
    seal = [F.count("*").alias("size"), F.sum("n_shingles").alias("weight"), F.min("member").alias("low"), F.max("member").alias("high"), F.bit_xor(F.xxhash64("member")).alias("x1"), F.bit_xor(F.xxhash64("member", F.lit(1))).alias("x2")]
    alike = large.groupBy("key").agg(*seal).groupBy("size", "weight", "low", "high", "x1", "x2").agg(F.min("key").alias("key"))
    return cut(skew_join(large, cut(alike.select("key", _blocks(F.col("size"), F.col("weight"), unit).alias("blocks"), F.col("size").alias("n"))), ["key"]).select("key", "member", "blocks"))


def dealt_units(members: DataFrame) -> DataFrame:
    """(unit, member): buckets of one block, and each block of the others by two hashes."""
    name = lambda salt: F.concat_ws("b", F.lit("k"), F.col("key"), F.lit(salt), _dealt(salt, F.col("blocks")))
    names = F.when(F.col("blocks") == 1, F.array(F.concat(F.lit("k"), F.col("key").cast("string")))).otherwise(F.array(name(1), name(2)))
    return members.select(F.explode(names).alias("unit"), "member")


def stray_units(members: DataFrame, edges: DataFrame, unit: int) -> DataFrame:
    """(unit, member): of each bucket of several blocks, what is apart from its largest class, with each of its blocks."""
    found = components(edges)
    wide = members.where("blocks > 1")
    labelled = cut(wide.join(small(found.withColumnRenamed("node", "member")), "member", "left").select("key", "member", "blocks", F.coalesce("component", "member").alias("label")))
    tops = labelled.groupBy("key", "label").agg(F.count("*").alias("m")).groupBy("key").agg(F.max_by("label", F.struct("m", "label")).alias("top"), F.sum("m").alias("n"), F.max("m").alias("most"))
    # the bucket's strays go in blocks too, one for each half unit of them
    split = tops.where("most < n").withColumn("parts", F.ceil((F.col("n") - F.col("most")) / max(1, unit // 2)).cast("int")).select("key", "top", "n", "parts")
    open_ = cut(skew_join(labelled, cut(split), ["key"]))
    name = lambda a, b: F.concat_ws("b", F.lit("s"), F.col("key"), a, b)
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    strays = open_.where("label <> top").withColumn("other", each(F.col("blocks"))).select(name(_dealt(3, F.col("parts")), F.col("other")).alias("unit"), "member")
    rest = open_.withColumn("other", each(F.col("parts"))).select(name(F.col("other"), _dealt(4, F.col("blocks"))).alias("unit"), "member")
    return strays.unionByName(rest).distinct()


def near_duplicates(documents: DataFrame, percent: int = PERCENT, unit: int = UNIT) -> DataFrame:
    """doc_id, own (xxhash64 of the text), n_shingles, component_id and kept of each document."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("own", F.xxhash64("text"))
    sketched = cut(sketches(texts))
    grouped = sketched.where("digest is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "own")).alias("rep"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
    classes = cut(grouped.withColumn("member", F.monotonically_increasing_id()))  # written, so that the numbers stay
    banded = classes.select("member", F.explode("bands").alias("key"))
    hubs = cut(banded.groupBy("key").agg(F.min("member").alias("hub"), F.count("*").alias("n")).where("n > 1"))
    buckets = cut(skew_join(banded, hubs, ["key"]))
    clusters = components(buckets.where("member <> hub").select(F.col("member").alias("u"), F.col("hub").alias("v")).distinct())
    nodes = clusters.select(F.col("node").alias("member"), "component").unionByName(clusters.select(F.col("component").alias("member"), "component").distinct())
    placed = cut(nodes.join(classes.select("member", "n_shingles"), "member"))
    repeats = sketched.where("digest is not null").groupBy("doc_id", "own").count().where("count > 1").head(1)

    def verified(units: DataFrame) -> DataFrame:
        packed = F.transform("bands", lambda x: F.shiftrightunsigned(x, 33).cast("int"))  # enough to tell bands apart
        wanted = classes.select("member", "rep.doc_id", "rep.own", packed.alias("bands")).join(units, "member")
        rows = texts.where(F.col("text").isNotNull()).join(small(cut(wanted), most=TOLD), ["doc_id", "own"])
        return cut(confirmed(rows.dropDuplicates(["unit", "member"]) if repeats else rows, percent))

    whole = cut(whole_units(placed, unit))
    edges = verified(whole)
    if placed.count() > whole.count():
        members = bucket_members(placed, whole, buckets, unit)
        dealt = verified(dealt_units(members))
        strays = cut(stray_units(members, dealt, unit))
        edges = edges.unionByName(dealt).unionByName(verified(strays) if strays.head(1) else dealt.limit(0))
    found = components(edges)
    linked = found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
    joined = classes.join(small(linked), F.col("member") == F.col("node"), "left").where("component is not null or copies > 1")
    joined = cut(joined.select("digest", F.coalesce("component", "member").alias("component"), F.col("rep.doc_id").alias("doc_id")))
    least = cut(joined.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n")))
    named = cut(skew_join(joined, least, ["component"]).select(F.col("digest").alias("own_digest"), "component_id"))
    out = sketched.select("doc_id", "own", "n_shingles", "digest").join(small(named), F.col("digest") == F.col("own_digest"), "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "own", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("own")
