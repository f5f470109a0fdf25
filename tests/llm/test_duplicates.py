"""op2, op8 and op10 against brute force on whole small corpora."""

import re
from collections import defaultdict

import numpy as np
import pytest

from normloom.llm import op2_decontamination as op2
from normloom.llm import op8_minhash as op8
from normloom.llm import op10_substring_dedup as op10
from normloom.llm.components import components

from .texts import LONG, PASSAGE, TEXTS, documents, lower, prose, sha, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(texts, items):
    windows = defaultdict(set)
    for item, text in items:
        w = WORD.findall(lower(text))
        if w:
            for p in range(max(1, len(w) - 12)):
                windows[tuple(w[p : p + 13])].add(str(item))
    out = {}
    for i, text in enumerate(texts):
        w = WORD.findall(lower(text))
        hit, found = set(), set()
        for p in range(len(w)):
            for n in range(1, 14):
                if items_of := windows.get(tuple(w[p : p + n])) if p + n <= len(w) else None:
                    found |= items_of
                    hit |= set(range(p, p + n))
        out[i * 7 + 3] = (len(w), len(hit), len(found), ",".join(sorted(found)), bool(hit) and 20 * len(hit) >= len(w))
    return out


ITEMS = [(1, PASSAGE), (2, None), (3, "..."), (10, "one two"), (11, " ".join(LONG.split()[500:530])), (12, PASSAGE), (13, "Four"), (14, prose(40)), (15, "the end of it")]


@pytest.mark.parametrize("texts", [TEXTS, [], [None, ""]])
@pytest.mark.parametrize("items", [ITEMS, [], [(5, "")], [(1, PASSAGE)]])
def test_decontamination(spark, texts, items):
    bench = spark.createDataFrame([(i, t, "clash", 0) for i, t in items], "item_id long, text string, words string, hit_id int")
    got = {r.doc_id: tuple(r)[1:] for r in op2.decontaminate(documents(spark, texts), bench).drop("own").collect()}
    assert got == contamination(texts, items)


def test_decontamination_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(op2, "TOLD", -1)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in op2.decontaminate(documents(spark), bench).drop("own").collect()}
    assert got == contamination(TEXTS, ITEMS)


def near_classes(texts):
    sets = []
    for t in texts:
        w = words(lower(t))
        sets.append({tuple(w[p : p + 5]) for p in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    label = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    return {i * 7 + 3: (len(s), label[i] * 7 + 3, label[i] == i) for i, s in enumerate(sets)}


@pytest.mark.parametrize("texts", [TEXTS, [], [None, "", " "]])
@pytest.mark.parametrize("unit", [2000, 4])
def test_near_duplicates(spark, texts, unit):
    got = {r.doc_id: tuple(r)[1:] for r in op8.near_duplicates(documents(spark, texts), unit=unit).drop("own").collect()}
    assert got == near_classes(texts)


def test_near_duplicates_repeated_rows(spark):
    docs = documents(spark)
    got = op8.near_duplicates(docs.unionByName(docs)).drop("own").collect()
    assert len(got) == 2 * len(TEXTS)
    assert {r.doc_id: tuple(r)[1:] for r in got} == near_classes(TEXTS)


def row_classes(rows):
    """Near classes of rows (doc_id, text), each by its own text: the smallest id of each row's class."""
    have = [(i, t) for i, t in rows if i is not None]
    found = near_classes([t for _, t in have])
    least = {}
    for k, (i, _) in enumerate(have):
        label = found[k * 7 + 3][1]
        least[label] = min(i, least.get(label, i))
    return sorted(((i, found[k * 7 + 3][0], least[found[k * 7 + 3][1]], i == least[found[k * 7 + 3][1]]) for k, (i, _) in enumerate(have)), key=str)


def test_rows_that_share_an_id(spark):
    a, b, c = prose(90), prose(90), prose(80)
    rows = [(1, a), (5, a), (5, b), (5, b), (2, b + " more"), (7, c), (7, None), (3, c), (None, a), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = op8.near_duplicates(docs).drop("own").collect()
    assert sorted((tuple(r) for r in got if r.doc_id is not None), key=str) == row_classes(rows)
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)] * 2
    cleaned = [tuple(r) for r in op10.substring_dedup(docs).collect()]
    assert sorted(cleaned, key=str) == sorted(row_removals(rows), key=str)
    bench = spark.createDataFrame([(1, a)], "item_id long, text string")
    hit = sorted((tuple(r)[:3] for r in op2.decontaminate(docs, bench).drop("own").collect()), key=str)
    assert hit == sorted(((i, len(WORD.findall(lower(t))), contamination([t], [(1, a)])[3][1]) for i, t in rows), key=str)


def row_removals(rows, window=50):
    """What op10 leaves of rows (doc_id, text): windows of rows with a smaller id go."""
    split, least = [words(t) for _, t in rows], {}
    for (i, _), w in zip(rows, split):
        for p in range(len(w) - window + 1):
            if i is not None:
                least[tuple(w[p : p + window])] = min(i, least.get(tuple(w[p : p + window]), i))
    out = []
    for (i, _), w in zip(rows, split):
        gone = {q for p in range(len(w) - window + 1) if i is not None and least[tuple(w[p : p + window])] < i for q in range(p, p + window)}
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return out


def test_recall_of_similar_pairs(spark):
    """Pairs at similarity 0.85 to 0.9, exact count, are all found."""
    rng = np.random.default_rng(4)
    texts, pairs = [], 0
    for k in range(60):
        w = [f"t{k}x{rng.integers(0, 10**6)}" for _ in range(200)]
        edited = [("new" if at % 60 == 30 else x) for at, x in enumerate(w)]  # 3 edits: 15 of 196 shingles each side
        texts += [" ".join(w), " ".join(edited)]
    want = near_classes(texts)
    pairs = sum(not x[2] for x in want.values())
    got = {r.doc_id: tuple(r)[1:] for r in op8.near_duplicates(documents(spark, texts)).drop("own").collect()}
    assert pairs == 60 and got == want


def test_a_bucket_of_several_blocks_is_linked_whole(spark):
    base = [f"word{k}" for k in range(120)]
    texts = [" ".join([*base[:at], f"edit{at}", *base[at + 1 :]]) for at in range(0, 120, 3)] + [" ".join(f"lone{k}x{j}" for j in range(60)) for k in range(5)]
    got = {r.doc_id: tuple(r)[1:] for r in op8.near_duplicates(documents(spark, texts), unit=6).drop("own").collect()}
    assert got == near_classes(texts)


def test_links_keep_the_classes_of_all_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**62, 60).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, 50, replace=False), rng.integers(0, 2**62, rng.integers(0, 9)).astype(np.uint64)])) for _ in range(60)]
    label = list(range(60))
    want = list(range(60))
    for a, b in op8.links(sets, np.zeros((60, op8.BANDS), np.uint32)):
        low, high = sorted((label[a], label[b]))
        label = [low if x == high else x for x in label]
    for a in range(60):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((want[a], want[b]))
                want = [low if x == high else x for x in want]
    assert label == want


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (8, 8), (7, 9), (None, 1), (5, 4), *((100 + k, 99 + k) for k in range(1, 40))]
    got = dict(components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {5: 1, 4: 1, 3: 1, 2: 1, 9: 7, 8: 7} | {100 + k: 100 for k in range(1, 40)}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def removals(texts, window=50):
    first, out = {}, {}
    split = [words(t) for t in texts]
    for i, w in enumerate(split):
        for p in range(len(w) - window + 1):
            first.setdefault(tuple(w[p : p + window]), i)
    for i, w in enumerate(split):
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < i:
                gone |= set(range(p, p + window))
        out[i * 7 + 3] = (len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone))
    return out


@pytest.mark.parametrize("texts", [TEXTS, [], [None, ""]])
def test_substring_dedup(spark, texts):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept.encode()) for r in op10.substring_dedup(documents(spark, texts)).collect()}
    assert got == removals(texts)


def test_a_full_sketch_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(op10, "CELL_BITS", 10)
    monkeypatch.setattr(op10.repeated_cells, "__defaults__", (op10.WINDOW, 10))
    got = {r.doc_id: r.kept_sha256 for r in op10.cleaned(op10.removals(documents(spark)), digest=True).collect()}
    assert got == {k: sha(v[2]) for k, v in removals(TEXTS).items()}


def test_cells_are_packed_and_unpacked():
    at = np.array([0, 1, 5, 200, 40_000, 3_999_999])
    n = np.array([1, 2, 1, 3, 1, 2])
    cells, counts = op10._unpack(op10._pack(at, n))
    assert cells.tolist() == at.tolist() and counts.tolist() == [1, 2, 1, 2, 1, 2]
