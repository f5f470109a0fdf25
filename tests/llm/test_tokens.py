"""op1 against a tokenizer library's unigram lattice, op7 against tiktoken."""

import base64

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models

from normloom.llm import op1_token_counts as op1
from normloom.llm import op7_byte_bpe as op7
from normloom.llm import textvec as V

from .texts import TEXTS, documents, sha

MODEL = op1.unigram(op1.default_path())
VOCAB = op7.vocabulary(op7.default_path())
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
TIKTOKEN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
UNIGRAM = Tokenizer(models.Unigram([("<unk>", 0.0), *((p, float(s)) for p, s in MODEL.scores.items())], 0, False))
ODD = st.text(alphabet=st.sampled_from(list("ab '\n\t sdmtrevl19²Ⅷ!-_é漢😀▁\x85\xa0 İß")), max_size=60)


def unigram_count(text):
    if not text:
        return 0
    marked = "▁" + text.replace(" ", "▁")
    e = UNIGRAM.encode(marked, add_special_tokens=False)
    return sum(1 if i else len(marked[a:b].encode()) for i, (a, b) in zip(e.ids, e.offsets))


@settings(max_examples=150, deadline=None)
@given(st.lists(ODD, max_size=8))
def test_counts_equal_the_library(texts):
    data, offsets = V.text_buffers(pa.array(texts, pa.string()))
    assert MODEL.counts(data, offsets).tolist() == [unigram_count(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(ODD, max_size=8))
def test_ids_equal_tiktoken_and_decode(texts):
    data, offsets = V.text_buffers(pa.array(texts, pa.string()))
    ids, bounds = VOCAB.encode(data, offsets)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [TIKTOKEN.encode_ordinary(t) for t in texts]
    assert VOCAB.decode(ids)[0].tobytes() == "".join(texts).encode()


def thue_morse(n, pair="ab"):
    """Two texts of 2**n letters, each the other's complement: sums of powers of an odd base cannot tell them apart."""
    word = "a"
    for _ in range(n):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    return [x.translate(str.maketrans("ab", pair)) for x in (word, other)]


@pytest.mark.parametrize("n", [2, 3, 5, 10, 12])
def test_complementary_words_are_told_apart(n):
    texts = [f"{a} {b} {a}{b}" for a, b in (thue_morse(n), thue_morse(n, "éx"))]
    data, offsets = V.text_buffers(pa.array(texts))
    ids, bounds = VOCAB.encode(data, offsets)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [TIKTOKEN.encode_ordinary(t) for t in texts]
    assert MODEL.counts(data, offsets).tolist() == [unigram_count(t) for t in texts]


def test_complementary_windows_are_told_apart():
    """Words, lines, shingles and windows made of two words in Thue-Morse order all have hashes of their own."""
    a, b = thue_morse(10)
    for k in (5, 8, 26, 32, 50):
        data, offsets = V.text_buffers(pa.array([" ".join(a[p : p + k]) for p in range(900)] + [" ".join(b[p : p + k]) for p in range(900)]))
        starts, ends, bounds = V.word_spans(~V.SPACE[data], offsets)
        words = V.word_hashes(data, starts, ends)
        for second in (False, True):
            hashes = V.window_hashes(words, k, second)[bounds[:-1]]
            assert len(set(hashes.tolist())) == len({x for t in (a, b) for x in (t[p : p + k] for p in range(900))})


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=40), min_size=1, max_size=40))
def test_keys_are_equal_for_equal_bytes_only(pieces):
    data = np.frombuffer(b"".join(pieces), np.uint8)
    ends = np.cumsum([len(x) for x in pieces])
    keys = list(zip(*(k.tolist() for k in V.word_keys(data, ends - [len(x) for x in pieces], ends))))
    assert len(set(keys)) == len(set(pieces)) and len(set(zip(pieces, keys))) == len(set(pieces))


def test_repeated_and_null_ids(spark):
    rows = [(1, "a b"), (1, "a b"), (1, "c"), (None, "a b"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(((i, unigram_count(t)) for i, t in rows), key=str)
    assert sorted(map(tuple, op1.token_counts(docs).collect()), key=str) == want
    trips = sorted(((r.doc_id, r.decoded_sha256) for r in op7.round_trip(docs).collect()), key=str)
    assert trips == sorted(((i, sha((t or "").encode())) for i, t in rows), key=str)


def test_a_very_long_text(spark):
    text = " ".join(f"w{k * k % 99991}é" for k in range(300_000)) + "x" * 200_000
    docs = spark.createDataFrame([(1, text), (2, "")], "doc_id long, text string")
    r = op7.round_trip(docs).where("doc_id = 1").first()
    ids = TIKTOKEN.encode_ordinary(text)
    assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(text.encode()))
    assert op1.token_counts(docs).where("doc_id = 1").first().n_tokens == unigram_count(text)


def test_cache_may_be_emptied_at_any_time(monkeypatch):
    monkeypatch.setattr(op7, "CACHE_BITS", 17)
    small = op7.Vocabulary(op7.default_path())
    text = " ".join(f"word{k}x" for k in range(60_000))
    data, offsets = V.text_buffers(pa.array([text, "again " + text]))
    ids, bounds = small.encode(data, offsets)
    assert ids[: bounds[1]].tolist() == TIKTOKEN.encode_ordinary(text)


@pytest.mark.parametrize("texts", [TEXTS, [], [None]])
def test_queries_on_awkward_texts(spark, texts):
    docs = documents(spark, texts)
    counts = {r.doc_id: r.n_tokens for r in op1.token_counts(docs).collect()}
    trips = {r.doc_id: r for r in op7.round_trip(docs).collect()}
    assert len(counts) == len(trips) == len(texts)
    for i, t in enumerate(texts):
        ids = TIKTOKEN.encode_ordinary(t or "")
        got = trips[i * 7 + 3]
        assert counts[i * 7 + 3] == unigram_count(t)
        assert (got.n_tokens, got.ids_sha256, got.decoded_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha((t or "").encode()))


def test_encode_keeps_offsets_and_decode_inverts(spark):
    encoded = op7.encode(documents(spark))
    decoded = {r.doc_id: bytes(r.decoded) for r in op7.decode(encoded).collect()}
    for r in encoded.collect():
        assert len(r.ids) == len(r.token_ends)
        assert (r.token_ends[-1] if r.ids else 0) == len(decoded[r.doc_id])
    assert decoded == {i * 7 + 3: (t or "").encode() for i, t in enumerate(TEXTS)}
