import hashlib
import random
import struct

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from shapewright.llm import bpe

RANKS = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
CODEC = bpe.Codec(RANKS, P.PATTERN)
TRUE = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def ids_of(packed: bytes) -> list[int]:
    return list(struct.unpack(f"<{len(packed) // 4}I", packed))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=80))
def test_ids_are_those_of_the_library_and_come_back(text):
    ids = CODEC.encode(text)
    assert ids_of(ids) == TRUE.encode_ordinary(text)
    assert CODEC.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["a" * 30_000, "ab" * 10_000, " " * 9_999, "é" * 5_000, "".join(random.Random(1).choices("abc", k=20_000))])
def test_one_long_match(text):
    assert ids_of(CODEC.encode(text)) == TRUE.encode_ordinary(text)


def test_a_vocabulary_with_ties_takes_the_leftmost():
    ranks = {bytes([b]): b for b in range(256)} | {b"aa": 256, b"aaa": 257, b"aaaa": 258}
    codec, true = bpe.Codec(ranks, r"\S+"), tiktoken.Encoding("t", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    for n in range(1, 40):
        assert ids_of(codec.encode("a" * n)) == true.encode_ordinary("a" * n)


def test_a_text_beyond_the_list_limit(monkeypatch):
    monkeypatch.setattr(bpe, "LONG", 10)
    text = "words and more words, 123 and don't " * 50
    assert ids_of(CODEC.encode(text)) == TRUE.encode_ordinary(text)


def test_the_kept_table_turns_over(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 3)
    codec = bpe.Codec(RANKS, P.PATTERN)
    text = " ".join(f"zq{i % 7}x" for i in range(60))
    assert ids_of(codec.encode(text)) == TRUE.encode_ordinary(text) and len(codec) <= 3


def test_query_over_nulls_empty_long_and_clashing_columns(spark):
    texts = [None, "", "hello world", "hello world", "<|endoftext|>", "x" * 100_000, "tab\tand\n\n  é 漢字"]
    docs = spark.createDataFrame([(i, t, "own", None) for i, t in enumerate(texts)], "doc_id long, text string, ids string, extra string")
    got = {r.doc_id: r for r in bpe.digests(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = TRUE.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_encode_then_decode_as_tables(spark):
    path = P.path("byte_bpe_50k.tiktoken")
    docs = spark.createDataFrame([("ab cd",), (None,)], "body string")
    out = bpe.decode(bpe.encode(docs, path, P.PATTERN, "body"), path, P.PATTERN).collect()
    assert [r.decoded for r in out] == [b"ab cd", b""]
    assert bpe.digests(spark.createDataFrame([], "doc_id long, text string")).collect() == []
