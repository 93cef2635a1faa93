"""p6 against an independent implementation, round trips, and odd texts."""

import os
import random

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import tokens

PATH = f"{tokens.VOCABULARIES}/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary files")


@pytest.fixture(scope="module")
def pair():
    import tiktoken

    t = tokens.transducer(PATH)
    return t, tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=t.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_equals_other_encoder_and_round_trip(pair, text):
    t, other = pair
    ids = t.encode(text)
    assert ids == other.encode_ordinary(text)
    assert tokens.decode(ids, t.bytes_of) == text


@pytest.mark.parametrize("text", ["", " ", "\n\n  x", "<|endoftext|>", "a" * 5000, "ab" * 30000, "12345" * 999, "é" * 700, "😀" * 300, "it's we're I'LL", "​ ​"])
def test_odd_and_long_texts(pair, text):
    t, other = pair
    assert t.encode(text) == other.encode_ordinary(text)


def test_random_long_word(pair):
    t, other = pair
    text = "".join(random.Random(5).choice("abcdefghijklmnop") for _ in range(20000))
    assert t.encode(text) == other.encode_ordinary(text)


def test_small_vocabulary_by_merging():
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"cd": 259, b"abcd": 260, b"dd": 261}
    t = tokens.Transducer(ranks, r"\S+|\s+")
    r = random.Random(1)
    for _ in range(500):
        s = "".join(r.choice("abcd") for _ in range(r.randint(1, 12)))
        assert t.piece(s.encode()) == t.merge(s.encode())


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40), st.integers(1, 5))
def test_utf8_machine(data, step):
    s = tokens.Utf8Stream()
    got = "".join(s.feed(data[i : i + step]) for i in range(0, len(data), step)) + s.end()
    assert got == data.decode("utf-8", "replace")


def test_query_on_nulls_and_repeats(spark, pair):
    t, _ = pair
    df = spark.createDataFrame([(1, "hello world", "x"), (2, None, "x"), (3, "", "x"), (1, "hello world", "x"), (None, "z", "x")], "doc_id long, text string, key string")
    got = sorted(((r["doc_id"], r["ids"]) for r in tokens.encode_column(df, "doc_id", "text").collect()), key=str)
    assert got == sorted([(1, t.encode("hello world")), (1, t.encode("hello world")), (2, []), (3, []), (None, t.encode("z"))], key=str)
    assert tokens.encode_column(df.limit(0), "doc_id", "text").count() == 0


def test_memo_and_table_are_bounded(pair, monkeypatch):
    monkeypatch.setattr(tokens, "MEMO", 50)
    monkeypatch.setattr(tokens, "TRANSITIONS", 200)
    t = tokens.Transducer(pair[0].ranks)
    r = random.Random(2)
    text = " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(800))
    assert t.encode(text) == pair[1].encode_ordinary(text)
    assert len(t.memo) <= 51 and len(t.table) <= 200 + 64
    assert regex.compile(tokens.PATTERN)
