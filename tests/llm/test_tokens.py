import random

import pytest
from tokenizers import Tokenizer

from memspark.llm.tokens import VOCABULARY, Bpe, counted, encoded

CASES = [
    "", " ", "  ", "\n", " \n ", "a", "I'll've been", "x 's", "\n's", "''s", "'re'", " '", "a'", "don't  stop \n\n now ", "tabs\t\tand\r\nlines ", "３半½²Ⅷ",
    "你好，世界！", "naïve café ﬁ", "👩‍💻🙂", "​﻿x  y　z", "\x1c\x1d\x85", "<|endoftext|> is text", "=" * 300, "a" * 5000, "═" * 3000, "q9" * 4000, "𝒙é́",
]


@pytest.fixture(scope="module")
def bpe():
    with open(VOCABULARY, "rb") as f:
        return Bpe(f.read())


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def lists(bpe, texts):
    ids, begin = bpe.encode(texts)
    return [ids[a:b].tolist() for a, b in zip(begin[:-1], begin[1:], strict=True)]


def test_against_the_library(bpe, library):
    assert lists(bpe, CASES) == library(CASES)
    r = random.Random(5)
    letters = "ab'sretlvmd  \n\t　\r.!?-0９½語éΩ😀’<|>"
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(25))) for _ in range(3000)]
    assert lists(bpe, texts) == library(texts)
    assert bpe.count(texts).tolist() == list(map(len, library(texts)))


def test_round_trip(bpe):
    assert [bpe.decode(i) for i in lists(bpe, CASES)] == CASES


def test_forgetting_changes_nothing(bpe, monkeypatch, library):
    monkeypatch.setattr("memspark.llm.tokens.MOST_CACHED", 2)
    for t in (["one two three four"], ["two four five"], ["one"]):
        assert lists(bpe, t) == library(t)


def test_columns_nulls_and_offsets(spark, library):
    rows = [(i, t, "ids", "x") for i, t in enumerate(CASES)] + [(99, None, "y", "z"), (None, "hello there", "y", "z"), (1, " ", "y", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens string")
    got = encoded(df, ["doc_id"], "text", offsets=True).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t in enumerate(CASES):
        assert by[i].ids == library([t])[0]
        assert (by[i].ends or [0])[-1] == len(t.encode())
    assert by[99].ids == [] and by[None].ids == library(["hello there"])[0]
    assert {r.doc_id: r.n_tokens for r in counted(df, ["doc_id"], "text").collect()} == {d: len(r.ids) for d, r in by.items()}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert encoded(df, ["doc_id"], "text").count() == 0
    assert encoded(df, ["doc_id"], "text").dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
