"""Token ids against the vocabulary's reference encoder."""

import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillgraph.llm.tokens import PATTERN, VOCABULARY, Encoder, RankQueue, encode_corpus, load_ranks, token_counts

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary here")


@pytest.fixture(scope="module")
def encoders():
    import tiktoken

    tokens = load_ranks()
    reference = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    return Encoder(tokens), reference


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(encoders, text):
    mine, reference = encoders
    text = text.encode("utf-8", "ignore").decode()
    assert mine.encode(text) == reference.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 5000, " " * 3000, "中" * 2000, "aXb" * 2000, "ab" * 4000, "<|endoftext|> x", "​\xad﻿", "é é ﬁ"])
def test_long_and_odd(encoders, text):
    mine, reference = encoders
    assert mine.encode(text) == reference.encode_ordinary(text)


def test_rank_queue_orders():
    q = RankQueue(50_000)
    for rank, at in ((40_000, 3), (70, 9), (70, 2), (0, 5), (40_000, 1)):
        q.push(rank, at)
    assert [q.pop() for _ in range(6)] == [(0, 5), (70, 2), (70, 9), (40_000, 1), (40_000, 3), None]


def test_frame(spark):
    df = spark.createDataFrame([(1, "hello world", "x"), (2, "", "x"), (3, None, "x"), (4, " \n", "x"), (1, "hello world", "x"), (None, "a", "x")], "doc_id bigint, text string, ids string")
    got = [(r.doc_id, r.ids) for r in encode_corpus(df, "doc_id", "text").collect()]
    assert len(got) == 6
    assert dict(got)[2] == [] and dict(got)[3] == [] and dict(got)[4]
    assert dict(got)[1] == [31373, 995]
    assert encode_corpus(df.limit(0), "doc_id", "text").count() == 0
    assert [r.n_tokens for r in token_counts(df, "text").collect()] == [2, 0, 0, 2, 2, 1]
