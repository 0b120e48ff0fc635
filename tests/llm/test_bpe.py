import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lettermill.llm import bpe, tokens

PATH = bpe.vocabulary_path()
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary here")


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("aeithn sr\n\té日🙂0159.,-!_'\"", max_size=80)))
def test_same_ids(reference, text):
    assert bpe.encoder(PATH).encode(text) == reference(text)


def test_long_words_and_special_names(reference):
    rng = random.Random(1)
    for text in ("<|endoftext|> x", "a" * 3000, " " * 500 + "x", "ab" * 1000, "日本語" * 200, "".join(rng.choice("abcdefgh") for _ in range(5000)), "'s'S 'll \x85 "):
        assert bpe.encoder(PATH).encode(text) == reference(text)


def test_corpus(spark, small, reference):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = {r.doc_id: list(r.ids) for r in tokens.encode_documents(docs).collect()}
    assert got == {r.doc_id: reference(r.text) if r.text else [] for r in docs.collect()}


def test_edges(spark):
    schema = "doc_id bigint, text string, ids int, tokens int"
    docs = spark.createDataFrame([(1, None, 1, 1), (2, "", 1, 1), (3, "x", 1, 1), (3, "x", 1, 1), (None, "y", 1, 1), (5, "long " * 300_000, 1, 1)], schema)
    got = tokens.encode_documents(docs).collect()
    assert sorted((r.doc_id or 0, len(r.ids)) for r in got) == [(0, 1), (1, 0), (2, 0), (3, 1), (3, 1), (5, 300_001)]
    assert tokens.encode_documents(docs.limit(0)).count() == 0
    assert [r.tokens for r in tokens.count_tokens(docs.where("doc_id = 3"), ["doc_id"]).collect()] == [1, 1]
