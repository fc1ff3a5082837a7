"""Ids against the tokenizer itself, and back to the text."""

from __future__ import annotations

import os

import pytest
from conftest import rows

from tidewater.llm.encode import VOCABULARY, decode_corpus, encode_corpus, encoding

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="needs the vocabulary")
TEXTS = [
    "Hello world, it's <|endoftext|> fine!!  ", "", None, "  \n\n tabs\t\tand   spaces here　 ", "中文和English混合。ｶﾞ 한국어 ёж", "👍🏽 ok\r\nline sep 123 ४५", "a" * 50000, "the " * 20000, "é ﬁ ​ x", "'s 't don't I'll",
]


def test_ids_equal_the_tokenizers_and_decode_back(spark):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "x", "y")], "doc int, text string, ids string, word string")
    enc = encoding(VOCABULARY)
    want = {i: enc.encode_ordinary(t) if t else [] for i, t in enumerate(TEXTS)}
    for frequent in (1, 4, 20, 1 << 16):  # nearly all words come back by position, some, none
        done = encode_corpus(df, key="doc", text="text", frequent=frequent)
        assert {r.doc: r.ids for r in done.collect()} == want and done.count() == len(TEXTS)
    assert {r.doc: r.text for r in decode_corpus(done, key="doc").collect()} == {i: t or "" for i, t in enumerate(TEXTS)}


def test_empty_table(spark):
    assert rows(encode_corpus(spark.createDataFrame([], "doc int, text string"), key="doc", text="text")) == []
