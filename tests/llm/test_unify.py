"""One form for texts that look the same."""

from __future__ import annotations

from conftest import rows

from tidewater.llm.text import canonical, osa
from tidewater.llm.unify import reads_as, unified


def test_forms():
    strict = lambda t: canonical(t, fold=False)
    for a, b in (("cozy hexagon choir", "соzу һехаgоn сһоir"), ("café", "café"), ("大工匠NO1", "⼤エ匠ＮО１"), ("a b", "a b"), ("ab", "a​﻿b"), ("süße", "süβe"), ("ガ", "ｶﾞ")):
        assert strict(a) == strict(b)
    for a, b in (("cafe", "café"), ("Ab", "ab"), ("车", "車"), ("abc", "ab"), ("a b", "ab")):
        assert strict(a) != strict(b)
    assert canonical("STRASSE") == canonical("straße") and canonical("ВСЕ РЕБЯТА") == canonical("все ребята")
    assert canonical("") == "" and canonical("​") == "" and len(canonical("Ａ" * 100000)) == 100000


def test_edit_distance():
    assert osa("abcd", "abdc", 2) == 1 and osa("abcd", "bcd", 2) == 1 and osa("abc", "abc", 2) == 0 and osa("abc", "xyz", 2) == 3 and osa("ab", "ba", 1) == 1


def test_matching_rows(spark):
    texts = spark.createDataFrame(
        [(1, "сору that", "k"), (2, "copy that", "k"), (3, "COPY THAT", "k"), (4, None, "k"), (5, "", "k"), (6, "сору that", "k"), (6, "сору that", "k"), (7, "copy　that", "k")], "row int, text string, _key string"
    )
    phrases = spark.createDataFrame([(9, "copy that", "en"), (8, None, "en"), (7, "other", "en")], "pid int, phrase string, lang string")
    hits = reads_as(texts, phrases, text="text", phrase="phrase", phrase_id="pid")
    assert rows(hits.select("row", "pid")) == [(1, 9), (6, 9), (6, 9), (7, 9)]
    assert reads_as(texts.limit(0), phrases, text="text", phrase="phrase", phrase_id="pid").count() == 0
    assert reads_as(texts, phrases.limit(0), text="text", phrase="phrase", phrase_id="pid").count() == 0
    assert rows(texts.select(unified("text").alias("x")).filter("x is null")) == [(None,)]
