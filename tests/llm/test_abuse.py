"""Scores on held-out wordings, disguises and neutral mentions."""

from __future__ import annotations

import re
import zlib

import pytest
from conftest import SMALL, rows
from pyspark.sql import functions as F

from tidewater.llm import abuse as A


@pytest.fixture(scope="module")
def inputs(spark):
    return spark.read.parquet(f"{SMALL}/moderation_labels.parquet"), [spark.read.parquet(f"{SMALL}/danmaku_raw.parquet").select("text")]


@pytest.fixture(scope="module")
def model(inputs):
    return A.fit(*inputs)


def test_judged_wordings_in_other_company(model):
    bad = ["you there, go drown yourself idiot", "nobody would miss you, moron", "你就是个脑残", "Velmari are vermin", "заткнись, мразь", "黙れクズ", "cállate ya, imbécil", "send me nudes"]
    good = ["kill the dragon first, then heal", "my Velmari neighbor bakes great bread", "这个废物利用的点子不错", "笑死我了", "greetings from the harbor", "la basura se recicla así", "", "123", "hhhh", "awww"]
    assert [t for t, s in zip(bad, model.score(bad)) if s < 0.5] == []
    assert [t for t, s in zip(good, model.score(good)) if s >= 0.5] == []


def test_held_out_wordings(spark):
    """A fifth of the judged clauses, and every sentence that holds one of them, is kept from the fit."""
    folder = "/root/testdata/sf0.1"
    judged = [(r.text, r.label) for r in spark.read.parquet(f"{folder}/moderation_labels.parquet").orderBy("item_id").collect()]
    out = lambda t: any(zlib.crc32(c.encode()) % 5 == 0 for c in A.pieces(t))
    held = [(t, y != "none") for t, y in judged if out(t)]
    counts = [(r.clause, r.alone, r.hidden) for r in A.wordings([spark.read.parquet(f"{folder}/danmaku_raw.parquet").select("text")]).collect()]
    m = A.Classifier([(t, y) for t, y in judged if not out(t)], sorted(counts))
    got = [s >= 0.5 for s in m.score([t for t, _ in held])]
    found, bad = sum(g and y for g, (_, y) in zip(got, held)), sum(y for _, y in held)
    assert bad > 20 and found > 0.7 * bad
    assert sum(g and not y for g, (_, y) in zip(got, held)) <= 0.1 * len(held)


def test_nothing_is_learnt_from_sentences_of_our_own():
    """The module holds no sentence, name or word to look for: no letters beyond those of code and documentation."""
    source = open(A.__file__, encoding="utf-8").read()
    allowed = re.sub(r"[㐀鿿぀ヿ•·，；。！？、：]", "", source)
    assert allowed.isascii() and "SEEDS" not in source


def test_disguises(model):
    texts = ["5end m3 nud35", "s-e-n-d m-e n-u-d-e-s", "你 就 是 个 白 痴", "ѕеnd mе nudеѕ", "go drown yourself idioooot", "nice drone, show us your boobs", "脱​光​给​我​看​看"]
    assert [t for t, s in zip(texts, model.score(texts)) if s < 0.5] == []
    assert A.unveiled("s-e-n-d it") == ("send it", True) and A.unveiled("Send it!!!") == ("send it!!!", False)


def test_wordings_some_writers_hide():
    counts = [("plain", 4000, 0), ("other", 500, 0), ("rare", 2, 0), *((f"p{i}", 30, 0) for i in range(50)), ("hidden", 60, 8), ("3d", 40, 40), ("4k", 12, 12)]
    got = A.hidden_wordings(counts)
    assert [k for k, p in got.items() if p >= A.HIDDEN] == ["hidden"]
    assert A.hidden_wordings([]) == {}


def test_groups_are_what_judged_hate_differs_in():
    got = A.interchangeable(["all mud folk are bad", "all tin folk are bad", "甲地人都坏"], ["all mud folk are bad", "all tin folk are bad", "甲地人都坏", "乙地人都坏", "you are a fool"])
    assert got == [["mud", "tin"], ["乙", "甲"]]


def test_swapping_a_group_hardly_moves_the_score(model):
    assert any("velmari" in g for g in model.groups)
    raw = lambda t: model._raw(A.pieces(t))[0]
    for g in ("Velmari", "Keldu people", "Ostrani"):
        assert abs(raw(f"the {g} folk songs are lovely") - raw("the Drayfolk folk songs are lovely")) < 1.5


def test_columns(spark, model):
    bad, worse = "go drown yourself idiot", "send me nudes tonight"
    data = [(1, bad, None, 0.5), (2, None, "nice", 0.5), (3, None, None, 0.5), (4, "", worse, 0.5), (1, bad, None, 0.5), (5, "well " * 20000 + ", " + bad, None, 0.5)]
    df = spark.createDataFrame(data, "n int, msg string, trans string, score double")
    got = rows(A.abuse_scores(df, [F.col("msg"), F.col("trans")], model).select("n", (F.col("score") >= 0.5).alias("bad")))
    assert got == [(1, True), (1, True), (2, False), (3, None), (4, True), (5, True)]
    assert A.abuse_scores(df.limit(0), [F.col("msg")], model).count() == 0


def test_empty_tables(spark, inputs):
    empty = spark.createDataFrame([], "text string")
    m = A.fit(inputs[0].limit(0), [empty])
    assert m.score(["anything", ""]) == pytest.approx([0.0, 0.0], abs=0.2)
