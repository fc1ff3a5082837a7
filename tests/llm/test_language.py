"""Languages of documents, tracks and segments on made-up text and on the smallest tables."""

from __future__ import annotations

import numpy as np
from conftest import SMALL, rows
from pyspark.sql import functions as F

from tidewater.llm import language as L

SAID = {
    "zh": "我们回来的路上把折叠的滑翔伞搬到了羽毛谷。", "en": "Somebody left a glowing workbench on the stairs, so be careful.", "ja": "来週は私たちが駅で提灯を最初から作り直します。",
    "es": "Alguien dejó un compás plateado en la escalera, así que cuidado.", "fr": "Quelqu'un a laissé un lampion bruyant dans l'escalier, faites attention.",
    "de": "Jemand hat die Laterne auf der Treppe vergessen, also passt auf.", "ru": "Кто-то оставил фонарь на лестнице, будьте осторожны.",
}
MODEL = None


def model(spark):
    global MODEL
    MODEL = MODEL or L.fit(spark.read.parquet(f"{SMALL}/documents.parquet"))
    return MODEL


def test_documents(spark):
    texts = [(lang, (s + "\n") * 4 + SAID["en"]) for lang, s in SAID.items()] + [("none", None), ("empty", ""), ("wordless", "123 ... !!"), ("zh", (SAID["zh"] + "\n") * 4 + SAID["en"])]
    texts.append(("long", SAID["de"] * 5000))
    df = spark.createDataFrame([(*t, "x") for t in texts], "id string, text string, lang string")
    got = {r.id: r for r in L.document_languages(df, key="id", text="text", model=model(spark)).collect()}
    assert all(got[lang].lang == lang for lang in SAID) and got["long"].lang == "de" and got["long"].confidence > 0.99
    assert got["none"].lang is None and got["empty"].lang is None and got["wordless"].lang is None
    assert got["zh"].langs == ["zh", "en"] and 0.7 < got["zh"].confidence < 0.9
    assert L.document_languages(df.limit(0), key="id", text="text", model=model(spark)).count() == 0


def test_garbled_and_disguised_text_keeps_its_language(spark):
    from tidewater.llm.mojibake import garble

    texts = [garble(SAID["zh"], [("utf-8", "latin-1")]), garble(SAID["ru"], [("utf-8", "cp1252")]), garble(SAID["ja"], [("utf-8", "cp1252")]), L._disguise(SAID["en"])]
    best = [L.LANGS[i] for i in model(spark).likelihoods(texts, False)[0].argmax(axis=1)]
    assert best == ["zh", "ru", "ja", "en"]


def test_segments(spark):
    lines = [("t", i, SAID["fr"]) for i in range(8)] + [("t", 20, SAID["en"]), ("t", 21, "(sighs)"), ("t", 22, None), ("t", 23, ""), ("t", 24, "OK"), ("t", 0, SAID["fr"]), ("u", 30, SAID["ru"])]
    df = spark.createDataFrame([(*x, 1) for x in lines], "track string, cue int, text string, code int")
    tracks, parts = L.sequence_languages(df, keys=["track"], record="cue", text="text", model=model(spark))
    assert rows(tracks.select("track", "lang")) == [("t", "fr"), ("u", "ru")]
    got = {r.cue: r.lang for r in parts.collect()}
    # Two letters stand in the language of their sequence; what has no words has no row.
    assert got[20] == "en" and got[0] == "fr" and got[24] == "fr" and not {21, 22, 23} & set(got)
    empty = L.sequence_languages(df.limit(0), keys=["track"], record="cue", text="text", model=model(spark))
    assert [x.count() for x in empty] == [0, 0]


def test_labels(spark):
    said = ["zh_TW", "ai-zh", "ZHO", "en-US", "eng", "jpn", "es-419", "und", "auto", "", None, "ko", "German"]
    df = spark.createDataFrame([(x,) for x in said], "x string").select(L.named(F.col("x")).alias("y"))
    assert [r.y for r in df.collect()] == ["zh", "zh", "zh", "en", "en", "ja", "es", None, None, None, None, None, "de"]


def test_a_language_that_explains_nothing_is_taken_out():
    def code(best, second, gap):
        level = [15] * 7
        level[best], level[second] = 0, min(15, int(np.searchsorted(L.LEVELS, gap * 0.25, "right")) - 1)
        return sum(x << 4 * i for i, x in enumerate(level))

    pi, _ = L.mixtures(np.zeros(3, np.int64), np.array([code(0, 1, 63), code(1, 0, 2), code(2, 0, 63)]), np.array([50.0, 1.0, 5.0]), 1)
    assert pi[0, 1] == 0 and pi[0, 0] > 0.9 and pi[0, 2] > 0.05


def test_phrases():
    known = L.Phrases(["Cozy Otter Squad", "口袋工坊一起走"])
    assert known.like("Cozy  Otter Squad lol") and known.like("口袋坊一起走") and not known.like("something else")
    assert not known.like("Cozy Otter Squad " + "x" * 50000) and not L.Phrases([]).like("x")
