"""Choosing tracks, telling authors, flattening records and sorted passes, on small made-up cases."""

from __future__ import annotations

import random
import zlib

from conftest import rows
from pyspark.sql import functions as F

from tidewater.functions import media
from tidewater.functions import text as X
from tidewater.functions.python import phonetic_key, romanised
from tidewater.operators import acquire, authors, folds
from tidewater.sources import metadata


def test_the_first_track_without_a_marker_is_taken(spark):
    offered = [
        ("a", "zh-CN", True, "好的"), ("a", "ai-zh", True, "x"), ("a", "en", True, "x"),
        ("b", "ai-zh", False, "我们**了"), ("b", "en", False, "has ** in it"), ("b", "ai-en", True, "x"),
        ("c", "zh", True, "XX"), ("c", "ai-zh", True, "和X"), ("d", "pl", True, "x"), ("e", "ja", True, "x"), ("e", "ja", False, "y"), ("f", "zh", True, None),
    ]
    df = spark.createDataFrame(offered, "id string, key string, people boolean, body string")
    df = df.withColumn("rank", acquire.preference(F.col("key"), F.col("people"))).withColumn("marker", acquire.marker(F.col("key"), F.col("body")))
    got = {r.id: tuple(r)[1:] for r in acquire.walk(df, ["id"]).collect()}
    assert got == {
        "a": ("zh-CN", "human-sub", "", False), "b": ("ai-en", "auto-sub", "ai-zh (**)", True), "c": (None, None, "zh (XX), ai-zh (和X)", False),
        "e": ("ja", "auto-sub", "", False), "f": ("zh", "human-sub", "", False),
    }
    assert acquire.walk(df.limit(0), ["id"]).count() == 0


def test_authors_by_hash(spark):
    shown = lambda n: f"{zlib.crc32(str(n).encode()):x}"
    people = spark.createDataFrame([("v", 7, "staff"), ("v", 7, "owner"), ("v", 9, "staff"), ("w", 11, "owner"), ("v", None, "owner")], "video string, mid bigint, role string")
    said = [(1, "v", shown(7)), (2, "v", "0" + shown(7).upper()), (3, "v", shown(9)), (4, "v", shown(11)), (5, "w", shown(11)), (6, "v", ""), (7, "v", None), (8, "v", "no hash"), (1, "v", shown(7))]
    df = spark.createDataFrame(said, "seq bigint, id string, mid_hash string")
    got = rows(authors.classify_authors(df, authors.posters(people, video="video", member="mid", role="role"), video="id", poster="mid_hash").select("seq", "author"))
    assert got == [(1, "owner"), (1, "owner"), (2, "owner"), (3, "staff"), (4, None), (5, "owner"), (6, None), (7, None), (8, None)]


def test_track_kinds_and_masks(spark):
    keys = ["ai-zh", "ai-zh-Hans", "ai-", "danmaku", "zh", "en-US", "EN", "e", None]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    assert [r[0] for r in df.select(X.track_kind(F.col("k"))).collect()] == ["auto-sub", "auto-sub", None, None, "human-sub", "human-sub", None, None, None]
    secrets = spark.createDataFrame([(k,) for k in ["abcdefghij", "short", "", None]], "k string")
    assert [r[0] for r in secrets.select(X.masked(F.col("k"))).collect()] == ["abcd...ghij", "***", "<none>", "<none>"]
    levels = spark.createDataFrame([(k,) for k in [0, 1, 3, 4, None]], "k int")
    assert [r[0] for r in levels.select(media.guard_level(F.col("k"))).collect()] == [3, 1, 3, 3, 3]


def test_answers_of_a_model(spark):
    said = ['<think>[1]</think>ok [{"text":"a","count":2},{"text":"b"}] done', "no array", '[{"text":"a"}] and [doge]', None, '[{"text":"<think>x</think>"}]']
    df = spark.createDataFrame([(k,) for k in said], "k string")
    got = [[tuple(x) for x in r[0]] for r in df.select(X.json_array_in(F.col("k"))).collect()]
    assert got[0] == [("a", 2), ("b", 1)] and got[1] == [] and got[3] == []
    bodies = ['{"choices":[{"finish_reason":"stop","message":{"content":"{\\"a\\":1}"}}]}', '{"choices":[{"message":{"content":"[1]"}}]}', '{"choices":[{"finish_reason":"length","message":{"content":"{}"}}]}', '{"choices":[]}', '{"choices":[{"message":{"content":"{x"}}]}', None]
    df = spark.createDataFrame([(k,) for k in bodies], "k string")
    assert [r[0] for r in df.select(metadata.model_object(F.col("k"))).collect()] == ["ok", "no object", "missing or truncated", "missing or truncated", "no JSON", "missing or truncated"]


def test_flat_records(spark):
    views = [("a", '{"code":0,"data":{"cid":5,"duration":9,"pages":[]}}'), ("b", '{"code":0,"data":{"pages":[{"page":1,"cid":6,"part":"x","duration":1},{"page":2,"cid":7}]}}'), ("c", '{"code":-404}'), ("d", "no json"), ("e", None)]
    df = spark.createDataFrame(views, "id string, body string")
    assert rows(metadata.view_pages(df, "id", "body")) == [("a", 1, 5, None, 9), ("b", 1, 6, "x", 1), ("b", 2, 7, None, None)]
    infos = spark.createDataFrame([("a", '{"subtitles":{"zh":"x"},"automatic_captions":{"en":"y"}}'), ("b", "{}"), ("c", None)], "id string, body string")
    assert rows(metadata.offered_tracks(infos, "id", "body")) == [("a", "en", "auto-sub"), ("a", "zh", "human-sub")]
    formats = [[("xml", "inline", None), ("vtt", None, "http://v")], [("xml", None, "http://x"), ("ass", "body", None)], [("srt", "", ""), ("json", "body", "http://j")], [("srt", None, None)], []]
    df = spark.createDataFrame([(f,) for f in formats], f"f {metadata.OFFER}").select(metadata.delivery(F.col("f")).alias("d")).select("d.ext", "d.body")
    assert [tuple(r) for r in df.collect()] == [("vtt", "http://v"), ("xml", "http://x"), ("json", "body"), (None, None), (None, None)]
    times = spark.createDataFrame([(86400.5, "20200101"), (0.0, "20200101"), (None, "20200102"), (None, "2020"), (None, None)], "t double, d string")
    assert [r[0] for r in times.select(metadata.published_at(F.col("t"), F.col("d"))).collect()] == ["1970-01-02T00:00:00Z", "2020-01-01T00:00:00Z", "2020-01-02T00:00:00Z", None, None]


def test_sounds_of_kana(spark):
    assert romanised("きっと しゃしん") == "kittosyasin" and romanised("ラーメン 3") == "ramen3" and romanised("ﾃｽﾄ") == "tesuto"
    df = spark.createDataFrame([("カメラ", "ja"), ("Camera!", "en"), (None, "ja"), ("", None)], "t string, k string")
    assert [r[0] for r in df.select(phonetic_key("t", "k")).collect()] == ["kamera", "camera", None, ""]


def test_sorted_passes_against_loops(spark):
    rng = random.Random(4)
    data = [(rng.choice(["a", "b", None]), i, rng.random() * 50, float(rng.randrange(0, 4))) for i in range(3000)]
    data.sort(key=lambda _: rng.random())
    df = spark.createDataFrame(data, "k string, o int, amount double, v double")
    ordered = lambda k: sorted((d for d in data if d[0] == k), key=lambda d: d[1])
    spent, want = {}, []
    for k in ("a", "b", None):
        for d in ordered(k):
            if spent.get(k, 0.0) + d[2] <= 700 + 1e-9:
                spent[k] = spent.get(k, 0.0) + d[2]
                want.append((k, d[1]))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in folds.admitted(df, ["k"], ["o"], "amount", 700.0).collect())
    want = []
    for k in ("a", "b", None):
        held = []
        for d in ordered(k):
            held = [x for x in held if x > d[1] - 40.0]
            if len(held) < 3:
                held.append(float(d[1]))
                want.append((k, float(d[1]), d[1]))
    calls = df.select("k", F.col("o").cast("double").alias("t"), F.col("o").cast("bigint").alias("n"))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in folds.rate_limited(calls, ["k"], "t", "n", 3, 40.0).collect())
    one = folds.merged_offsets(df, ["k"], "o", "v", 0.5)
    assert {(r.k, r.first) for r in one.collect()} == {(k, d[1]) for k in ("a", "b", None) for p, d in zip([None, *ordered(k)], ordered(k)) if p is None or p[3] != d[3]}
    for empty in (folds.admitted(df.limit(0), ["k"], ["o"], "amount", 1.0), folds.merged_offsets(df.limit(0), ["k"], "o", "v", 1.0), folds.changed(df.limit(0), ["k"], ["o"], "v", 1.0)):
        assert empty.count() == 0
