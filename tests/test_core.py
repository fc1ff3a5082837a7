"""Scenarios of single operators with tables made here."""

from __future__ import annotations

import zlib

from conftest import rows
from pyspark.sql import functions as F

from tidewater.functions import media, python, text
from tidewater.operators import folds, overlap, quality, timeline
from tidewater.sources import paged, subtitles, wire


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column.alias("x")).first()[0]


def test_text_functions(spark):
    c = F.col
    assert one(spark, text.clock(c("s")), s=59.5) == "01:00" and one(spark, text.clock(c("s")), s=6000.5) == "100:00"
    assert one(spark, text.neutral_markdown(c("t")), t="# a\n  --- b\nok") == "\\# a\n  \\--- b\nok"
    assert one(spark, text.file_name(c("t")), t=' a/b:c  "d". ') == "a b c d"
    assert one(spark, text.hamming(text.phash_bits(c("a")), text.phash_bits(c("b"))), a="0000000000000000", b="f00000000000000f") == 8
    assert one(spark, text.comparison_key(c("t")), t="*Hi, There！ ") == "hi,there"
    assert one(spark, text.join_words(F.array(F.lit("ab"), F.lit("cd"), F.lit("，"), F.lit("好"), F.lit("e")))) == "ab cd，好e"
    answer = '<think>["x"]</think> so [{"text": "a", "count": 2}, {"text": "b"}] end'
    assert [tuple(x) for x in one(spark, text.json_array_in(c("t")), t=answer)] == [("a", 2), ("b", 1)] and one(spark, text.json_array_in(c("t")), t="none") == []
    assert one(spark, text.masked(c("t")), t="short") == "***" and one(spark, text.masked(c("t")), t="abcdefghijk") == "abcd...hijk"


def test_media_functions(spark):
    c = F.col
    assert one(spark, media.poster_hash(c("m")), m=123456) == zlib.crc32(b"123456")
    assert one(spark, media.part_address(c("u"), F.lit(3)), u="https://x.example/watch?v=abc&p=1#t") == "https://x.example/watch?v=abc&p=3"
    assert one(spark, media.on_host(c("u"), "video.example"), u="https://m.video.example/x") and not one(spark, media.on_host(c("u"), "video.example"), u="https://badvideo.example/x")
    assert one(spark, media.contained_path(c("p")), p="../x") is None and one(spark, media.contained_path(c("p")), p="a/b.jpg") == "a/b.jpg"
    assert one(spark, media.lrc_stamp(c("s")), s=61.239) == "[01:01.24]"


def test_asof_takes_the_last_boundary_and_clamps(spark):
    bounds = spark.createDataFrame([("a", 0.0), ("a", 12.0), ("a", 30.0)], "k string, boundary double")
    events = spark.createDataFrame([("a", 1, -5.0), ("a", 2, 12.0), ("a", 3, 29.9), ("a", 4, None), ("b", 5, 1.0)], "k string, n int, ts double")
    assert rows(timeline.asof_backward(events, bounds, ["k"], "ts").select("n", "boundary")) == [(1, 0.0), (2, 12.0), (3, 12.0), (4, None), (5, None)]
    assert one(spark, timeline.fixed_grid(F.lit(150), 75.0)) == [0.0, 75.0, 150.0] and one(spark, timeline.fixed_grid(F.lit(None).cast("int"), 75.0)) == [0.0]


def test_overlap_pairs_once(spark):
    left = spark.createDataFrame([("v", 1, 0.0, 40.0), ("v", 2, 40.0, 41.0), ("v", 3, 5.0, 5.0)], "k string, n int, start double, end double")
    right = spark.createDataFrame([("v", 7, 1.0, 39.0), ("v", 8, 40.0, 60.0), ("w", 9, 0.0, 9.0)], "k string, n int, start double, end double")
    assert rows(overlap.overlap_join(left, right, keys=["k"]).select("n", "r_n")) == [(1, 7), (2, 8)]


def test_folds(spark):
    frames = spark.createDataFrame([("v", t, h) for t, h in ((0, 0), (4, 3), (8, 15), (12, 255))], "k string, ts int, bits bigint")
    assert [r[1] for r in rows(folds.last_kept(frames, ["k"], ["ts"], "bits", 5))] == [0, 12]
    asks = spark.createDataFrame([("l", 1, 60.0), ("l", 2, 50.0), ("l", 3, 40.0), ("l", 4, 0.0)], "k string, n int, amount double")
    assert [r[1] for r in rows(folds.admitted(asks, ["k"], ["n"], "amount", 100.0))] == [1, 3, 4]
    calls = spark.createDataFrame([("r", float(t), t) for t in (0, 10, 20, 61, 62)], "k string, at double, n bigint")
    assert [r[2] for r in rows(folds.rate_limited(calls, ["k"], "at", "n", 2, 60.0))] == [0, 10, 61]


def test_repetition_of_short_and_empty_tracks(spark):
    shape = "id string, pos int, text string"
    data = [("loop", i, "same" if i < 6 else f"t{i}") for i in range(15)] + [("short", 0, "a"), ("short", 1, "a")] + [("blank", i, "") for i in range(6)]
    got = {r.id: r for r in quality.repetition(spark.createDataFrame(data, shape), ["id"]).collect()}
    assert got["loop"].looping and got["loop"].longest_run == 6 and got["loop"].repeat_ratio == 0.4
    assert not got["short"].looping and not got["blank"].looping and got["blank"].top_text is None


def test_subtitle_readers_skip_what_is_no_cue(spark):
    body = "WEBVTT\n\nNOTE x\n\n1\n00:00:01.000 --> 00:00:02.500\nfirst\nwrapped\n\n00:03.000 --> 00:04.000\nno hours\n\n00:00:05,000 --> 00:00:06,000\n \n"
    files = spark.createDataFrame([("f", body), ("e", ""), ("n", None)], "k string, body string")
    assert rows(subtitles.parse_timed_blocks(files, "body", "k")) == [("f", 0, 1.0, 2.5, "first wrapped")]
    bodies = spark.createDataFrame([("o", '{"body":[{"from":1,"to":2,"content":" a "}]}'), ("l", '[{"from":1,"to":2,"content":"b"}]'), ("x", "junk")], "k string, body string")
    assert rows(subtitles.parse_json_cues(bodies, "body", "k")) == [("l", 0, 1.0, 2.0, "b"), ("o", 0, 1.0, 2.0, "a")]


def test_wire_round_trip_and_garbage():
    made = [{"content_ts": 1.234, "text": "你好", "high_like": True, "mid_hash": "ab"}, {"content_ts": 0.0, "text": "x", "high_like": False, "mid_hash": ""}]
    assert wire.comments(wire.encode_comments(made)) == made
    assert wire.comments(b'{"code":-352}') == [] and wire.comments(b"") == [] and wire.comments(None) == [] and wire.widgets(b"\xff\xff") == []


def test_paged_census_keeps_what_came_before_a_broken_page(spark, tmp_path):
    (tmp_path / "1.jsonl").write_text('{"content_ts": 1.0, "text": "a"}\n')
    (tmp_path / "2.jsonl").write_text('{"content_ts": 2.0, "text": "b"}\n{"content_ts": 3.0')
    (tmp_path / "3.jsonl").write_text("broken\n")
    spark.dataSource.register(paged.PagedCensus)
    df = spark.read.format("tidewater_pages").option("folder", str(tmp_path)).option("pages", 4).load()
    assert rows(df.select("page", "text")) == [(1, "a"), (2, "b")]


def test_python_functions():
    assert python.folded("Ａ b-Ç") == "abç" and python.ratio("", "a") == 0.0 and python.ratio("ab", "ab") == 1.0
    assert python.support("abc", "xxabcxx") == 1.0 and python.support("abcd", "xxabzdxx") > 0.6 and python.support("abc", "") == 0.0


def test_recordings_match_in_spite_of_gain_and_offset(spark):
    import numpy as np

    from tidewater.functions import signal
    from tidewater.operators import recordings

    rng = np.random.default_rng(5)
    second = signal.RATE
    whole = np.convolve(rng.normal(size=30 * second), np.ones(4) / 4, "same").astype(np.float32)
    part = whole[3 * second : 23 * second] * 0.4
    other = rng.normal(size=20 * second).astype(np.float32)
    mixed = np.concatenate([part[: 10 * second], other[: 10 * second]])
    raw = lambda x: bytearray(x.astype("<f4").tobytes())
    data = [("same", raw(part), raw(whole)), ("other", raw(other), raw(whole)), ("short", raw(part[:100]), raw(whole)), ("half", raw(mixed), raw(whole)), ("none", None, raw(whole))]
    pairs = spark.createDataFrame(data, "k string, samples binary, reference binary")
    got = {r.k: r for r in recordings.decisions(pairs, ["k"], "samples", "reference").collect()}
    assert {k: r.decision for k, r in got.items()} == {"same": "same_recording_high_fit", "other": "not_established", "short": "too_short", "half": "not_established", "none": "too_short"}
    assert got["same"].coverage == 1.0 and got["same"].longest_gap == 0.0 and got["half"].longest_gap > 9 and 0 < got["half"].fraction < 0.4
    at = recordings.offsets(recordings.window_matches(pairs, ["k"], "samples", "reference"), ["k"])
    assert [(r.k, round(r.value, 2)) for r in at.orderBy("k", "first").collect()] == [("half", 3.0), ("same", 3.0)]
    assert recordings.decisions(pairs.limit(0), ["k"], "samples", "reference").count() == 0
    tone = np.sin(np.arange(2 * second) * 0.5).astype(np.float32)
    assert signal.landmarks(tone) == signal.landmarks(tone) and signal.landmarks(tone[:10]) == []
    marks = spark.createDataFrame([(raw(whole),), (None,)], "samples binary").select(signal.fingerprint("samples").alias("m")).collect()
    assert [(x.hash, x.t) for x in marks[0].m] == signal.landmarks(whole) and marks[1].m == []


def test_folds_on_changes(spark):
    rows_ = spark.createDataFrame([("v", i, v) for i, v in enumerate((0, 4, 9, 10, 25))], "k string, n int, v bigint")
    assert [r[1] for r in rows(folds.changed(rows_, ["k"], ["n"], "v", 9))] == [0, 2, 4]
