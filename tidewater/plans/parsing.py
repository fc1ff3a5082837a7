"""Queries that write records in the formats of the sources and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.plans.base import query, records
from tidewater.sources import subtitles, wire

_TRACK = ["id", "part", "track"]
_OK = "text is not null and regexp_full_match(text, '[^\\s　].*') and not regexp_matches(text, '[\\s　]$') and not regexp_matches(text, '[\\r\\n]') and \"start\" >= 0 and \"end\" >= 0"
_CUES = f"""(select id, part, track, row_number() over (partition by id, part, track order by pos) - 1 as pos, round("start", 3) as "start", round("end", 3) as "end", text
 from (select distinct id, part, track, pos, "start", "end", text from cues) where {_OK})"""


def _cues(spark, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir, "cues", *_TRACK, "pos", "start", "end", "text")
    return rows.filter(F.col("text").rlike(r"^[^\s　]") & ~F.col("text").rlike(r"[\s　]$") & ~F.col("text").rlike(r"[\r\n]") & (F.col("start") >= 0) & (F.col("end") >= 0))


def _stamp(seconds, mark: str):
    ms = F.round(seconds * 1000).cast("bigint")
    two = lambda x: F.lpad(F.floor(x).cast("string"), 2, "0")
    return F.concat(two(ms / 3600000), F.lit(":"), two(ms / 60000 % 60), F.lit(":"), two(ms / 1000 % 60), F.lit(mark), F.lpad((ms % 1000).cast("string"), 3, "0"))


def _written(spark, sf_dir: str) -> DataFrame:
    """Every cue with text, as it is; only times below zero have no stamp."""
    return records(spark, sf_dir, "cues", *_TRACK, "pos", "start", "end", "text", where="text is not null and start >= 0 and end >= 0")


def _timed(cues: DataFrame, mark: str, head: str) -> DataFrame:
    block = F.concat(F.col("pos").cast("string"), F.lit("\n"), _stamp(F.col("start"), mark), F.lit(" --> "), _stamp(F.col("end"), mark), F.lit("\n"), F.col("text"))
    parts = F.sort_array(F.collect_list(F.struct("pos", block.alias("b"))))
    return cues.groupBy(*_TRACK).agg(F.concat(F.lit(head), F.array_join(parts["b"], "\n\n"), F.lit("\n")).alias("body"))


@query(f"select * from {_CUES}")
def source_srt(spark, sf_dir: str) -> DataFrame:
    return subtitles.parse_timed_blocks(_timed(_cues(spark, sf_dir), ",", ""), "body", *_TRACK)


@query(f"select * from {_CUES}")
def source_vtt(spark, sf_dir: str) -> DataFrame:
    return subtitles.parse_timed_blocks(_timed(_cues(spark, sf_dir), ".", "WEBVTT\n\nNOTE made here\n\n"), "body", *_TRACK)


@query(f"select * from {_CUES}")
def source_json_cues(spark, sf_dir: str) -> DataFrame:
    return _through_json(_cues(spark, sf_dir))


def _through_json(cues: DataFrame) -> DataFrame:
    cue = F.struct(F.round("start", 3).alias("from"), F.round("end", 3).alias("to"), F.col("text").alias("content"))
    rows = F.sort_array(F.collect_list(F.struct("pos", cue.alias("c"))))
    files = cues.groupBy(*_TRACK).agg(F.to_json(F.struct(rows["c"].alias("body"))).alias("body"))
    return subtitles.parse_json_cues(files, "body", *_TRACK)


@query(None)
def source_srt_all(spark, sf_dir: str) -> DataFrame:
    """``source_srt`` with the texts the parser changes: lines joined, edges trimmed, what follows a blank line and empty cues dropped."""
    return subtitles.parse_timed_blocks(_timed(_written(spark, sf_dir), ",", ""), "body", *_TRACK)


@query(None)
def source_vtt_all(spark, sf_dir: str) -> DataFrame:
    return subtitles.parse_timed_blocks(_timed(_written(spark, sf_dir), ".", "WEBVTT\n\nNOTE made here\n\n"), "body", *_TRACK)


@query(None)
def source_json_cues_all(spark, sf_dir: str) -> DataFrame:
    """``source_json_cues`` with the texts the parser changes: their edges are trimmed."""
    return _through_json(_written(spark, sf_dir))


@query(r"""select cue_id, nullif(regexp_replace(regexp_replace(text, '^>>\s*', ''), '^[\s　]+|[\s　]+$', '', 'g'), '') as text from (select distinct cue_id, text from cues)""")
def source_unrolled(spark, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir, "cues", "text").select("cue_id", subtitles.without_turn_marks(F.col("text")).alias("text"))


@query("""select c.id, c.part, c.track, round(c."start" + 10, 3) as "start", round(least(c."end", v.duration) + 10, 3) as "end", c.text || '!' as text from (select distinct cue_id, id, part, track, "start", "end", text from cues where text is not null) c
 join video_pages v on v.id = c.id and v.page = c.part where v.duration is not null and c."start" >= 0 and c."end" >= c."start" and round(c."end" * 1000) / 1000 <= v.duration + 0.25""")
def source_speech_words(spark, sf_dir: str) -> DataFrame:
    from tidewater.tables import load

    pages = load(spark, sf_dir, "video_pages", "id", "page", "duration").withColumnRenamed("page", "part").filter("duration is not null")
    rows = records(spark, sf_dir, "cues", *_TRACK, "start", "end", "text", where="text is not null").join(pages, ["id", "part"])
    word = F.struct(F.round(F.col("start") * 1000).cast("bigint").alias("begin_time"), F.round(F.col("end") * 1000).cast("bigint").alias("end_time"), "text", F.lit("!").alias("punctuation"))
    sentence = F.array(F.struct(F.array(word).alias("words")))
    files = rows.select(*_TRACK, "duration", F.lit(10.0).alias("offset"), F.to_json(F.struct(F.array(F.struct(sentence.alias("sentences"))).alias("transcripts"))).alias("body"))
    out = subtitles.parse_speech_words(files, "body", "offset", "duration", *_TRACK)
    return out.select(*_TRACK, F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "text")


@query("""select id, part, content_ts, text, high_like, coalesce(mid_hash, '') as mid_hash from (select distinct * from danmaku_raw where text is not null and content_ts >= 0)""")
def source_comment_segments(spark, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir, "danmaku_raw", "id", "part", "content_ts", "text", "high_like", "mid_hash", where="text is not null and content_ts >= 0")
    # A segment holds six minutes of content, so no page is gathered whole.
    each = F.struct("content_ts", "text", "high_like", "mid_hash")
    segments = rows.groupBy("id", "part", F.floor(F.col("content_ts") / 360).alias("segment")).agg(wire.encode_segment(F.collect_list(each)).alias("body"))
    return segments.select("id", "part", F.explode(wire.decode_comments("body")).alias("x")).select("id", "part", "x.*")


@query("""select seq, event_type, room_id, uid, msg from (select distinct * from live_events)""")
def source_json_journal(spark, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir, "live_events", "event_type", "room_id", "uid", "msg")
    lines = rows.select(F.to_json(F.struct("seq", "event_type", "room_id", "uid", "msg", F.lit(1).alias("unknown"))).alias("line"))
    read = lines.select(F.from_json("line", "seq bigint, event_type string, room_id bigint, uid bigint, msg string").alias("x"))
    return read.select("x.*")
