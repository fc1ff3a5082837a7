"""Queries that apply the scalar functions to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions import media, text
from tidewater.operators.quality import DISTRUST
from tidewater.plans.base import query, records
from tidewater.tables import load

_PUNCT = text.PUNCTUATION_CLASS.replace("'", "''")
_CUES = "(select distinct * from cues)"
_URL = """(select id, page, 'https://www.video.example/video/' || id || '?from=list&p=' || page || '&t=3' url from video_pages)"""


@query(f"""select cue_id, lpad(cast(cast(round_even("start", 0) as bigint) // 60 as varchar), cast(greatest(2, length(cast(cast(round_even("start", 0) as bigint) // 60 as varchar))) as integer), '0')
 || ':' || lpad(cast(cast(round_even("start", 0) as bigint) % 60 as varchar), 2, '0') as clock from {_CUES}""")
def fn_clock(spark, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir, "cues", "start").select("cue_id", text.clock(F.col("start")).alias("clock"))


@query(r"""select doc_id, regexp_replace(text, '(?m)^([^\S\n]*)(#{1,6}|-{3,}|\*{3,}|_{3,}|`{3,}|~{3,})', '\1\\\2', 'g') as body from documents""")
def fn_neutral_markdown(spark, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", text.neutral_markdown(F.col("text")).alias("body"))


@query("""select seq, case when high_like and author = 'owner' then '👍 UP主? ' when high_like and author = 'staff' then '👍 合作? ' when high_like then '👍 '
 when author = 'owner' then 'UP主? ' when author = 'staff' then '合作? ' else '' end as pills from (select distinct * from danmaku_raw)""")
def fn_pills(spark, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir, "danmaku_raw", "high_like", "author").select("seq", text.pills(F.col("high_like"), F.col("author")).alias("pills"))


@query(r"""select id, trim(regexp_replace(regexp_replace(coalesce(title, ''), '[\\/:*?"<>|\r\n\t]', ' ', 'g'), '[\s　]+', ' ', 'g'), ' .') as file_name from (select distinct * from clip_inputs)""")
def fn_file_name(spark, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir, "clip_inputs", "title").select("id", text.file_name(F.col("title")).alias("file_name"))


@query("""select transcript_id, case when source_reason is null or source_reason = '' then source when starts_with(source_reason, source) then source_reason
 else source || ' (' || source_reason || ')' end as note from (select distinct * from transcripts)""")
def fn_source_note(spark, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir, "transcripts", "source", "source_reason")
    reason, source = F.col("source_reason"), F.col("source")
    note = F.when(reason.isNull() | (reason == ""), source).when(reason.startswith(source), reason).otherwise(F.concat(source, F.lit(" ("), reason, F.lit(")")))
    return rows.select("transcript_id", note.alias("note"))


@query("""with f as (select distinct * from frames), p as (select *, lag(phash) over (partition by id, part order by ts, frame_id) before from f)
select frame_id, bit_count(xor(cast(('0x' || phash) as ubigint), cast(('0x' || before) as ubigint))) as distance from p where before is not null and phash is not null""")
def fn_hamming(spark, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir, "frames", "id", "part", "ts", "phash")
    before = F.lag("phash").over(Window.partitionBy("id", "part").orderBy("ts", "frame_id"))
    rows = rows.withColumn("before", before).filter("before is not null and phash is not null")
    return rows.select("frame_id", text.hamming(text.phash_bits(F.col("phash")), text.phash_bits(F.col("before"))).alias("distance"))


@query(rf"""select cue_id, length(text) as chars, len(regexp_extract_all(text, '[一-\x{{9fff}}]')) as cjk, len(regexp_extract_all(text, '{_PUNCT}')) as punctuation,
 len(regexp_extract_all(text, '{text.DIGITS}')) as digits, len(regexp_extract_all(text, '{text.SPACES}')) as spaces from {_CUES}""")
def fn_char_profile(spark, sf_dir: str) -> DataFrame:
    c = F.col("text")
    return records(spark, sf_dir, "cues", "text").select(
        "cue_id", F.length(c).alias("chars"), text.cjk_count(c).alias("cjk"), text.count_class(c, text.PUNCTUATION_CLASS).alias("punctuation"),
        text.count_class(c, text.DIGITS).alias("digits"), text.count_class(c, text.SPACES).alias("spaces"),
    )


_EDGE = text.EDGE.replace("'", "''")


@query(rf"""select cue_id, lower(trim(regexp_replace(text, '[\s　]+', '', 'g'), '{_EDGE};*')) as speech_key, trim(regexp_replace(text, '[\s　]+', '', 'g'), '{_EDGE};') as ocr_key from {_CUES}""")
def fn_comparison_keys(spark, sf_dir: str) -> DataFrame:
    c = F.col("text")
    return records(spark, sf_dir, "cues", "text").select("cue_id", text.comparison_key(c).alias("speech_key"), text.comparison_key(c, False).alias("ocr_key"))


@query("""select transcript_id, regexp_replace(language, '^ai-', '') as track_language, split_part(language, '-', 1) as base,
 regexp_full_match(language, '[A-Za-z]+(-([A-Za-z]{4}|[A-Za-z]{2}|[0-9]{3}))*') as clean,
 case when starts_with(language, 'ai-') then case when regexp_full_match(substr(language, 4), '[a-z]{2,3}(-[A-Za-z]{2,8})*') then 'auto-sub' end
  when regexp_full_match(language, '[a-z]{2,3}(-[A-Za-z]{2,8})*') then 'human-sub' end as kind from (select distinct * from transcripts)""")
def fn_track_language(spark, sf_dir: str) -> DataFrame:
    tag = F.col("language")
    return records(spark, sf_dir, "transcripts", "language").select(
        "transcript_id", text.language_of_key(tag).alias("track_language"), text.base_language(tag).alias("base"), text.clean_tag(tag).alias("clean"), text.track_kind(tag).alias("kind")
    )


@query(f"""select id, page, id as video_id, page as part, split_part(url, '?', 1) || '?from=list&t=3&p=' || (page + 1) as next_part,
 regexp_extract(url, '//([^/?]+)', 1) as host, 'www.video.example' like '%video.example' as trusted from {_URL}""")
def fn_url_identity(spark, sf_dir: str) -> DataFrame:
    url = F.concat(F.lit("https://www.video.example/video/"), "id", F.lit("?from=list&p="), F.col("page").cast("string"), F.lit("&t=3"))
    rows = load(spark, sf_dir, "video_pages", "id", "page").withColumn("url", media.url_in(F.concat(F.lit("see "), url, F.lit(" now"))))
    who = media.video_identity(F.col("url"))
    return rows.select(
        "id", "page", who["id"].alias("video_id"), who["part"].alias("part"), media.part_address(F.col("url"), F.col("page") + 1).alias("next_part"),
        media.url_host(F.col("url")).alias("host"), media.on_host(F.col("url"), "video.example").alias("trusted"),
    )


@query("""select id, page, substr(sha1(id), 1, 11) as watch_id from video_pages""")
def fn_watch_identity(spark, sf_dir: str) -> DataFrame:
    code = F.substring(F.sha1("id"), 1, 11)
    forms = F.array(
        F.concat(F.lit("https://youtu.be/"), code, F.lit("?t=1")), F.concat(F.lit("https://www.youtube.com/watch?list=x&v="), code),
        F.concat(F.lit("https://www.youtube.com/shorts/"), code),
    )
    rows = load(spark, sf_dir, "video_pages", "id", "page").withColumn("url", F.get(forms, F.col("page") % 3))
    return rows.select("id", "page", media.watch_identity(F.col("url")).alias("watch_id"))


@query("""select seq, strftime(make_timestamp(cast(floor(timestamp) as bigint) * 1000000) + interval 8 hour, '%Y-%m-%dT%H:%M:%S') || '+08:00' as iso,
 floor(timestamp) as again from (select distinct seq, timestamp from live_events where timestamp is not null and timestamp <> 0)""")
def fn_iso_time(spark, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir, "live_events", "timestamp", where="timestamp is not null and timestamp <> 0")
    millis = F.floor("timestamp") * 1000.0
    return rows.select("seq", media.iso_time(F.col("timestamp")).alias("iso"), media.epoch_seconds(millis).alias("again"))


@query("""select transcript_id, strftime(fetched_at, '%Y-%m-%d') as day from (select distinct transcript_id, fetched_at from transcripts)""")
def fn_iso_date(spark, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir, "transcripts", "fetched_at").select("transcript_id", media.iso_date(F.date_format("fetched_at", "yyyyMMdd")).alias("day"))


@query("""select seq, case when coin_type = 'gold' then round(total_coin / 1000.0, 2) else 0.0 end as worth from (select distinct * from live_events) where event_type = 'gift'""")
def fn_gift_value(spark, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir, "live_events", "event_type", "coin_type", "total_coin", where="event_type = 'gift'")
    return rows.select("seq", media.gift_value(F.col("coin_type"), F.col("total_coin")).alias("worth"))


@query("""select seq, case when guard_level between 1 and 3 then guard_level else 3 end as level, round(cny_value * 1000 / num, 3) as price, round(round(cny_value * 1000 / num, 3) * num / 1000, 2) as worth
 from (select distinct * from live_events) where event_type = 'guard'""")
def fn_guard_value(spark, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir, "live_events", "event_type", "guard_level", "cny_value", "num", where="event_type = 'guard'")
    rows = rows.withColumn("price", F.round(F.col("cny_value") * 1000 / F.col("num"), 3))
    return rows.select("seq", media.guard_level(F.col("guard_level")).alias("level"), "price", F.round(F.col("price") * F.col("num") / 1000, 2).alias("worth"))


@query(None)
def fn_poster_hash(spark, sf_dir: str) -> DataFrame:
    """CRC-32 is no function of the SQL engine; the tests hold it against zlib."""
    return load(spark, sf_dir, "live_events", "uid").filter("uid > 0").distinct().select("uid", media.poster_hash(F.col("uid")).alias("poster"))


@query("""select transcript_id, platform || ':' || id || ':' || part || '#' || substr(sha1(track), 1, 10) as stage_key,
 sha256(platform || '|' || id || '|' || part || '|' || track) as identity from (select distinct * from transcripts)""")
def fn_stage_key(spark, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir, "transcripts", "platform", "id", "part", "track")
    key = media.stage_key(F.col("platform"), F.col("id"), F.col("part"), F.col("track"))
    return rows.select("transcript_id", key.alias("stage_key"), F.sha2(F.concat_ws("|", "platform", "id", "part", "track"), 256).alias("identity"))


@query("""select seq, case when secret = '' then '<none>' when length(secret) <= 8 then '***' else substr(secret, 1, 4) || '...' || right(secret, 4) end as masked,
 'key [key] at [url] with bearer [token]' as redacted from (select distinct seq, coalesce(mid_hash, '') || substr(id, 1, part % 5) secret from danmaku_raw)""")
def fn_redaction(spark, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir, "danmaku_raw", "mid_hash", "id", "part")
    secret = F.concat(F.coalesce("mid_hash", F.lit("")), F.substring(F.col("id"), F.lit(1), F.col("part") % 5))
    leak = F.concat(F.lit("key sk-"), F.sha1("id"), F.lit(" at https://x.example/"), F.col("id"), F.lit(" with Bearer "), F.md5("id"))
    return rows.select("seq", text.masked(secret).alias("masked"), text.redacted(leak).alias("redacted"))


@query("""select id, part, w, text, n::integer as n from (select id, part, floor(content_ts / 15)::bigint w, text, count(*) n from (select distinct seq, id, part, content_ts, text from danmaku_raw where text is not null and content_ts is not null) group by all)""")
def fn_json_array(spark, sf_dir: str) -> DataFrame:
    """The lines of a window as a model would answer them, among its thoughts and remarks, read back."""
    rows = records(spark, sf_dir, "danmaku_raw", "id", "part", "content_ts", "text", where="text is not null and content_ts is not null")
    lines = rows.groupBy("id", "part", F.floor(F.col("content_ts") / 15).alias("w"), "text").agg(F.count("*").cast("int").alias("count"))
    answers = lines.groupBy("id", "part", "w").agg(F.to_json(F.collect_list(F.struct("text", "count"))).alias("said"))
    answer = F.concat(F.lit("<think>[no] <b></think>\nHere: "), "said", F.lit(" done"))
    read = answers.select("id", "part", "w", F.explode(text.json_array_in(answer)).alias("x"))
    return read.select("id", "part", "w", "x.text", F.col("x.count").alias("n"))


@query("""select frame_id, nullif(trim(ocr), '') as ocr_text, nullif(trim(caption), '') as description from (select distinct * from frames)""")
def fn_vision_split(spark, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir, "frames", "ocr", "caption")
    said = F.concat(F.lit("OCR: "), F.coalesce("ocr", F.lit("NONE")), F.lit("\nDESCRIPTION: "), F.coalesce("caption", F.lit("none")))
    return rows.select("frame_id", text.labelled_part(said, "OCR", "DESCRIPTION").alias("ocr_text"), text.labelled_part(said, "DESCRIPTION", None).alias("description"))


@query("""select id, page, case page % 5 when 0 then 'precondition' when 1 then 'missing' when 2 then 'refused' when 3 then 'timeout' else 'unknown' end as cause from video_pages""")
def fn_failure_code(spark, sf_dir: str) -> DataFrame:
    said = F.array(*map(F.lit, ["x: HTTP Error 412: no", "HTTP Error 404", "HTTP Error 403: Forbidden", "read timed out", "odd"]))
    return load(spark, sf_dir, "video_pages", "id", "page").select("id", "page", media.failure_code(F.get(said, F.col("page") % 5)).alias("cause"))


@query("""select frame_id, path as safe, case when path is not null then null end as unsafe from (select distinct * from frames)""")
def fn_contained_path(spark, sf_dir: str) -> DataFrame:
    out = media.contained_path(F.concat(F.lit("../"), "path")).alias("unsafe")
    return records(spark, sf_dir, "frames", "path").select("frame_id", media.contained_path(F.col("path")).alias("safe"), out)


@query("""select cue_id, '[' || lpad(cast(t // 6000 as varchar), cast(greatest(2, length(cast(t // 6000 as varchar))) as integer), '0') || ':' || lpad(cast(t % 6000 // 100 as varchar), 2, '0') || '.' || lpad(cast(t % 100 as varchar), 2, '0') || ']' || translate(regexp_replace(text, '[\r\n]+', ' ', 'g'), '[]', '［］') as line
 from (select distinct cue_id, text, cast(round_even("start" * 100, 0) as bigint) t from cues where text is not null)""")
def sink_lrc_lines(spark, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir, "cues", "start", "text", where="text is not null")
    return rows.select("cue_id", F.concat(media.lrc_stamp(F.col("start")), media.lrc_text(F.col("text"))).alias("line"))


@query(f"""select cue_id, regexp_matches(text, '{DISTRUST}') as acts from {_CUES} where text is not null""")
def fn_keyword_guard(spark, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir, "cues", "text", where="text is not null").select("cue_id", F.col("text").rlike(DISTRUST).alias("acts"))
