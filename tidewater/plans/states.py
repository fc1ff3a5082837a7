"""Queries on small state: requests and their receipts, jobs, changes, costs, widgets, envelopes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.python import word_fold
from tidewater.operators import folds
from tidewater.plans.base import query, records
from tidewater.tables import load

_TRACK = ["id", "part", "track"]
_LINES = "l as (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) p from documents where source = 'lyrics_note' and text is not null)"


@query(rf"""with {_LINES}, c as (select doc_id, p, regexp_replace(regexp_replace(line, '\[[0-9]+:[0-9.]+\]', '', 'g'), '^[\s　]+|[\s　]+$', '', 'g') line from l)
 select doc_id, p - 1 as pos, line from c where line <> '' and not regexp_matches(line, '^(作词|作曲|编曲|[Ll]yrics|[Mm]usic)[ :：]')""")
def fn_lyric_lines(spark, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "documents", "doc_id", "source", "text").filter("source = 'lyrics_note'").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    rows = rows.withColumn("line", F.regexp_replace(F.regexp_replace("line", r"\[[0-9]+:[0-9.]+\]", ""), r"^[\s　]+|[\s　]+$", ""))
    return rows.filter((F.col("line") != "") & ~F.col("line").rlike("^(作词|作曲|编曲|[Ll]yrics|[Mm]usic)[ :：]"))


@query("""select seq, case when seq % 4 = 0 then 'vote' else 'grade' end as kind, text as question, case when seq % 4 = 0 then 3 end as total, round(content_ts, 3) as ts
 from (select distinct seq, text, content_ts from danmaku_raw where text is not null and content_ts is not null and seq % 2 = 0)""")
def widgets(spark, sf_dir: str) -> DataFrame:
    """Votes and grades among command comments; others and those whose JSON is broken are skipped."""
    rows = records(spark, sf_dir, "danmaku_raw", "text", "content_ts", where="text is not null and content_ts is not null")
    option = F.array(F.struct(F.lit("a").alias("desc"), F.lit(1).alias("cnt")), F.struct(F.lit("b").alias("desc"), F.lit(2).alias("cnt")))
    extra = F.when(F.col("seq") % 4 == 0, F.to_json(F.struct(F.col("text").alias("question"), option.alias("options")))).otherwise(F.to_json(F.struct(F.col("text").alias("msg"), F.lit(9.5).alias("avg_score"))))
    command = F.when(F.col("seq") % 4 == 0, "#VOTE#").when(F.col("seq") % 2 == 0, "#GRADE#").otherwise("#LINK#")
    made = rows.select("seq", command.alias("command"), extra.alias("extra"), F.round(F.col("content_ts") * 1000).cast("bigint").alias("progress_ms"))
    kept = made.filter(F.col("command").isin("#VOTE#", "#GRADE#"))
    shape = "question string, msg string, avg_score double, options array<struct<`desc`:string,cnt:int,has_self_def:boolean>>"
    kept = kept.withColumn("x", F.from_json("extra", shape)).filter(F.coalesce("x.question", "x.msg").isNotNull())
    total = F.aggregate("x.options", F.lit(0), lambda acc, o: acc + F.coalesce(o["cnt"], F.lit(0)))
    return kept.select("seq", F.when(F.col("command") == "#VOTE#", "vote").otherwise("grade").alias("kind"), F.coalesce("x.question", "x.msg").alias("question"), total.alias("total"), F.round(F.col("progress_ms") / 1000, 3).alias("ts"))


@query("""select id, ceil("end" - "start") * 0.25 as reserved, round(("end" - "start") * 0.25, 6) as cost, cast(ceil(50 * ("end" - "start")) as bigint) + 1024 + strlen(coalesce(title, '')) as tokens
 from (select distinct id, "start", "end", title from clip_inputs where "end" > "start")""")
def fn_call_cost(spark, sf_dir: str) -> DataFrame:
    """Cost of a call by its seconds, what is reserved for it, and the tokens it may take."""
    clips = records(spark, sf_dir, "clip_inputs", "start", "end", "title").filter(F.col("end") > F.col("start"))
    span = F.col("end") - F.col("start")
    tokens = F.ceil(span * 50) + 1024 + F.octet_length(F.coalesce("title", F.lit("")))
    return clips.select("id", (F.ceil(span) * 0.25).alias("reserved"), F.round(span * 0.25, 6).alias("cost"), tokens.alias("tokens"))


@query("""select transcript_id, coalesce(nullif(model, ''), nullif(language, '')) as target, case when language is null or language = '' then 'partial' else 'ok' end as status, case when platform like '%.example' and language <> 'zh' then 'language proxy' when not robust then 'fell back' end as note
 from (select distinct * from transcripts)""")
def fn_probe_projection(spark, sf_dir: str) -> DataFrame:
    heads = records(spark, sf_dir, "transcripts", "model", "language", "platform", "robust")
    blank = F.col("language").isNull() | (F.col("language") == "")
    note = F.when(F.col("platform").endswith(".example") & (F.col("language") != "zh"), "language proxy").when(~F.col("robust"), "fell back")
    return heads.select("transcript_id", F.coalesce(F.nullif("model", F.lit("")), F.nullif("language", F.lit(""))).alias("target"), F.when(blank, "partial").otherwise("ok").alias("status"), note.alias("note"))


@query("""select frame_id, round(list_sum(list_transform(range(1, 17), lambda i: abs(strpos('0123456789abcdef', substr(phash, i, 1)) - strpos('0123456789abcdef', substr(before, i, 1))))) / 16, 6) as difference
 from (select *, lag(phash) over (partition by id, part order by ts, frame_id) before from (select distinct frame_id, id, part, ts, phash from frames where phash is not null)) where before is not null""")
def fn_mean_difference(spark, sf_dir: str) -> DataFrame:
    """Mean absolute difference of two arrays, here the digits of neighbouring frames' hashes."""
    rows = records(spark, sf_dir, "frames", "id", "part", "ts", "phash", where="phash is not null")
    rows = rows.withColumn("before", F.lag("phash").over(Window.partitionBy("id", "part").orderBy("ts", "frame_id"))).filter("before is not null")
    digits = lambda c: F.transform(F.split(c, ""), lambda x: F.conv(x, 16, 10).cast("int"))
    gap = F.zip_with(digits("phash"), digits("before"), lambda a, b: F.abs(a - b))
    return rows.select("frame_id", F.round(F.aggregate(gap, F.lit(0), lambda acc, x: acc + x) / F.size(gap), 6).alias("difference"))


_WALK = """f as (select frame_id, id, part, ocr, cast(('0x' || left(phash, 4)) as bigint) v, row_number() over (partition by id, part order by ts, frame_id) rn from (select distinct frame_id, id, part, ts, phash, ocr from frames where phash is not null and ts is not null)),
 w as (select id, part, rn, frame_id, v last, true changed, ocr from f where rn = 1 union all
 select f.id, f.part, f.rn, f.frame_id, case when abs(f.v - w.last) >= 9000 then f.v else w.last end, abs(f.v - w.last) >= 9000, case when abs(f.v - w.last) >= 9000 then f.ocr else w.ocr end from w join f on f.id = w.id and f.part = w.part and f.rn = w.rn + 1)"""


@query(f"with recursive {_WALK} select frame_id, changed, ocr as carried from w")
def screen_change_gate(spark, sf_dir: str) -> DataFrame:
    """Frames whose picture differs enough from the last changed one; the others carry that one's text."""
    frames = records(spark, sf_dir, "frames", "id", "part", "ts", "phash", "ocr", where="phash is not null and ts is not null")
    frames = frames.withColumn("v", F.conv(F.left("phash", F.lit(4)), 16, 10).cast("bigint"))
    changed = folds.changed(frames, ["id", "part"], ["ts", "frame_id"], "v", 9000).select("frame_id", F.lit(True).alias("changed"))
    rows = frames.join(changed, "frame_id", "left").withColumn("changed", F.coalesce("changed", F.lit(False)))
    w = Window.partitionBy("id", "part").orderBy("ts", "frame_id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("frame_id", "changed", F.last(F.when(F.col("changed"), F.struct("ocr")), True).over(w)["ocr"].alias("carried"))


@query("""with f as (select distinct frame_id, id, part, ts, ocr, phash from frames where ocr <> '') select id, part, (array_agg(ocr order by phash desc, ts, frame_id))[1] as text from f where phash is not null group by id, part""")
def screen_representative(spark, sf_dir: str) -> DataFrame:
    """The text of the surest sample of a page, the first one among equals."""
    rows = records(spark, sf_dir, "frames", "id", "part", "ts", "ocr", "phash", where="ocr <> '' and phash is not null and ts is not null")
    return rows.groupBy("id", "part").agg(F.max_by("ocr", F.struct("phash", (-F.col("ts")).alias("t"), (-F.col("frame_id")).alias("f"))).alias("text"))


@query("""with t as (select distinct transcript_id, id, part, track, source from transcripts), w as (select distinct cue_id, id, part, track, text from cues where text is not null), s as (select id, part, track, md5(string_agg(text, '|' order by cue_id)) h from w group by all),
 j as (select t.transcript_id, h from t join s using (id, part, track)) select transcript_id, (select min(b.transcript_id) from j b where b.h = j.h and b.transcript_id < j.transcript_id) as earlier from j""")
def recording_sequential_dedup(spark, sf_dir: str) -> DataFrame:
    """The first earlier recording with the same content, if there is one. Content is compared by its hash."""
    words = records(spark, sf_dir, "cues", *_TRACK, "text", where="text is not null").groupBy(*_TRACK).agg(F.sort_array(F.collect_list(F.struct("cue_id", "text"))).alias("x"))
    prints = records(spark, sf_dir, "transcripts", *_TRACK).join(words.select(*_TRACK, F.md5(F.array_join("x.text", "|")).alias("h")), _TRACK)
    first = F.min("transcript_id").over(Window.partitionBy("h"))
    return prints.withColumn("first", first).select("transcript_id", F.when(F.col("first") < F.col("transcript_id"), F.col("first")).alias("earlier"))


@query("""with e as (select distinct seq, room_id, uid, event_type from live_events where uid > 0), s as (select *, lag(event_type) over (partition by room_id, uid order by seq) before from e)
 select room_id, uid, (array_agg(event_type order by seq desc))[1] as state, count(*) as steps, coalesce(bool_and(before is distinct from 'guard' or event_type <> 'system'), true) as legal from s group by room_id, uid""")
def state_machine(spark, sf_dir: str) -> DataFrame:
    """Latest state of each key and whether no step was one that isn't allowed."""
    rows = records(spark, sf_dir, "live_events", "room_id", "uid", "event_type", where="uid > 0")
    before = F.lag("event_type").over(Window.partitionBy("room_id", "uid").orderBy("seq"))
    legal = ~(before.eqNullSafe("guard") & (F.col("event_type") == "system"))
    rows = rows.withColumn("legal", legal)
    return rows.groupBy("room_id", "uid").agg(F.max_by("event_type", "seq").alias("state"), F.count("*").alias("steps"), F.bool_and("legal").alias("legal"))


@query("""with g as (select distinct seq, room_id, total_coin, cny_value from live_events where event_type = 'gift') select seq, case when cny_value is null or cny_value < 0 then 'billing_unknown' when cny_value > total_coin / 1000.0 + 1e-9 then 'over' else 'settled' end as status,
 bool_or(cny_value is null or cny_value < 0 or cny_value > total_coin / 1000.0 + 1e-9) over (partition by room_id) as blocked from g""")
def budget_settle(spark, sf_dir: str) -> DataFrame:
    """Each settled request, and whether an unknown or exceeding one blocks its ledger."""
    rows = records(spark, sf_dir, "live_events", "event_type", "room_id", "total_coin", "cny_value", where="event_type = 'gift'")
    unknown = F.col("cny_value").isNull() | (F.col("cny_value") < 0)
    over = F.col("cny_value") > F.col("total_coin") / 1000 + 1e-9
    bad = rows.withColumn("bad", F.coalesce(unknown | over, unknown))
    status = F.when(unknown, "billing_unknown").when(over, "over").otherwise("settled")
    return bad.select("seq", status.alias("status"), F.bool_or("bad").over(Window.partitionBy("room_id")).alias("blocked"))


@query("""select v.id, v.page, case when t.n > 0 then 'complete' when c.n > 0 then 'running' when v.duration is not null then 'pending' else 'failed' end as status from video_pages v left join (select id, part, count(*) n from transcripts where robust group by all) t on t.id = v.id and t.part = v.page
 left join (select id, part, count(*) n from transcripts group by all) c on c.id = v.id and c.part = v.page""")
def select_job_status(spark, sf_dir: str) -> DataFrame:
    """The state of a job by the first evidence there is: a result, a sign of life, a request."""
    heads = load(spark, sf_dir, "transcripts", "id", "part", "robust").groupBy("id", "part").agg(F.count_if("robust").alias("done"), F.count("*").alias("n"))
    rows = load(spark, sf_dir, "video_pages", "id", "page", "duration").join(heads.withColumnRenamed("part", "page"), ["id", "page"], "left")
    status = F.coalesce(F.when(F.col("done") > 0, "complete"), F.when(F.col("n") > 0, "running"), F.when(F.col("duration").isNotNull(), "pending"), F.lit("failed"))
    return rows.select("id", "page", status.alias("status"))


@query("""select transcript_id, array_to_string(list_filter([case when abs(e - v.duration) > greatest(2, v.duration * 0.02) then 'duration' end, case when n < 5 then 'cues' end, case when e > v.duration + 0.1 then 'beyond' end], lambda x: x is not null), ',') as issues
 from (select distinct transcript_id, id, part, track from transcripts) t join (select id, part, track, max("end") e, count(distinct cue_id) n from cues group by all) c using (id, part, track) join video_pages v on v.id = t.id and v.page = t.part where v.duration is not null""")
def gate_issue_flags(spark, sf_dir: str) -> DataFrame:
    """Flags of everything wrong with a track, in a fixed order."""
    pages = load(spark, sf_dir, "video_pages", "id", "page", "duration").withColumnRenamed("page", "part").filter("duration is not null")
    cues = load(spark, sf_dir, "cues", *_TRACK, "cue_id", "end").groupBy(*_TRACK).agg(F.max("end").alias("e"), F.count_distinct("cue_id").alias("n"))
    rows = records(spark, sf_dir, "transcripts", *_TRACK).join(cues, _TRACK).join(pages, ["id", "part"])
    e, d = F.col("e"), F.col("duration")
    flags = F.array_compact(F.array(F.when(F.abs(e - d) > F.greatest(F.lit(2.0), d * 0.02), "duration"), F.when(F.col("n") < 5, "cues"), F.when(e > d + 0.1, "beyond")))
    return rows.select("transcript_id", F.array_join(flags, ",").alias("issues"))


@query("""select transcript_id, fetched_at + interval 7 day <= timestamp '2025-06-01 00:00:00' as expired from (select distinct transcript_id, fetched_at from transcripts)""")
def gate_handle_expiry(spark, sf_dir: str) -> DataFrame:
    heads = records(spark, sf_dir, "transcripts", "fetched_at")
    return heads.select("transcript_id", (F.expr("fetched_at + interval 7 days <= timestamp_ntz '2025-06-01 00:00:00'")).alias("expired"))


@query("""with w as (select distinct cue_id, id, part, track, ("start" + "end") / 2 mid, lower(regexp_replace(coalesce(text, ''), '[^a-zA-Z0-9]', '', 'g')) k from cues where track in ('whisper', 'ocr')), c as (select *, floor(mid / 54) core from w),
 g as (select id, part, core, string_agg(k, '' order by mid, cue_id) filter (where track = 'whisper') a, string_agg(k, '' order by mid, cue_id) filter (where track = 'ocr') b from c group by all)
 select id, part, cast(core as bigint) as core, case when b is null then 'short_window_empty' when a is not null and a <> b then 'short_window_conflict' else 'replaced' end as outcome from g""")
def words_window_merge(spark, sf_dir: str) -> DataFrame:
    """Per core window whether its words are replaced by another recogniser's: not if there are none or they disagree."""
    rows = records(spark, sf_dir, "cues", *_TRACK, "start", "end", "text", where="track in ('whisper', 'ocr')")
    rows = rows.withColumn("mid", (F.col("start") + F.col("end")) / 2).withColumn("core", F.floor(F.col("mid") / 54)).withColumn("k", F.lower(F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-zA-Z0-9]", "")))
    said = lambda t: F.array_join(F.sort_array(F.collect_list(F.when(F.col("track") == t, F.struct("mid", "cue_id", "k"))))["k"], "")
    g = rows.groupBy("id", "part", "core").agg(said("whisper").alias("a"), said("ocr").alias("b"), F.count_if(F.col("track") == "whisper").alias("na"), F.count_if(F.col("track") == "ocr").alias("nb"))
    outcome = F.when(F.col("nb") == 0, "short_window_empty").when((F.col("na") > 0) & (F.col("a") != F.col("b")), "short_window_conflict").otherwise("replaced")
    return g.select("id", "part", "core", outcome.alias("outcome"))


@query(None)
def words_window_merge_all(spark, sf_dir: str) -> DataFrame:
    """``words_window_merge`` on the word characters of every script."""
    rows = records(spark, sf_dir, "cues", *_TRACK, "start", "end", "text", where="track in ('whisper', 'ocr')")
    rows = rows.withColumn("mid", (F.col("start") + F.col("end")) / 2).withColumn("core", F.floor(F.col("mid") / 54)).withColumn("k", word_fold(F.coalesce("text", F.lit(""))))
    said = lambda t: F.array_join(F.sort_array(F.collect_list(F.when(F.col("track") == t, F.struct("mid", "cue_id", "k"))))["k"], "")
    g = rows.groupBy("id", "part", "core").agg(said("whisper").alias("a"), said("ocr").alias("b"), F.count_if(F.col("track") == "whisper").alias("na"), F.count_if(F.col("track") == "ocr").alias("nb"))
    outcome = F.when(F.col("nb") == 0, "short_window_empty").when((F.col("na") > 0) & (F.col("a") != F.col("b")), "short_window_conflict").otherwise("replaced")
    return g.select("id", "part", "core", outcome.alias("outcome"))


@query("""with d as (select distinct seq, id, part, content_ts, text from danmaku_raw where text is not null and content_ts is not null), b as (select id, part, text, min(seq) first, max(seq) last from d group by all)
 select b.id, b.part, b.text, coalesce(d.content_ts, 0) as ts from b left join d on d.seq = b.first""")
def join_first_occurrence(spark, sf_dir: str) -> DataFrame:
    """Each wording of a page with the time of its first occurrence."""
    rows = records(spark, sf_dir, "danmaku_raw", "id", "part", "content_ts", "text", where="text is not null and content_ts is not null")
    return rows.groupBy("id", "part", "text").agg(F.min_by("content_ts", "seq").alias("ts"))


@query("""select id, '[' || string_agg('{"page":' || page || ',"ok":' || (duration is not null) || '}', ',' order by page) || ']' as envelope from video_pages group by id""")
def sink_envelope(spark, sf_dir: str) -> DataFrame:
    """Every attempted part of a video with its outcome, as one JSON document."""
    rows = load(spark, sf_dir, "video_pages", "id", "page", "duration")
    each = F.struct("page", F.col("duration").isNotNull().alias("ok"))
    return rows.groupBy("id").agg(F.to_json(F.sort_array(F.collect_list(each))).alias("envelope"))


@query("""select id, part, round("start", 3) as "start", track, text from (select distinct cue_id, id, part, "start", track, text from cues where text is not null) union all select id, part, round(ts, 3), 'ocr-frame', ocr from (select distinct frame_id, id, part, ts, ocr from frames where ocr <> '')""")
def bundle_union_timeline(spark, sf_dir: str) -> DataFrame:
    cues = records(spark, sf_dir, "cues", "id", "part", "start", "track", "text", where="text is not null").select("id", "part", F.round("start", 3).alias("start"), "track", "text")
    screen = records(spark, sf_dir, "frames", "id", "part", "ts", "ocr", where="ocr <> ''").select("id", "part", F.round("ts", 3).alias("start"), F.lit("ocr-frame").alias("track"), F.col("ocr").alias("text"))
    return cues.unionByName(screen)


@query("""select frame_id, cast(floor(1080 * 0.78) as int) as top, cast(floor(1080 * 0.96) - floor(1080 * 0.78) as int) as height, least(-16.0 - (-20.0 - part), -1.0 - 0.3 - (-6.0)) as gain from (select distinct frame_id, part from frames)""")
def fn_band_and_gain(spark, sf_dir: str) -> DataFrame:
    """The caption band of a picture in whole rows, and a gain bounded by loudness and by the true peak."""
    rows = records(spark, sf_dir, "frames", "part")
    top, bottom = (F.floor(F.lit(1080) * x).cast("int") for x in (0.78, 0.96))
    gain = F.least(F.lit(-16.0) - (F.lit(-20.0) - F.col("part")), F.lit(-1.0) - 0.3 + 6.0)
    return rows.select("frame_id", top.alias("top"), (bottom - top).alias("height"), gain.alias("gain"))
