"""Queries that assemble, inspect and check whole bundles, and choose and join their parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.python import sequence_ratio
from tidewater.functions.text import bare, clock, comparison_key, neutral_markdown, source_key, stripped
from tidewater.operators import authors, timeline
from tidewater.plans.base import query, records
from tidewater.tables import load

_TRACK = ["id", "part", "track"]


@query("""with c as (select id, part, count(*) as cues, count(distinct track) as tracks from (select distinct cue_id, id, part, track from cues) group by all),
 f as (select id, part, count(*) as frames, count(nullif(caption, '')) as captions, count(*) - count(path) as missing from (select distinct * from frames) group by all)
 select v.id, v.page as part, coalesce(cues, 0) as cues, coalesce(tracks, 0) as tracks, coalesce(frames, 0) as frames, coalesce(captions, 0) as captions, coalesce(missing, 0) as missing
 from video_pages v left join c on c.id = v.id and c.part = v.page left join f on f.id = v.id and f.part = v.page""")
def bundle_inspection(spark, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "video_pages", "id", "page").withColumnRenamed("page", "part")
    cues = records(spark, sf_dir, "cues", *_TRACK).groupBy("id", "part").agg(F.count("*").alias("cues"), F.count_distinct("track").alias("tracks"))
    frames = records(spark, sf_dir, "frames", "id", "part", "caption", "path").groupBy("id", "part").agg(
        F.count("*").alias("frames"), F.count(F.nullif("caption", F.lit(""))).alias("captions"), F.count_if(F.col("path").isNull()).alias("missing")
    )
    return pages.join(cues, ["id", "part"], "left").join(frames, ["id", "part"], "left").na.fill(0, ["cues", "tracks", "frames", "captions", "missing"])


@query("""with s as (select distinct id, part, source from cues where source is not null union select distinct id, part, 'ocr' from frames where ocr <> '') select id, part, string_agg(source, ',' order by source) as sources from s group by all""")
def bundle_source_set(spark, sf_dir: str) -> DataFrame:
    named = load(spark, sf_dir, "cues", "id", "part", "source").filter("source is not null")
    screen = load(spark, sf_dir, "frames", "id", "part", "ocr").filter("ocr <> ''").select("id", "part", F.lit("ocr").alias("source"))
    return named.unionByName(screen).groupBy("id", "part").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


@query("""with t as (select distinct cue_id, id, part, pos, "start" s, text from cues where track = 'human-sub' and text is not null and "start" is not null and not regexp_matches(text, '[\\n\\\\#*_`~-]')),
 g as (select id, part, floor(s / 60.0) * 60 w, string_agg(text, '' order by pos) body from t group by all),
 l as (select id, part, w, 0 k, '### [' || lpad(cast(cast(w as bigint) // 60 as varchar), 2, '0') || ':' || lpad(cast(cast(w as bigint) % 60 as varchar), 2, '0') || ']' line from g
 union all select id, part, w, 1, regexp_replace(body, '^[\\s　]+|[\\s　]+$', '', 'g') from g where regexp_replace(body, '[\\s　]', '', 'g') <> '' union all select id, part, w, 2, '' from g)
 select id, part, string_agg(line, chr(10) order by w, k) as body from l group by all""".replace("\\\\n", "\\n"))
def bundle_markdown(spark, sf_dir: str) -> DataFrame:
    """The transcript section of a bundle as Markdown: a line table, put together in order."""
    cues = records(spark, sf_dir, "cues", *_TRACK, "pos", "start", "text", where="track = 'human-sub' and text is not null and start is not null")
    cues = cues.filter(~F.col("text").rlike(r"[\n\\#*_`~-]")).withColumn("w", timeline.fixed_window(F.col("start"), 60.0))
    parts = F.sort_array(F.collect_list(F.struct("pos", "text")))
    chunks = cues.groupBy("id", "part", "w").agg(stripped(neutral_markdown(F.array_join(parts["text"], ""))).alias("body"))
    line = lambda k, t: F.struct(F.col("w"), F.lit(k).alias("k"), t.alias("line"))
    lines = F.array(line(0, F.concat(F.lit("### ["), clock(F.col("w")), F.lit("]"))), line(1, F.nullif("body", F.lit(""))), line(2, F.lit("")))
    rows = chunks.select("id", "part", F.explode(lines).alias("x")).filter("x.line is not null")
    return rows.groupBy("id", "part").agg(F.array_join(F.sort_array(F.collect_list("x"))["line"], "\n").alias("body"))


@query(None)
def bundle_markdown_all(spark, sf_dir: str) -> DataFrame:
    """``bundle_markdown`` of every cue with text and start of each page's track of most authority, markers neutralised."""
    cues = records(spark, sf_dir, "cues", *_TRACK, "pos", "start", "text", where="text is not null and start is not null")
    rank = F.when(F.col("track") == "human-sub", 0).when(F.col("track") == "whisper", 1).otherwise(2)
    chosen = cues.groupBy("id", "part").agg(F.min_by("track", F.struct(rank.alias("r"), "track")).alias("track"))
    cues = cues.join(chosen, _TRACK).withColumn("w", timeline.fixed_window(F.col("start"), 60.0))
    parts = F.sort_array(F.collect_list(F.struct("pos", "text")))
    chunks = cues.groupBy("id", "part", "w").agg(neutral_markdown(bare(F.array_join(parts["text"], ""))).alias("body"))
    line = lambda k, t: F.struct(F.col("w"), F.lit(k).alias("k"), t.alias("line"))
    lines = F.array(line(0, F.concat(F.lit("### ["), clock(F.col("w")), F.lit("]"))), line(1, F.nullif("body", F.lit(""))), line(2, F.lit("")))
    rows = chunks.select("id", "part", F.explode(lines).alias("x")).filter("x.line is not null")
    return rows.groupBy("id", "part").agg(F.array_join(F.sort_array(F.collect_list("x"))["line"], "\n").alias("body"))


@query("""with t as (select distinct transcript_id, id, part, track from transcripts), c as (select id, part, track, count(*)::bigint n, count(text)::bigint worded from (select distinct cue_id, id, part, track, text from cues) group by all)
 select transcript_id, '{"id":"' || id || '","part":' || part || ',"track":"' || track || '","cues":' || n || ',"worded":' || worded || '}' as document from t join c using (id, part, track)""")
def bundle_json(spark, sf_dir: str) -> DataFrame:
    counts = records(spark, sf_dir, "cues", *_TRACK, "text").groupBy(*_TRACK).agg(F.count("*").alias("cues"), F.count("text").alias("worded"))
    heads = records(spark, sf_dir, "transcripts", *_TRACK).join(counts, _TRACK)
    return heads.select("transcript_id", F.to_json(F.struct("id", "part", "track", "cues", "worded")).alias("document"))


@query("""select id, count(*) as parts, count(*) filter (where duration is not null) as ok, case when bool_and(duration is not null) then 'complete' when bool_or(duration is not null) then 'partial' else 'failed' end as status from video_pages group by id""")
def bundle_batch_status(spark, sf_dir: str) -> DataFrame:
    ok = F.col("duration").isNotNull()
    status = F.when(F.bool_and(ok), "complete").when(F.bool_or(ok), "partial").otherwise("failed")
    return load(spark, sf_dir, "video_pages", "id", "duration").groupBy("id").agg(F.count("*").alias("parts"), F.count_if(ok).alias("ok"), status.alias("status"))


@query("""select 'clip end' as rule, c.id from (select distinct * from clip_inputs) c join video_pages v on v.id = c.source and v.page = coalesce(c.part, 1) where c."end" > v.duration + 0.1 and v.duration is not null
 union all select 'clip order', id from (select distinct * from clip_inputs) where "end" <= "start" union all select 'clip start', c.id from (select distinct * from clip_inputs) c join video_pages v on v.id = c.source and v.page = coalesce(c.part, 1) where c."start" >= v.duration""")
def bundle_violations(spark, sf_dir: str) -> DataFrame:
    """Clips that break a rule, one row per rule broken."""
    clips = records(spark, sf_dir, "clip_inputs", "source", "part", "start", "end").withColumn("part", F.coalesce("part", F.lit(1)))
    pages = load(spark, sf_dir, "video_pages", "id", "page", "duration").select(F.col("id").alias("source"), F.col("page").alias("part"), "duration")
    rows = clips.join(pages, ["source", "part"], "left")
    rules = [("clip end", F.col("end") > F.col("duration") + 0.1), ("clip order", F.col("end") <= F.col("start")), ("clip start", F.col("start") >= F.col("duration"))]
    return rows.select("id", F.explode(F.array_compact(F.array(*(F.when(w, F.lit(n)) for n, w in rules)))).alias("rule")).select("rule", "id")


@query("""select 'page' as entity, count(*) = count(distinct (id, page)) as unique_keys from video_pages union all select 'cid', count(*) = count(distinct cid) from video_pages
 union all select 'phrase', count(*) = count(distinct text) from catchphrases union all select 'cue', count(*) = count(distinct cue_id) from cues""")
def bundle_unique_keys(spark, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "video_pages", "id", "page", "cid")
    check = lambda df, name, *cols: df.agg(F.lit(name).alias("entity"), (F.count("*") == F.count_distinct(*cols)).alias("unique_keys"))
    return check(pages, "page", "id", "page").unionByName(check(pages, "cid", "cid")).unionByName(check(load(spark, sf_dir, "catchphrases", "text"), "phrase", "text")).unionByName(
        check(load(spark, sf_dir, "cues", "cue_id"), "cue", "cue_id"))


@query("""with d as (select distinct seq, id, mid_hash, author from danmaku_raw), h as (select distinct seq, try_cast('0x' || mid_hash as ubigint) h from d where mid_hash <> ''),
 p as (select id, h, min(author) author from d join h using (seq) where author is not null group by all) select d.seq, p.author from d left join h using (seq) left join p on p.id = d.id and p.h = h.h""")
def join_author_roles(spark, sf_dir: str) -> DataFrame:
    """Who may have posted a comment: its poster's hash against those of the video's owner and staff, here the hashes of
    the comments known to be theirs. Hashes compare as numbers, and an owner wins over staff."""
    rows = records(spark, sf_dir, "danmaku_raw", "id", "mid_hash", "author")
    people = rows.filter("author is not null").select("id", authors.hash_number(F.col("mid_hash")).alias("poster"), F.col("author").alias("role"))
    return authors.classify_authors(rows.drop("author"), people, video="id", poster="mid_hash").select("seq", "author")


@query("""select t.transcript_id, coalesce(v.page, case when n = 1 then sole1 end) as page from (select distinct transcript_id, id, part + 1 part from transcripts) t left join video_pages v on v.id = t.id and v.page = t.part
 left join (select id, count(*) n, min(page) sole1 from video_pages group by id) o on o.id = t.id""")
def join_job_part(spark, sf_dir: str) -> DataFrame:
    """The page with the wanted number, else a video's only page."""
    wanted = records(spark, sf_dir, "transcripts", "id", "part").withColumn("page", F.col("part") + 1)
    pages = load(spark, sf_dir, "video_pages", "id", "page")
    sole = pages.groupBy("id").agg(F.count("*").alias("n"), F.min("page").alias("only"))
    hit = wanted.join(pages.withColumn("hit", F.col("page")), ["id", "page"], "left").join(sole, "id", "left")
    return hit.select("transcript_id", F.coalesce("hit", F.when(F.col("n") == 1, F.col("only"))).alias("page"))


@query("""with f as (select distinct frame_id, id, part, ts, nullif(ocr, '') ocr from frames), b as (select *, case when ocr is not null and ocr is distinct from lag(ocr) over (partition by id, part order by ts, frame_id) then 1 else 0 end nw from f),
 g as (select *, sum(nw) over (partition by id, part order by ts, frame_id rows unbounded preceding) g from b), a as (select id, part, g, min(ts) s, max(ts) l, min(ocr) text from g where ocr is not null group by all),
 e as (select *, lead(s) over (partition by id, part order by s) nx from a) select id, part, round(s, 3) as "start", round(coalesce(nx, l + 6), 3) as "end", text from e where coalesce(nx, l + 6) - s >= 0.3""")
def screen_cues(spark, sf_dir: str) -> DataFrame:
    """On-screen texts as cues: equal neighbours are one, each ends where the next one starts, even across a blank."""
    rows = records(spark, sf_dir, "frames", "id", "part", "ts", "ocr").withColumn("ocr", F.nullif("ocr", F.lit("")))
    w = Window.partitionBy("id", "part").orderBy("ts", "frame_id")
    fresh = F.col("ocr").isNotNull() & ~F.col("ocr").eqNullSafe(F.lag("ocr").over(w))
    rows = rows.withColumn("nw", fresh.cast("int")).withColumn("g", F.sum("nw").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("ocr is not null")
    cues = rows.groupBy("id", "part", "g").agg(F.min("ts").alias("s"), F.max("ts").alias("l"), F.min("ocr").alias("text"))
    end = F.coalesce(F.lead("s").over(Window.partitionBy("id", "part").orderBy("s")), F.col("l") + 6)
    return cues.withColumn("e", end).filter(F.col("e") - F.col("s") >= 0.3).select("id", "part", F.round("s", 3).alias("start"), F.round("e", 3).alias("end"), "text")


@query(None)
def screen_cues_near(spark, sf_dir: str) -> DataFrame:
    """``screen_cues`` where a text goes on with the one seen just before from a ratio of 0.80 on; a blank ends it. Its first text
    stands for it, the tables holding no confidence."""
    rows = records(spark, sf_dir, "frames", "id", "part", "ts", "ocr").withColumn("ocr", F.nullif("ocr", F.lit("")))
    w = Window.partitionBy("id", "part").orderBy("ts", "frame_id")
    rows = rows.withColumn("before", F.lag("ocr").over(w)).filter("ocr is not null")
    alike = sequence_ratio(source_key(F.col("before"), False), source_key(F.col("ocr"), False)) >= 0.80
    rows = rows.withColumn("alike", alike).withColumn("nw", F.when(F.col("alike"), 0).otherwise(1))
    rows = rows.withColumn("g", F.sum("nw").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    cues = rows.groupBy("id", "part", "g").agg(F.min("ts").alias("s"), F.max("ts").alias("l"), bare(F.min_by("ocr", F.struct("ts", "frame_id"))).alias("text"))
    end = F.coalesce(F.lead("s").over(Window.partitionBy("id", "part").orderBy("g")), F.col("l") + 6)
    return cues.withColumn("e", end).filter("e - s >= 0.3 and text <> ''").select("id", "part", F.round("s", 3).alias("start"), F.round("e", 3).alias("end"), "text")


@query("""select id, part, count(*) as sampled, count(nullif(ocr, '')) as positive, count(*) >= 3 and count(nullif(ocr, '')) / count(*) >= 0.40 as burned_in from (select distinct frame_id, id, part, ocr from frames) group by all""")
def screen_verdict(spark, sf_dir: str) -> DataFrame:
    n, p = F.count("*"), F.count(F.nullif("ocr", F.lit("")))
    return records(spark, sf_dir, "frames", "id", "part", "ocr").groupBy("id", "part").agg(n.alias("sampled"), p.alias("positive"), ((n >= 3) & (p / n >= 0.40)).alias("burned_in"))


_COVER = """n as (select id, page part, ceil(duration * 10)::bigint cells from video_pages where duration > 0),
 c as (select distinct f.id, f.part, least(round_even(ts * 10, 0)::bigint, cells) s, least(round_even((ts + 6) * 10, 0)::bigint, cells) e, cells from frames f join n using (id, part) where ts is not null),
 g as (select *, greatest(0, s - coalesce(max(e) over (partition by id, part order by s, e rows between unbounded preceding and 1 preceding), 0)) gap from c)"""


@query(f"""with {_COVER} select id, part, round((cells - sum(gap) - (cells - max(e))) / cells, 4) as coverage, greatest(max(gap), cells - max(e)) / 10.0 as longest_gap from g group by id, part, cells""")
def recording_coverage(spark, sf_dir: str) -> DataFrame:
    """Share of a page's tenths of a second that lie in a matching window of six seconds, here one at every frame, and its
    longest stretch without a match, in seconds; by the windows' ends, without a row per tenth."""
    pages = load(spark, sf_dir, "video_pages", "id", "page", "duration").filter("duration > 0").select("id", F.col("page").alias("part"), F.ceil(F.col("duration") * 10).alias("cells"))
    rows = records(spark, sf_dir, "frames", "id", "part", "ts", where="ts is not null").join(pages, ["id", "part"])
    cell = lambda x: F.least(F.bround(x * 10).cast("bigint"), F.col("cells"))
    rows = rows.select("id", "part", "cells", cell(F.col("ts")).alias("s"), cell(F.col("ts") + 6).alias("e")).distinct()
    before = F.max("e").over(Window.partitionBy("id", "part").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("gap", F.greatest(F.lit(0), F.col("s") - F.coalesce(before, F.lit(0))))
    tail = F.col("cells") - F.max("e")
    return rows.groupBy("id", "part", "cells").agg(
        F.round((F.col("cells") - F.sum("gap") - tail) / F.col("cells"), 4).alias("coverage"), (F.greatest(F.max("gap"), tail) / 10.0).alias("longest_gap")
    ).drop("cells")


@query("""with t as (select distinct transcript_id, platform, part, robust, language from transcripts) select platform, max(case when language is null then 2 when not robust then 1 else 0 end) as worst, count(*) filter (where language is null) as errors,
 count(*) filter (where language is not null and not robust) as warnings from t group by platform""")
def severity_rollup(spark, sf_dir: str) -> DataFrame:
    rank = F.when(F.col("language").isNull(), 2).when(~F.col("robust"), 1).otherwise(0)
    rows = records(spark, sf_dir, "transcripts", "platform", "robust", "language").withColumn("rank", rank)
    return rows.groupBy("platform").agg(F.max("rank").alias("worst"), F.count_if(F.col("rank") == 2).alias("errors"), F.count_if(F.col("rank") == 1).alias("warnings"))


@query("""with t as (select distinct id, part, track, source, language from transcripts), r as (select *, case track when 'human-sub' then 0 when 'whisper' then 1 else 2 end rk from t)
 select id, part, coalesce(max(case when track = 'human-sub' then language end), max(case when track = 'whisper' then language end)) as language, (array_agg(track order by rk, track))[1] as authority from r group by id, part""")
def select_authority(spark, sf_dir: str) -> DataFrame:
    """The track with most authority, which isn't the order in which tracks are tried."""
    rows = load(spark, sf_dir, "transcripts", *_TRACK, "source", "language").distinct()
    rank = F.when(F.col("track") == "human-sub", 0).when(F.col("track") == "whisper", 1).otherwise(2)
    of = lambda t: F.max(F.when(F.col("track") == t, F.col("language")))
    return rows.groupBy("id", "part").agg(F.coalesce(of("human-sub"), of("whisper")).alias("language"), F.min_by("track", F.struct(rank.alias("r"), "track")).alias("authority"))


@query("""with l as (select doc_id, text from documents where text is not null), x as (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) p from l) select doc_id, line, min(p)::bigint - 1 as pos from x where line <> '' group by doc_id, line""")
def distinct_lines(spark, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return rows.filter("line <> ''").groupBy("doc_id", "line").agg(F.min("pos").alias("pos"))


# The words of talk with an audience.
CHAT = ["充电", "表情包", "舰长", "上舰", "super chat", "弹幕", "点歌", "直播间", "粉丝牌", "下播", "开播", "主播", "礼物", "麦克风", "歌单"]
_CHAT = " + ".join(f"contains(lower(text), '{x}')::int" for x in CHAT)


@query(f"""select kind, row_id, n, n >= 2 as suspect from (select kind, row_id, {_CHAT} n from (select distinct 'cue' kind, cue_id row_id, text from cues where text is not null
 union select distinct 'danmaku', seq, text from danmaku_raw where text is not null)) where n > 0""")
def review_suspects(spark, sf_dir: str) -> DataFrame:
    """Lines with words of talk with an audience; from two different ones on they are suspected of being chat."""
    n = sum((F.lower("text").contains(x).cast("int") for x in CHAT), F.lit(0))
    cues = records(spark, sf_dir, "cues", "text").select(F.lit("cue").alias("kind"), F.col("cue_id").alias("row_id"), "text")
    crowd = records(spark, sf_dir, "danmaku_raw", "text").select(F.lit("danmaku").alias("kind"), F.col("seq").alias("row_id"), "text")
    rows = cues.unionByName(crowd).filter("text is not null").select("kind", "row_id", n.alias("n")).filter("n > 0")
    return rows.withColumn("suspect", F.col("n") >= 2)


@query(None)
def neighbour_similarity(spark, sf_dir: str) -> DataFrame:
    """Share of matching characters of each cue and the one before; the tests hold it against a plain loop."""
    w = Window.partitionBy(*_TRACK).orderBy("pos")
    rows = records(spark, sf_dir, "cues", *_TRACK, "pos", "text").withColumn("k", comparison_key(F.coalesce("text", F.lit(""))))
    rows = rows.withColumn("before", F.lag("k").over(w)).filter("before is not null")
    return rows.select("cue_id", F.round(sequence_ratio("k", "before"), 6).alias("ratio"))


@query("""select part, track, count(*) as n, grouping(part) as all_parts, grouping(track) as all_tracks from (select distinct cue_id, part, track from cues) group by cube (part, track)""", name="ext_cube")
def ext_cube(spark, sf_dir: str) -> DataFrame:
    """An extension: totals over every combination of the keys."""
    rows = records(spark, sf_dir, "cues", "part", "track")
    return rows.cube("part", "track").agg(F.count("*").alias("n"), F.grouping("part").cast("bigint").alias("all_parts"), F.grouping("track").cast("bigint").alias("all_tracks"))


@query("""select room_id, min(timestamp) as s, count(*) as n from (select *, sum(nw) over (partition by room_id order by timestamp, seq rows unbounded preceding) g from (select *, case when timestamp - lag(timestamp) over (partition by room_id order by timestamp, seq) < 3600 then 0 else 1 end nw
 from (select distinct seq, room_id, timestamp from live_events where timestamp is not null))) group by room_id, g""")
def ext_sessions(spark, sf_dir: str) -> DataFrame:
    """An extension: sessions of a room that end after an hour without an event."""
    rows = records(spark, sf_dir, "live_events", "room_id", "timestamp", where="timestamp is not null").withColumn("at", F.timestamp_micros(F.round(F.col("timestamp") * 1e6).cast("bigint")))
    return rows.groupBy("room_id", F.session_window("at", "1 hour")).agg(F.min("timestamp").alias("s"), F.count("*").alias("n")).select("room_id", "s", "n")
