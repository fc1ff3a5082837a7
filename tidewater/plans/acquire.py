"""Queries on how a transcript is acquired: what is offered, which track is taken, what speaks against it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions.python import near_copy
from tidewater.functions.text import bare
from tidewater.operators import acquire, quality
from tidewater.plans.base import query, records
from tidewater.plans.trust import _METRICS
from tidewater.sources import metadata
from tidewater.tables import load

_PAGE, _TRACK = ["id", "part"], ["id", "part", "track"]
_ORDER = [*((k, "human-sub") for k in acquire.HUMAN_CHINESE), *((k, t) for k in acquire.AUTO_CHINESE + acquire.OTHERS for t in ("human-sub", "auto-sub"))]
_RANK = "case " + " ".join(f"when language = '{k}' and track = '{t}' then {i}" for i, (k, t) in enumerate(_ORDER)) + " end"
_CHINESE = ", ".join(f"'{k}'" for k in acquire.HUMAN_CHINESE + acquire.AUTO_CHINESE)
_OFFER = rf"""bd as (select id, part, track, string_agg(coalesce(text, ''), '' order by pos) body from (select distinct id, part, track, pos, text from cues) group by all),
 of as (select h.id, h.part, h.track, language as key, {_RANK} rank, case when language in ({_CHINESE}) then nullif(regexp_extract(body, '{acquire.REDACTED}'), '') end marker
  from (select distinct id, part, track, language from transcripts where track in ('human-sub', 'auto-sub')) h left join bd using (id, part, track)),
 tr as (select * from (select *, row_number() over (partition by id, part, key order by rank) n from of where rank is not null) where n = 1 or key = 'ai-zh'),
 tk as (select id, part, min(rank) filter (where marker is null) taken from tr group by all),
 wk as (select tr.id, tr.part, max(case when rank = taken then key end) as key, max(case when rank = taken then case when key in ('zh-Hans', 'zh-CN', 'zh') then 'human-sub' else 'auto-sub' end end) as source,
  max(case when rank = taken then track end) as track,
  coalesce(string_agg(key || ' (' || marker || ')', ', ' order by rank) filter (where marker is not null and (taken is null or rank < taken)), '') as rejected,
  coalesce(bool_or(marker is not null and (taken is null or rank < taken)), false) and coalesce(max(case when rank = taken then regexp_replace(key, '^ai-', '') <> 'zh' end), false) as proxy
  from tr join tk using (id, part) group by tr.id, tr.part)"""


def _bodies(spark, sf_dir: str) -> DataFrame:
    cues = records(spark, sf_dir, "cues", *_TRACK, "pos", "text")
    whole = cues.groupBy(*_TRACK).agg(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("text", F.lit("")).alias("t")))).alias("x"))
    return whole.select(*_TRACK, F.array_join("x.t", "").alias("body"))


def _offered(spark, sf_dir: str) -> DataFrame:
    heads = records(spark, sf_dir, "transcripts", *_TRACK, "language", where="track in ('human-sub', 'auto-sub')").drop("transcript_id")
    rows = heads.join(_bodies(spark, sf_dir), _TRACK, "left").withColumnRenamed("language", "key")
    rank = acquire.preference(F.col("key"), F.col("track") == "human-sub")
    return rows.withColumn("rank", rank).withColumn("marker", acquire.marker(F.col("key"), F.col("body")))


@query(f"with {_OFFER} select id, part, track, rank from of where rank is not null")
def select_preference(spark, sf_dir: str) -> DataFrame:
    """Place of every offered track in the order in which tracks are tried."""
    return _offered(spark, sf_dir).filter("rank is not null").select(*_TRACK, "rank")


@query(f"with {_OFFER} select id, part, key, source, rejected, proxy from wk")
def probe_acquire(spark, sf_dir: str) -> DataFrame:
    """The first usable track of every page and the trail of those rejected before it."""
    return acquire.walk(_offered(spark, sf_dir), _PAGE)


def _taken(spark, sf_dir: str) -> DataFrame:
    """The track taken for each page with its metrics, body and duration."""
    tracks = _offered(spark, sf_dir)
    chosen = acquire.walk(tracks, _PAGE)
    rank = tracks.filter("rank is not null and marker is null").groupBy(*_PAGE, "key").agg(F.min_by("track", "rank").alias("track"), F.min_by("body", "rank").alias("body"))
    cues = records(spark, sf_dir, "cues", *_TRACK, "end", "text")
    pages = load(spark, sf_dir, "video_pages", "id", "page", "duration").withColumnRenamed("page", "part")
    return chosen.join(rank, [*_PAGE, "key"], "left").join(quality.track_metrics(cues, _TRACK), _TRACK, "left").join(pages, _PAGE, "left")


@query(f"""with {_METRICS}, {_OFFER}, fin as (select p.id, p.page part, wk.key, wk.source, wk.track, wk.id is not null offered, mt.last_end, p.duration,
  case when wk.id is null then 'no track offered' when wk.key is null then 'every track rejected' when coalesce(mt.n, 0) = 0 then 'no cues'
   when p.duration > 0 and mt.last_end / p.duration not between 0.70 and 1.10 then 'duration' end probe from video_pages p left join wk on wk.id = p.id and wk.part = p.page left join mt on mt.id = wk.id and mt.part = wk.part and mt.track = wk.track),
 dec as (select fin.*, mt.chars, mt.punct, mt.n, mt.d, mt.digits, mt.cjk, mt.spaces, not contains(key, 'zh') fgn from fin left join mt using (id, part, track)),
 jd as (select *, probe is null and ((source <> 'auto-sub' and case when chars > 0 then punct / chars else 0.0 end < 0.04) or (n - d) / n > 0.30
   or (not fgn and chars > spaces and (chars - spaces - cjk - punct - digits) / (chars - spaces) > 0.20) or coalesce(case when duration > 0 then case when fgn then chars / duration > 40 else chars / duration not between 1 and 8 end end, false)) gated from dec)
 select id, part, case when probe is null and not gated then source else 'whisper' end as source, case when probe is null and not gated then key end as language, case when probe is not null then probe when gated then 'quality gate' else 'accepted' end as reason from jd""")
def select_transcript(spark, sf_dir: str) -> DataFrame:
    """What a page's transcript is taken from: the first usable track if it ends where the video does and passes the quality
    gate, else speech recognition, with the reason."""
    pages = load(spark, sf_dir, "video_pages", "id", "page").withColumnRenamed("page", "part")
    rows = pages.join(_taken(spark, sf_dir).withColumn("offered", F.lit(True)), _PAGE, "left")
    rows = quality.gate(rows, source=F.col("source"), language=F.col("key"), duration=F.col("duration"))
    reason = (
        F.when(F.col("offered").isNull(), "no track offered").when(F.col("key").isNull(), "every track rejected").when(F.coalesce("n", F.lit(0)) == 0, "no cues")
        .when(~acquire.sane(F.col("last_end"), F.col("duration")), "duration").when(~F.col("passed"), "quality gate").otherwise("accepted")
    )
    ok = reason == "accepted"
    return rows.select(*_PAGE, F.when(ok, F.col("source")).otherwise("whisper").alias("source"), F.when(ok, F.col("key")).alias("language"), reason.alias("reason"))


@query(None)
def probe_result(spark, sf_dir: str) -> DataFrame:
    """The whole probe of every page: the track taken, unless it has no cues, ends elsewhere than the video, or repeats the
    one of the first part, equal or with a ratio of 0.90."""
    taken = _taken(spark, sf_dir).withColumn("body", bare("body"))
    first = taken.filter("part = 1").select("id", F.col("body").alias("first"))
    rows = taken.join(first, "id", "left").withColumn("again", (F.col("part") > 1) & near_copy("body", "first"))
    reason = (
        F.when(F.col("key").isNull(), "every track rejected").when(F.coalesce("n", F.lit(0)) == 0, "no cues").when(~acquire.sane(F.col("last_end"), F.col("duration")), "duration")
        .when(F.col("again"), "same as part 1").otherwise("found")
    )
    return rows.select(*_PAGE, "key", "source", "rejected", (reason == "found").alias("found"), reason.alias("reason"), "last_end")


_TARGET = "en"


@query(f"""with {_METRICS}, h as (select distinct id, part, language key from transcripts where track = 'human-sub' and (language = '{_TARGET}' or (split_part(language, '-', 1) = '{_TARGET}' and regexp_full_match(language, '[A-Za-z]+(-([A-Za-z]{{4}}|[A-Za-z]{{2}}|[0-9]{{3}}))*')))),
 a as (select distinct id, part, case when starts_with(language, 'ai-') then substr(language, 4) || '-orig' else language end key from transcripts where track = 'auto-sub' and language is not null),
 au as (select * from a where split_part(key, '-', 1) = '{_TARGET}'), ht as (select h.* from h join mt on mt.id = h.id and mt.part = h.part and mt.track = 'human-sub'),
 nt as (select au.id, au.part, key, case when mt.n is null or mt.n < 5 then 'cues' when duration is null or duration <= 0 then 'passed' when last_end / duration not between 0.70 and 1.10 then 'coverage' when chars / duration < 0.5 then 'speed' else 'passed' end why
  from au left join mt on mt.id = au.id and mt.part = au.part and mt.track = 'auto-sub' left join video_pages v on v.id = au.id and v.page = au.part)
 select v.id, v.page as part, case when ht.key is not null then 'human-sub' when nt.why = 'passed' then 'auto-sub' else 'whisper' end as source, coalesce(ht.key, case when nt.why = 'passed' then regexp_replace(nt.key, '-orig$', '') end) as language,
  case when ht.key = '{_TARGET}' then 'exact key' when ht.key is not null then 'base language' when nt.why = 'passed' then 'net passed' when nt.why is not null then nt.why else 'no track' end as reason
 from video_pages v left join ht on ht.id = v.id and ht.part = v.page left join nt on nt.id = v.id and nt.part = v.page""")
def select_original_captions(spark, sf_dir: str) -> DataFrame:
    """The other provider's rule for a wanted language: people's captions under its key or a clean variant of it, else the
    original automatic ones if they pass the structural net, else speech recognition."""
    heads = records(spark, sf_dir, "transcripts", *_TRACK, "language", where="language is not null").drop("transcript_id")
    pages = load(spark, sf_dir, "video_pages", "id", "page", "duration").withColumnRenamed("page", "part")
    metrics = quality.track_metrics(records(spark, sf_dir, "cues", *_TRACK, "end", "text"), _TRACK)
    key = F.col("language")
    base = F.split_part(key, F.lit("-"), F.lit(1)) == _TARGET
    clean = key.rlike("^[A-Za-z]+(-([A-Za-z]{4}|[A-Za-z]{2}|[0-9]{3}))*$")
    human = heads.filter((F.col("track") == "human-sub") & ((key == _TARGET) | (base & clean))).join(metrics.select(*_TRACK), _TRACK).select(*_PAGE, key.alias("human"))
    auto_key = F.when(key.startswith("ai-"), F.concat(F.substring(key, 4, 100), F.lit("-orig"))).otherwise(key)
    auto = heads.filter("track = 'auto-sub'").withColumn("auto", auto_key).filter(F.split_part("auto", F.lit("-"), F.lit(1)) == _TARGET)
    auto = auto.join(metrics, _TRACK, "left").join(pages, _PAGE, "left").select(*_PAGE, "auto", F.when(F.col("n").isNull(), "cues").otherwise(quality.net_reason(F.col("duration"))).alias("why"))
    rows = pages.select(*_PAGE).join(human, _PAGE, "left").join(auto, _PAGE, "left")
    passed = F.coalesce(F.col("why") == "passed", F.lit(False))
    return rows.select(
        *_PAGE, F.when(F.col("human").isNotNull(), "human-sub").when(passed, "auto-sub").otherwise("whisper").alias("source"),
        F.coalesce("human", F.when(passed, F.regexp_replace("auto", "-orig$", ""))).alias("language"),
        F.when(F.col("human") == _TARGET, "exact key").when(F.col("human").isNotNull(), "base language").when(passed, "net passed").otherwise(F.coalesce("why", F.lit("no track"))).alias("reason"),
    )


@query("""with n as (select id, count(*) n from video_pages group by id) select id, case when n = 1 then 1 else page end as part, cid, case when n = 1 then null else 'page ' || pos end as title, duration from video_pages join n using (id)""")
def source_view_pages(spark, sf_dir: str) -> DataFrame:
    """View records read back; the record of a video with one page has no pages."""
    pages = load(spark, sf_dir, "video_pages", "id", "pos", "page", "cid", "duration")
    page = F.struct("page", "cid", F.concat(F.lit("page "), F.col("pos").cast("string")).alias("part"), "duration")
    views = pages.groupBy("id").agg(F.collect_list(page).alias("pages"), F.min("cid").alias("cid"), F.min("duration").alias("duration"))
    data = F.struct("cid", "duration", F.when(F.size("pages") > 1, F.col("pages")).alias("pages"))
    body = F.to_json(F.struct(F.lit(0).alias("code"), data.alias("data")))
    return metadata.view_pages(views.select("id", body.alias("body")), "id", "body").select("id", "part", "cid", "title", "duration")


@query("""select distinct id, part, language as code, track as source from transcripts where track in ('human-sub', 'auto-sub') and language is not null""")
def source_offered_tracks(spark, sf_dir: str) -> DataFrame:
    """Info records of pages read back: a row per track offered."""
    heads = records(spark, sf_dir, "transcripts", *_TRACK, "language", where="track in ('human-sub', 'auto-sub') and language is not null")
    keys = lambda t: F.map_from_entries(F.collect_list(F.when(F.col("track") == t, F.struct("language", F.lit("x"))))).alias("subtitles" if t == "human-sub" else "automatic_captions")
    infos = heads.groupBy(*_PAGE).agg(keys("human-sub"), keys("auto-sub"))
    infos = infos.select(F.struct(*_PAGE).alias("page"), F.to_json(F.struct("subtitles", "automatic_captions")).alias("body"))
    return metadata.offered_tracks(infos, "page", "body").select("page.id", "page.part", "code", "source")


@query("""select doc_id, case when doc_id % 2 = 0 then strftime(fetched_at, '%Y-%m-%dT%H:%M:%SZ') else strftime(fetched_at, '%Y-%m-%dT00:00:00Z') end as published from documents where fetched_at is not null""")
def fn_published_at(spark, sf_dir: str) -> DataFrame:
    """Times of publication from an epoch or, where there is none, from a compact date."""
    rows = load(spark, sf_dir, "documents", "doc_id", "fetched_at").filter("fetched_at is not null")
    epoch = F.when(F.col("doc_id") % 2 == 0, F.unix_timestamp(F.col("fetched_at").cast("timestamp")).cast("double"))
    return rows.select("doc_id", metadata.published_at(epoch, F.date_format("fetched_at", "yyyyMMdd")).alias("published"))


@query("""select transcript_id, case when nullif(trim(language), '') is not null then 'json' when source_reason <> '' then 'xml' end as ext, case when nullif(trim(language), '') is not null then coalesce(nullif(model, ''), 'at ' || language) when source_reason <> '' then source_reason end as body
 from (select distinct transcript_id, language, source_reason, model from transcripts)""")
def select_delivery(spark, sf_dir: str) -> DataFrame:
    """Of two formats, the second of them text, which is taken and whether inline."""
    rows = records(spark, sf_dir, "transcripts", "language", "source_reason", "model")
    named = F.nullif(F.trim("language"), F.lit(""))
    one = lambda ext, data, url: F.struct(F.lit(ext).alias("ext"), data.alias("data"), url.alias("url"))
    none = F.lit(None).cast("string")
    formats = F.array(one("xml", F.col("source_reason"), none), one("json", F.when(named.isNotNull(), F.col("model")), F.concat(F.lit("at "), F.when(named.isNotNull(), F.col("language")))))
    picked = metadata.delivery(formats)
    return rows.select("transcript_id", picked["ext"].alias("ext"), picked["body"].alias("body"))


@query("""select id, case when part is null then 'missing or truncated' when "end" is null then 'no object' else 'ok' end as verdict from (select distinct id, part, "end" from clip_inputs)""")
def fn_model_object(spark, sf_dir: str) -> DataFrame:
    """Responses about clips: cut short without a part, a list without an end."""
    rows = records(spark, sf_dir, "clip_inputs", "part", "end")
    content = F.when(F.col("end").isNull(), F.lit("[1]")).otherwise(F.to_json(F.struct("end")))
    choice = F.struct(F.when(F.col("part").isNull(), "length").otherwise("stop").alias("finish_reason"), F.struct(content.alias("content")).alias("message"))
    return rows.select("id", metadata.model_object(F.to_json(F.struct(F.array(choice).alias("choices")))).alias("verdict"))


@query("""select v.id, v.page as part, count(frame_id) as sampled, case when count(frame_id) = 0 then null else count(frame_id) >= 3 and count(nullif(ocr, '')) / count(frame_id) >= 0.40 end as burned_in from video_pages v
 left join (select distinct frame_id, id, part, ocr from frames) f on f.id = v.id and f.part = v.page group by all""")
def screen_evidence(spark, sf_dir: str) -> DataFrame:
    """Whether captions are burned in; NULL where nothing was sampled, which is no evidence against them."""
    pages = load(spark, sf_dir, "video_pages", "id", "page").withColumnRenamed("page", "part")
    frames = records(spark, sf_dir, "frames", "id", "part", "ocr")
    n, p = F.count("frame_id"), F.count(F.nullif("ocr", F.lit("")))
    return pages.join(frames, _PAGE, "left").groupBy(*_PAGE).agg(n.alias("sampled"), F.when(n > 0, (n >= 3) & (p / n >= 0.40)).alias("burned_in"))


@query(r"""select frame_id, coalesce(regexp_full_match(handle, '[A-Za-z0-9_-]{1,64}'), false) as valid from (select distinct frame_id, coalesce(regexp_replace(path, '\.[a-z]+$', ''), phash) handle from frames)""")
def fn_job_handle(spark, sf_dir: str) -> DataFrame:
    """Whether a name may be a job's handle: letters, digits, ``_`` and ``-`` alone, so that it can't leave its folder."""
    handle = F.coalesce(F.regexp_replace("path", r"\.[a-z]+$", ""), "phash")
    return records(spark, sf_dir, "frames", "path", "phash").select("frame_id", F.coalesce(handle.rlike(r"\A[A-Za-z0-9_-]{1,64}\z"), F.lit(False)).alias("valid"))


@query("""select doc_id, case when host like '%video.example' then 'video' when host = 'youtu.be' or host like '%youtube.com' then 'watch' end as provider from
 (select doc_id, case doc_id % 4 when 0 then 'www.video.example' when 1 then 'youtu.be' when 2 then 'm.youtube.com' else 'elsewhere.example' end host from documents)""")
def select_provider(spark, sf_dir: str) -> DataFrame:
    """The first provider that takes an address; NULL if none does."""
    from tidewater.functions import media

    hosts = F.array(*map(F.lit, ["www.video.example", "youtu.be", "m.youtube.com", "elsewhere.example"]))
    url = F.concat(F.lit("https://"), F.get(hosts, (F.col("doc_id") % 4).cast("int")), F.lit("/video/x"))
    watch = media.on_host(url, "youtube.com") | media.on_host(url, "youtu.be")
    return load(spark, sf_dir, "documents", "doc_id").select("doc_id", F.when(media.on_host(url, "video.example"), "video").when(watch, "watch").alias("provider"))


@query("""with t as (select distinct transcript_id, id, part, track, source, language, model from transcripts), c as (select id, part, track, count(*)::bigint n from (select distinct cue_id, id, part, track from cues) group by all)
 select transcript_id, source, language, model, coalesce(n, 0) as segments from t left join c using (id, part, track)""")
def bundle_transcript_payload(spark, sf_dir: str) -> DataFrame:
    """The transcript part of every bundle document; a list that is missing is empty."""
    heads = records(spark, sf_dir, "transcripts", *_TRACK, "source", "language", "model")
    cues = records(spark, sf_dir, "cues", *_TRACK, "pos").groupBy(*_TRACK).agg(F.collect_list("pos").alias("segments"))
    body = F.to_json(F.struct(F.struct("source", "language", "model", "segments").alias("transcript")))
    bundles = heads.join(cues, _TRACK, "left").select("transcript_id", body.alias("body"))
    kept = F.from_json("body", "transcript struct<source:string,language:string,model:string,segments:array<int>>")["transcript"]
    return bundles.select("transcript_id", kept.alias("t")).select("transcript_id", "t.source", "t.language", "t.model", F.size(F.coalesce("t.segments", F.array().cast("array<int>"))).alias("segments"))


@query("""select id, part, track, transcript_id, row_number() over (partition by id, part order by first nulls last, transcript_id) as place from
 (select transcript_id, id, part, track, (select min("start") from cues c where c.id = t.id and c.part = t.part and c.track = t.track and c.text like '%?%') first from (select distinct transcript_id, id, part, track from transcripts) t)""")
def order_unanchored_last(spark, sf_dir: str) -> DataFrame:
    """Tracks of a page by when their first question comes; those without one last, in the order they came in."""
    from pyspark.sql import Window

    heads = records(spark, sf_dir, "transcripts", *_TRACK)
    first = records(spark, sf_dir, "cues", *_TRACK, "start", "text", where="text like '%?%'").groupBy(*_TRACK).agg(F.min("start").alias("first"))
    w = Window.partitionBy(*_PAGE).orderBy(F.asc_nulls_last("first"), "transcript_id")
    return heads.join(first, _TRACK, "left").select(*_TRACK, "transcript_id", F.row_number().over(w).alias("place"))
