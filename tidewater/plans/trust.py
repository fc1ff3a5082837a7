"""Queries on tracks: quality, repetition, choice among candidates, frames kept, recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.python import compatibility_fold, line_support, near_copy, phonetic_key, sequence_ratio
from tidewater.functions.text import DIGITS, PUNCTUATION_CLASS, SPACES, bare, base_language, clean_tag, join_words, phash_bits, source_key
from tidewater.operators import acquire, folds, quality
from tidewater.plans.base import query, records
from tidewater.tables import load

_TRACK = ["id", "part", "track"]
_PUNCT = PUNCTUATION_CLASS.replace("'", "''")
_METRICS = rf"""tx as (select distinct cue_id, id, part, track, pos, "end" e, coalesce(text, '') t from cues),
 mt as (select id, part, track, count(*) n, count(distinct t) d, sum(length(t)) chars, sum(len(regexp_extract_all(t, '{_PUNCT}'))) punct, sum(len(regexp_extract_all(t, '{DIGITS}'))) digits,
  sum(len(regexp_extract_all(t, '[一-\x{{9fff}}]'))) cjk, sum(len(regexp_extract_all(t, '{SPACES}'))) spaces, max(e) last_end from tx group by all),
 hd as (select distinct transcript_id, id, part, track, language from transcripts),
 gm as (select hd.transcript_id, hd.track source, v.duration, coalesce(language <> '' and not contains(language, 'zh'), false) fgn, mt.*,
  case when chars > 0 then punct / chars else 0.0 end pd, (n - d) / n dr,
  case when coalesce(language <> '' and not contains(language, 'zh'), false) or chars = spaces then 0.0 else (chars - spaces - cjk - punct - digits) / (chars - spaces) end nz,
  case when v.duration > 0 then chars / v.duration end cps from hd join mt using (id, part, track) join video_pages v on v.id = hd.id and v.page = hd.part),
 gt as (select *, not ((source <> 'auto-sub' and pd < 0.04) or dr > 0.30 or nz > 0.20 or coalesce(case when fgn then cps > 40 else cps not between 1 and 8 end, false)) passed from gm)"""


def _gated(spark, sf_dir: str) -> DataFrame:
    cues = records(spark, sf_dir, "cues", *_TRACK, "pos", "end", "text")
    heads = records(spark, sf_dir, "transcripts", *_TRACK, "language")
    pages = load(spark, sf_dir, "video_pages", "id", "page", "duration").withColumnRenamed("page", "part")
    metrics = quality.track_metrics(cues, _TRACK).join(heads, _TRACK).join(pages, ["id", "part"])
    return quality.gate(metrics, source=F.col("track"), language=F.col("language"), duration=F.col("duration"))


@query(f"with {_METRICS} select transcript_id, passed, round(pd, 4) as punct_density, round(dr, 4) as dup_ratio, round(nz, 4) as nonzh_ratio, round(cps, 4) as cps from gt")
def gate_quality(spark, sf_dir: str) -> DataFrame:
    return _gated(spark, sf_dir).select("transcript_id", "passed", "punct_density", "dup_ratio", "nonzh_ratio", "cps")


@query(f"""with {_METRICS} select transcript_id, coalesce(nullif(concat_ws(', ', case when source <> 'auto-sub' and round(pd, 4) < 0.04 then 'punct_density' end, case when round(dr, 4) > 0.30 then 'dup_ratio' end,
 case when round(nz, 4) > 0.20 then 'nonzh_ratio' end, case when round(cps, 4) < 1 or round(cps, 4) > 8 then 'cps' end), ''), 'passed') as why from gt""")
def gate_failures(spark, sf_dir: str) -> DataFrame:
    return _gated(spark, sf_dir).select("transcript_id", quality.failures(F.col("track")).alias("why"))


@query(f"""with {_METRICS} select transcript_id, case when n < 5 then 'cues' when duration is null or duration <= 0 then 'passed' when last_end / duration not between 0.70 and 1.10 then 'coverage'
 when chars / duration < 0.5 then 'speed' else 'passed' end as verdict from gm""")
def gate_structural_net(spark, sf_dir: str) -> DataFrame:
    return _gated(spark, sf_dir).select("transcript_id", quality.net_reason(F.col("duration")).alias("verdict"))


@query("""select id, part, track, max("end") / duration between 0.70 and 1.10 as sane from (select distinct cue_id, id, part, track, "end" from cues) c
 join video_pages v using (id) where v.page = c.part and duration > 0 group by id, part, track, duration""")
def gate_duration(spark, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "video_pages", "id", "page", "duration").withColumnRenamed("page", "part").filter("duration > 0")
    ends = records(spark, sf_dir, "cues", *_TRACK, "end").groupBy(*_TRACK).agg(F.max("end").alias("e"))
    return ends.join(pages, ["id", "part"]).select(*_TRACK, (F.col("e") / F.col("duration")).between(0.70, 1.10).alias("sane"))


@query(rf"""with w as (select id, part, track, string_agg(coalesce(text, ''), '' order by pos) body from (select distinct id, part, track, pos, text from cues) group by all)
 select id, part, track, case when language in ('zh-Hans', 'zh-CN', 'zh', 'ai-zh') then nullif(regexp_extract(body, '{acquire.REDACTED}'), '') end as marker
 from w join (select distinct id, part, track, language from transcripts) using (id, part, track)""")
def gate_redaction_marker(spark, sf_dir: str) -> DataFrame:
    """The first mark of censorship in a Chinese track. It may span cues: it is looked for in the whole text of a track."""
    cues = records(spark, sf_dir, "cues", *_TRACK, "pos", "text")
    whole = cues.groupBy(*_TRACK).agg(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("text", F.lit("")).alias("t")))).alias("x"))
    heads = records(spark, sf_dir, "transcripts", *_TRACK, "language").drop("transcript_id")
    return whole.join(heads, _TRACK).select(*_TRACK, acquire.marker(F.col("language"), F.array_join("x.t", "")).alias("marker"))


_REP = r"""k as (select id, part, track, pos, lower(trim(regexp_replace(coalesce(text, ''), '[\s　]+', '', 'g'), '，。！？、!?.,;:：…—-()（）"''*')) k from (select distinct id, part, track, pos, text from cues)),
 c as (select id, part, track, k, count(*) c, min(pos) p0 from k group by all), tp as (select id, part, track, sum(c)::bigint n, max(c) most, (array_agg(k order by c desc, p0))[1] top from c group by all),
 g as (select *, row_number() over (partition by id, part, track order by pos) - row_number() over (partition by id, part, track, k order by pos) g from k),
 r as (select id, part, track, max(r) run from (select id, part, track, k, g, count(*) r from g where k <> '' group by all) group by all)"""


@query(f"""with {_REP} select id, part, track, n, case when n >= 3 and top <> '' then round(most / n, 3) else 0.0 end as repeat_ratio, coalesce(run, 0) as longest_run, case when n >= 3 and top <> '' then top end as top_text,
 n >= 3 and top <> '' and (most / n >= 0.40 or coalesce(run, 0) >= 5) as looping from tp left join r using (id, part, track)""")
def track_repetition(spark, sf_dir: str) -> DataFrame:
    return quality.repetition(records(spark, sf_dir, "cues", *_TRACK, "pos", "text"), _TRACK)


_RANK = "case track when 'human-sub' then 0 when 'auto-sub' then 1 when 'whisper' then 2 else 3 end"


def _ranked(spark, sf_dir: str) -> DataFrame:
    rank = F.when(F.col("track") == "human-sub", 0).when(F.col("track") == "auto-sub", 1).when(F.col("track") == "whisper", 2).otherwise(3)
    return _gated(spark, sf_dir).select("id", "part", "track", "passed", rank.alias("rank"))


@query(f"""with {_METRICS}, k as (select id, part, track, passed, {_RANK} rank from gt) select id, part, (array_agg(track order by rank))[1] as track, min(rank) as rank from k where passed group by id, part""")
def select_first_accepted(spark, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir).filter("passed").groupBy("id", "part").agg(F.min_by("track", "rank").alias("track"), F.min("rank").alias("rank"))


@query(f"""with {_METRICS}, k as (select id, part, track, passed, {_RANK} rank from gt), m as (select id, part, min(rank) filter (where passed) best from k group by all)
 select id, part, string_agg(track, ' > ' order by rank) as rejected from k join m using (id, part) where rank < coalesce(best, 9) group by id, part""")
def select_rejected_trail(spark, sf_dir: str) -> DataFrame:
    rows = _ranked(spark, sf_dir)
    best = F.min(F.when(F.col("passed"), F.col("rank"))).over(Window.partitionBy("id", "part"))
    tried = rows.withColumn("best", best).filter(F.col("rank") < F.coalesce("best", F.lit(9)))
    trail = F.sort_array(F.collect_list(F.struct("rank", "track")))
    return tried.groupBy("id", "part").agg(F.array_join(trail["track"], " > ").alias("rejected"))


_KEYS = "k as (select distinct id, part, language key from transcripts where language is not null and language <> '')"


def _track_keys(spark, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "transcripts", "id", "part", "language").filter("language is not null and language <> ''").select("id", "part", F.col("language").alias("key")).distinct()


@query(f"""with {_KEYS} select id, part, key from (select *, row_number() over (partition by id, part order by key <> 'zh', not starts_with(key, 'zh'), length(key), key) rn from k
 where key = 'zh' or (split_part(key, '-', 1) = 'zh' and regexp_full_match(key, '[A-Za-z]+(-([A-Za-z]{{4}}|[A-Za-z]{{2}}|[0-9]{{3}}))*'))) where rn = 1""")
def select_human_key(spark, sf_dir: str) -> DataFrame:
    key = F.col("key")
    fit = _track_keys(spark, sf_dir).filter((key == "zh") | ((base_language(key) == "zh") & clean_tag(key)))
    w = Window.partitionBy("id", "part").orderBy(key != "zh", ~key.startswith("zh"), F.length(key), key)
    return fit.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("id", "part", "key")


_AUTO = f"{_KEYS}, a as (select id, part, case when key like 'ai-%' then substr(key, 4) || '-orig' else key end key from k), o as (select *, bool_or(key like '%-orig') over (partition by id, part) any_orig from a)"


@query(f"""with {_AUTO} select id, part, key from (select *, row_number() over (partition by id, part order by key <> 'en-orig', key <> 'en', not key like '%-orig', not starts_with(key, 'en'), length(key), key) rn from o
 where key in ('en-orig', 'en') or (key like '%-orig' and split_part(key, '-', 1) = 'en') or (not any_orig and split_part(key, '-', 1) = 'en')) where rn = 1""")
def select_auto_key(spark, sf_dir: str) -> DataFrame:
    keys = _track_keys(spark, sf_dir).withColumn("key", F.when(F.col("key").startswith("ai-"), F.concat(F.expr("substr(key, 4)"), F.lit("-orig"))).otherwise(F.col("key")))
    key, orig = F.col("key"), F.col("key").endswith("-orig")
    keys = keys.withColumn("any_orig", F.max(orig).over(Window.partitionBy("id", "part")))
    same = base_language(key) == "en"
    fit = keys.filter(key.isin("en-orig", "en") | (orig & same) | (~F.col("any_orig") & same))
    w = Window.partitionBy("id", "part").orderBy(key != "en-orig", key != "en", ~orig, ~key.startswith("en"), F.length(key), key)
    return fit.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("id", "part", "key")


@query("""with t as (select distinct transcript_id, id, part, track, fetched_at from transcripts), l as (select id, part, track, (array_agg(transcript_id order by fetched_at desc, transcript_id desc))[1] transcript_id from t group by all)
 select id, part, track, transcript_id from l""")
def select_latest_record(spark, sf_dir: str) -> DataFrame:
    heads = records(spark, sf_dir, "transcripts", *_TRACK, "fetched_at")
    return heads.groupBy(*_TRACK).agg(F.max_by("transcript_id", F.struct("fetched_at", "transcript_id")).alias("transcript_id"))


@query("""select t.transcript_id, coalesce(p.cid, q.cid, case when t.part = 1 then 0 end) as cid from (select distinct transcript_id, id, part from transcripts) t
 left join video_pages p on p.id = t.id and p.page = t.part left join video_pages q on q.id = t.id and q.pos = t.part - 1""")
def join_page_cid(spark, sf_dir: str) -> DataFrame:
    """The page's number by its number, else by its position, else the first page's default."""
    heads = records(spark, sf_dir, "transcripts", "id", "part")
    pages = load(spark, sf_dir, "video_pages", "id", "pos", "page", "cid")
    by_page = pages.select("id", F.col("page").alias("part"), F.col("cid").alias("a"))
    by_pos = pages.select("id", (F.col("pos") + 1).alias("part"), F.col("cid").alias("b"))
    out = heads.join(by_page, ["id", "part"], "left").join(by_pos, ["id", "part"], "left")
    return out.select("transcript_id", F.coalesce("a", "b", F.when(F.col("part") == 1, F.lit(0))).alias("cid"))


@query("""with t as (select distinct id, part, track, pos, coalesce(text, '') t from cues), w as (select id, part, track, string_agg(trim(t, ' '), '' order by pos) body from t group by all)
 select a.id, a.part, a.track from w a join w b on a.id = b.id and a.track = b.track and b.part = 1 and a.part > 1 and a.body = b.body""")
def join_same_as_first_part(spark, sf_dir: str) -> DataFrame:
    cues = records(spark, sf_dir, "cues", *_TRACK, "pos", "text")
    whole = cues.groupBy(*_TRACK).agg(F.sort_array(F.collect_list(F.struct("pos", F.trim(F.coalesce("text", F.lit(""))).alias("t")))).alias("x"))
    print_ = whole.select(*_TRACK, F.sha2(F.array_join("x.t", ""), 256).alias("body"))
    first = print_.filter("part = 1").select("id", "track", "body")
    return print_.filter("part > 1").join(first, ["id", "track", "body"], "left_semi").select(*_TRACK)


@query(None)
def join_near_first_part(spark, sf_dir: str) -> DataFrame:
    """Whether a part's track repeats that of part 1, equal or with a ratio of 0.90: the rule ``join_same_as_first_part`` has for equality."""
    cues = records(spark, sf_dir, "cues", *_TRACK, "pos", "text")
    whole = cues.groupBy(*_TRACK).agg(F.sort_array(F.collect_list(F.struct("pos", bare(F.coalesce("text", F.lit(""))).alias("t")))).alias("x"))
    whole = whole.select(*_TRACK, F.array_join("x.t", "").alias("body"))
    first = whole.filter("part = 1").select("id", "track", F.col("body").alias("first"))
    return whole.filter("part > 1").join(first, ["id", "track"]).select(*_TRACK, near_copy("body", "first").alias("repeats"))


@query(None)
def join_reference_support(spark, sf_dir: str) -> DataFrame:
    """How well what was heard in a part supports each line of its video's lyrics; from 0.64 on the line is supported."""
    notes = load(spark, sf_dir, "documents", "doc_id", "id", "text", "source").filter("source = 'lyrics_note' and id is not null")
    raw = notes.select("doc_id", "id", F.explode(F.split("text", "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")).alias("raw"))
    raw = raw.filter(~F.col("raw").rlike(r"(?i)^\[(?:ti|ar|al|by|offset|length|re|ve):"))
    lines = raw.select("doc_id", "id", bare(F.regexp_replace("raw", r"\[[^\]]*\]|<\d+:[^>]*>", "")).alias("line"))
    lines = lines.filter(~F.col("line").rlike("(?i)作[词詞曲]|编曲|編曲|混音|母带|母帶|lyrics? by|composed by")).distinct()
    lines = lines.withColumn("k", compatibility_fold("line")).filter(F.length("k") >= 3)
    words = records(spark, sf_dir, "cues", *_TRACK, "pos", "text", where="track = 'whisper' and text is not null")
    heard = words.groupBy("id", "part").agg(F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("x"))
    heard = heard.select("id", "part", compatibility_fold(join_words(F.col("x.text"))).alias("heard")).filter("heard <> ''")
    rows = lines.join(heard, "id").withColumn("support", line_support("k", "heard"))
    return rows.select("doc_id", "part", "line", F.round("support", 4).alias("support"), (F.col("support") >= 0.64).alias("supported"))


def _reference_scores(spark, sf_dir: str) -> DataFrame:
    """Score of each lyrics note for each part: the letters of its supported lines, weighed by how far support exceeds a half."""
    lines = join_reference_support(spark, sf_dir)
    weight = F.when(F.col("supported"), F.length(compatibility_fold("line")) * (F.col("support") - 0.5)).otherwise(0.0)
    return lines.withColumn("weight", weight).groupBy("doc_id", "part").agg(F.round(F.sum("weight"), 4).alias("score"), F.count_if("supported").alias("lines"))


@query(None)
def agg_reference_score(spark, sf_dir: str) -> DataFrame:
    return _reference_scores(spark, sf_dir)


@query(None)
def select_reference(spark, sf_dir: str) -> DataFrame:
    """The note with the highest score of each video's part, the smaller id among equals; NULL if none scores above nothing."""
    scores = _reference_scores(spark, sf_dir).join(load(spark, sf_dir, "documents", "doc_id", "id"), "doc_id")
    place = F.when(F.col("score") > 0, F.struct("score", (-F.col("doc_id")).alias("d")))
    return scores.groupBy("id", "part").agg(F.max_by("doc_id", place).alias("doc_id"), F.max("score").alias("score"))


@query(None)
def fn_phonetic_key(spark, sf_dir: str) -> DataFrame:
    """Japanese phrases by their kana's sounds, others folded: dictionaries of ideographs' readings aren't installed."""
    return load(spark, sf_dir, "catchphrases", "phrase_id", "text", "lang").select("phrase_id", phonetic_key("text", "lang").alias("key"))


@query(None)
def fn_ocr_similarity(spark, sf_dir: str) -> DataFrame:
    """Share of matching characters of each frame's on-screen text and the one seen just before."""
    w = Window.partitionBy("id", "part").orderBy("ts", "frame_id")
    rows = records(spark, sf_dir, "frames", "id", "part", "ts", "ocr").withColumn("before", F.lag("ocr").over(w)).filter("ocr is not null and before is not null")
    return rows.select("frame_id", F.round(sequence_ratio(source_key(F.col("before"), False), source_key(F.col("ocr"), False)), 6).alias("ratio"))


@query(None)
def fn_compatibility_fold(spark, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir, "cues", "text").select("cue_id", compatibility_fold("text").alias("folded"))


_WALK = """f as (select frame_id, id, part, cast(('0x' || phash) as ubigint) h, row_number() over (partition by id, part order by ts, frame_id) rn from (select distinct frame_id, id, part, ts, phash from frames where phash is not null and ts is not null)),
 w as (select id, part, rn, frame_id, h last, true kept from f where rn = 1 union all
 select f.id, f.part, f.rn, f.frame_id, case when bit_count(xor(f.h, w.last)) > 10 then f.h else w.last end, bit_count(xor(f.h, w.last)) > 10 from w join f on f.id = w.id and f.part = w.part and f.rn = w.rn + 1)"""


@query(f"with recursive {_WALK} select id, part, frame_id from w where kept")
def frames_last_kept(spark, sf_dir: str) -> DataFrame:
    frames = records(spark, sf_dir, "frames", "id", "part", "ts", "phash", where="ts is not null").withColumn("bits", phash_bits(F.col("phash"))).filter("bits is not null")
    return folds.last_kept(frames, ["id", "part"], ["ts", "frame_id"], "bits", 10).select("id", "part", "frame_id")


@query(f"with recursive {_WALK} select id, part, count(*) as kept, count(path) as pictures from (select distinct frame_id, id, part, path from frames) f where frame_id in (select frame_id from w where kept) group by all")
def join_kept_frames(spark, sf_dir: str) -> DataFrame:
    kept = frames_last_kept(spark, sf_dir).select("frame_id")
    frames = records(spark, sf_dir, "frames", "id", "part", "path")
    return frames.join(kept, "frame_id", "left_semi").groupBy("id", "part").agg(F.count("*").alias("kept"), F.count("path").alias("pictures"))




@query("""with l as (select distinct id rec, left(phash, 4) h from frames where phash is not null), pr as (select a.rec, b.rec other, count(distinct a.h) shared from l a join l b on a.h = b.h and a.rec <> b.rec
  where a.rec in (select id from video_pages where cid % 50 = 0) group by all)
 select rec, other, shared from (select *, row_number() over (partition by rec order by shared desc, other) rn from pr) where rn <= 6""")
def recording_candidates(spark, sf_dir: str) -> DataFrame:
    """The six recordings that share most landmarks with each queried one (those with a page number divisible by 50), by an
    inverted index of landmarks."""
    marks = load(spark, sf_dir, "frames", "id", "phash").filter("phash is not null").select(F.col("id").alias("rec"), F.left("phash", F.lit(4)).alias("h")).distinct()
    asked = load(spark, sf_dir, "video_pages", "id", "cid").filter("cid % 50 = 0").select(F.col("id").alias("rec")).distinct()
    pairs = marks.join(asked, "rec", "left_semi").join(marks.select(F.col("rec").alias("other"), "h"), "h").filter("rec <> other").groupBy("rec", "other").agg(F.count("*").alias("shared"))
    w = Window.partitionBy("rec").orderBy(F.desc("shared"), "other")
    return pairs.withColumn("rn", F.row_number().over(w)).filter("rn <= 6").select("rec", "other", "shared")


@query("""with l as (select distinct id rec, left(phash, 4) h from frames where phash is not null), o as (select rec, count(*) own from l group by rec), pr as (select a.rec, b.rec other, count(*) shared from l a join l b on a.h = b.h and a.rec <> b.rec
  where a.rec in (select id from video_pages where cid % 50 = 0) group by all) select rec, other, fraction from (select pr.rec, other, round(shared / own, 4) fraction, row_number() over (partition by pr.rec order by shared desc, other) rn from pr join o on o.rec = pr.rec) where rn = 1""")
def recording_best_match(spark, sf_dir: str) -> DataFrame:
    """The recording that holds the largest share of each queried one's landmarks, the first by name among equals."""
    own = load(spark, sf_dir, "frames", "id", "phash").filter("phash is not null").groupBy(F.col("id").alias("rec")).agg(F.count_distinct(F.left("phash", F.lit(4))).alias("own"))
    best = recording_candidates(spark, sf_dir).groupBy("rec").agg(F.min_by(F.struct("other", "shared"), F.struct((-F.col("shared")).alias("s"), "other")).alias("b"))
    return best.join(own, "rec").select("rec", "b.other", F.round(F.col("b.shared") / F.col("own"), 4).alias("fraction"))


@query(f"""with {_METRICS}, i as (select id, part, unnest(list_filter([case when source <> 'auto-sub' and round(pd, 4) < 0.04 then 'punct_density' end, case when round(dr, 4) > 0.30 then 'dup_ratio' end, case when round(nz, 4) > 0.20 then 'nonzh_ratio' end,
  case when round(cps, 4) < 1 or round(cps, 4) > 8 then 'cps' end], lambda x: x is not null)) issue from gt
 union select c.source, coalesce(c.part, 1), unnest(list_filter([case when "end" <= "start" then 'clip order' end, case when "end" > duration + 0.1 then 'clip end' end], lambda x: x is not null)) from clip_inputs c left join video_pages v on v.id = c.source and v.page = coalesce(c.part, 1))
 select id, part, string_agg(distinct issue, ', ' order by issue) as issues from i group by id, part""")
def agg_issue_set(spark, sf_dir: str) -> DataFrame:
    """What every stage had to say against a page, once each and in order."""
    gates = _gated(spark, sf_dir).select("id", "part", F.explode(F.split(quality.failures(F.col("track")), ", ")).alias("issue")).filter("issue <> 'passed'")
    pages = load(spark, sf_dir, "video_pages", "id", "page", "duration").withColumnRenamed("page", "part")
    clips = records(spark, sf_dir, "clip_inputs", "source", "part", "start", "end").select(F.col("source").alias("id"), F.coalesce("part", F.lit(1)).alias("part"), "start", "end")
    rules = F.array(F.when(F.col("end") <= F.col("start"), "clip order"), F.when(F.col("end") > F.col("duration") + 0.1, "clip end"))
    clips = clips.join(pages, ["id", "part"], "left").select("id", "part", F.explode(F.array_compact(rules)).alias("issue"))
    return gates.unionByName(clips).groupBy("id", "part").agg(F.array_join(F.array_sort(F.collect_set("issue")), ", ").alias("issues"))
