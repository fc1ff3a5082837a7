"""The delivered documents: a page as Markdown, its parts fused and its bundle as one JSON document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.text import SPACES, clock, neutral_markdown, pills
from tidewater.operators import quality
from tidewater.operators import timeline as grid
from tidewater.plans import timeline
from tidewater.plans.base import query, records
from tidewater.tables import load

_PAGE, _TRACK = ["id", "part"], ["id", "part", "track"]
# The headings and notes of a page.
PENDING = "_(no transcript yet — Whisper pending)_"
SCREEN = "_burned-in subtitle track on an independent timeline (lower authority than the picked transcript; per-cue confidence shown). Distinct from slide/Frame.ocr._"
MORE = "- ﹢{} more — see bundle.json"


def _clock(x: str) -> str:
    whole = f"cast(round_even({x}, 0) as bigint)"
    return f"lpad(cast({whole} // 60 as varchar), cast(greatest(2, length(cast({whole} // 60 as varchar))) as integer), '0') || ':' || lpad(cast({whole} % 60 as varchar), 2, '0')"


def _neutral(x: str) -> str:
    return rf"regexp_replace({x}, '(?m)^([^\S\n]*)(#{{1,6}}|-{{3,}}|\*{{3,}}|_{{3,}}|`{{3,}}|~{{3,}})', '\1\\\2', 'g')"


_PILLS = "case when high_like then '👍 ' else '' end || case author when 'owner' then 'UP主? ' when 'staff' then '合作? ' else '' end"
_CHUNKS = f"""au as (select id, part, (array_agg(track order by rk, track))[1] track from (select distinct id, part, track, case track when 'human-sub' then 0 when 'whisper' then 1 else 2 end rk from cues) group by all),
 cb as (select cu.id, cu.part, cu.pos, coalesce(cu.text, '') t, coalesce((select max(boundary) from b where b.id = cu.id and b.part = cu.part and b.boundary <= cu."start"), (select min(boundary) from b where b.id = cu.id and b.part = cu.part)) w from cu join au using (id, part, track)),
 ct as (select id, part, w, regexp_replace(string_agg(t, '' order by pos), '^{SPACES}+|{SPACES}+$', '', 'g') body from cb where w is not null group by all),
 fb as (select fr.*, (select max(boundary) from b where b.id = fr.id and b.part = fr.part and b.boundary <= fr.ts) w from fr),
 ck as (select id, part, w from ct union select id, part, w from fb),
 l1 as (select id, part, 1 s, w, 0 k, 0.0 o, 0::bigint r, '### [' || {_clock("w")} || ']' line from ck
  union all select id, part, 1, w, 1, ts, frame_id * 2, '**slide (OCR):** ' || {_neutral("ocr")} from fb where ocr <> '' union all select id, part, 1, w, 1, ts, frame_id * 2 + 1, '**slide (figure):** ' || {_neutral("caption")} from fb where caption <> ''
  union all select distinct id, part, 1, w, 2, 0.0, 0::bigint, '' from fb union all select id, part, 1, w, 3, 0.0, 0::bigint, {_neutral("body")} from ct where body <> '' union all select id, part, 1, w, 4, 0.0, 0::bigint, '' from ck)"""
_SCREEN = f"""sc as (select distinct cue_id, id, part, "start", text, confidence from cues where track = 'ocr' and text is not null and "start" is not null),
 l2 as (select id, part, 2 s, 0.0 w, 0 k, 0.0 o, 0::bigint r, '## Hard-subtitles (OCR)' line from sc group by id, part union all select id, part, 2, 0.0, 1, 0.0, 0::bigint, '{SCREEN}' from sc group by id, part union all select id, part, 2, 0.0, 2, 0.0, 0::bigint, '' from sc group by id, part
  union all select id, part, 2, 0.0, 3, "start", cue_id, '- [' || {_clock('"start"')} || '] ' || {_neutral("text")} || case when confidence is not null then ' (conf ' || cast(cast(round(confidence, 2) as decimal(5, 2)) as varchar) || ')' else '' end from sc union all select id, part, 2, 0.0, 4, 0.0, 0::bigint, '' from sc group by id, part)"""
_CROWD = f"""wt as (select id, part, w, count(*) total from dw group by all), ov as (select id, part, w, count(*) filter (where not elevated) - {timeline.CAP} more from od group by all),
 l3 as (select id, part, 3 s, 0.0 w, 0 k, 0.0 o, 0::bigint r, '## Danmaku' line from wt group by id, part union all select id, part, 3, 0.0, 1, 0.0, 0::bigint, '' from wt group by id, part
  union all select id, part, 4, w, 0, 0.0, 0::bigint, '### [' || {_clock("w")} || '] (' || total || ' danmaku)' from wt
  union all select id, part, 4, w, 1, 0.0, place, '- ' || {_PILLS} || '「' || {_neutral("text")} || '」' || case when n = 1 then '' else ' ×' || n end from od where elevated or ordinary <= {timeline.CAP}
  union all select id, part, 4, w, 2, 0.0, 0::bigint, '{MORE.split("{}")[0]}' || more || '{MORE.split("{}")[1]}' from ov where more > 0 union all select id, part, 4, w, 3, 0.0, 0::bigint, '' from wt)"""


@query(f"""with {timeline._GRID} {timeline._LINES}, {_CHUNKS}, {_SCREEN}, {_CROWD}, al as (select * from l1 union all select * from l2 union all select * from l3 union all select id, page, 0, 0.0, 0, 0.0, 0::bigint, '# ' || id from video_pages union all select id, page, 0, 0.0, 1, 0.0, 0::bigint, '' from video_pages
 union all select id, page, 0, 0.0, 2, 0.0, 0::bigint, '## Transcript' from video_pages union all select id, page, 0, 0.0, 3, 0.0, 0::bigint, '' from video_pages
 union all select id, page, 0, 0.0, 4, 0.0, 0::bigint, '{PENDING}' from video_pages where (id, page) not in (select id, part from ck) union all select id, page, 0, 0.0, 5, 0.0, 0::bigint, '' from video_pages where (id, page) not in (select id, part from ck))
 select id, part, regexp_replace(string_agg(line, chr(10) order by s, w, k, o, r, line), '{SPACES}+$', '') || chr(10) as body from al group by id, part""")
def bundle_page(spark, sf_dir: str) -> DataFrame:
    """Every page as one Markdown document: its chunks with their slides, the on-screen texts, and the crowd with what goes
    beyond the cap counted. A line table put together in order; only the document itself is gathered."""
    pages = load(spark, sf_dir, "video_pages", "id", "page").withColumnRenamed("page", "part")
    bounds, _, _ = timeline._grid(spark, sf_dir)
    cues = records(spark, sf_dir, "cues", *_TRACK, "pos", "start", "text", "confidence")
    frames = records(spark, sf_dir, "frames", "id", "part", "ts", "ocr", "caption", where="ts is not null")
    rank = F.when(F.col("track") == "human-sub", 0).when(F.col("track") == "whisper", 1).otherwise(2)
    chosen = cues.groupBy(*_PAGE).agg(F.min_by("track", F.struct(rank.alias("r"), "track")).alias("track"))
    said = grid.asof_backward(cues.join(chosen, _TRACK), bounds, _PAGE, "start").filter("boundary is not null").withColumnRenamed("boundary", "w")
    shown = grid.asof_backward(frames, bounds, _PAGE, "ts").withColumnRenamed("boundary", "w")
    body = F.array_join(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("text", F.lit("")).alias("t"))))["t"], "")
    texts = said.groupBy(*_PAGE, "w").agg(F.regexp_replace(body, f"^{SPACES}+|{SPACES}+$", "").alias("body"))
    chunks = texts.select(*_PAGE, "w").union(shown.select(*_PAGE, "w")).distinct()

    def lines(df: DataFrame, section: int, *made: tuple) -> DataFrame:
        """A row per line: its section, window, kind and order. A line that is NULL isn't there."""
        each = [F.struct(F.lit(section).alias("s"), F.col("w").alias("w"), F.lit(k).alias("k"), o.cast("double").alias("o"), r.cast("bigint").alias("r"), line.alias("line")) for k, o, r, line in made]
        return df.select(*_PAGE, F.explode(F.array(*each)).alias("x")).filter("x.line is not null")

    zero, empty = F.lit(0), F.lit("")
    at = F.concat(F.lit("["), clock(F.col("w")), F.lit("]"))
    slide = lambda what, c: F.when(F.col(c) != "", F.concat(F.lit(f"**slide ({what}):** "), neutral_markdown(F.col(c))))
    once = lambda df: df.select(*_PAGE).distinct().withColumn("w", F.lit(0.0))
    screen = cues.filter("track = 'ocr' and text is not null and start is not null").withColumn("w", F.lit(0.0))
    sure = F.coalesce(F.concat(F.lit(" (conf "), F.round("confidence", 2).cast("decimal(5,2)").cast("string"), F.lit(")")), F.lit(""))
    crowd = timeline._crowd(spark, sf_dir)
    totals = crowd.groupBy(*_PAGE, "w").agg(F.count("*").alias("total"))
    order = Window.partitionBy(*_PAGE, "w").orderBy("ts", "elevated", "seq", "text")
    ordered = timeline._lines(crowd).withColumn("place", F.row_number().over(order))
    ordered = ordered.withColumn("ordinary", F.sum(F.when(F.col("elevated"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    more = ordered.groupBy(*_PAGE, "w").agg((F.count_if(~F.col("elevated")) - timeline.CAP).alias("more")).filter("more > 0")
    times = F.when(F.col("n") == 1, "").otherwise(F.concat(F.lit(" ×"), F.col("n").cast("string")))
    comment = F.concat(F.lit("- "), pills(F.col("high_like"), F.col("author")), F.lit("「"), neutral_markdown(F.col("text")), F.lit("」"), times)
    silent = once(pages.join(chunks, _PAGE, "left_anti"))
    parts = [
        lines(once(pages), 0, (0, zero, zero, F.concat(F.lit("# "), "id")), (1, zero, zero, empty), (2, zero, zero, F.lit("## Transcript")), (3, zero, zero, empty)),
        lines(silent, 0, (4, zero, zero, F.lit(PENDING)), (5, zero, zero, empty)),
        lines(chunks, 1, (0, zero, zero, F.concat(F.lit("### "), at)), (4, zero, zero, empty)),
        lines(shown, 1, (1, F.col("ts"), F.col("frame_id") * 2, slide("OCR", "ocr")), (1, F.col("ts"), F.col("frame_id") * 2 + 1, slide("figure", "caption"))),
        lines(shown.select(*_PAGE, "w").distinct(), 1, (2, zero, zero, empty)),
        lines(texts.filter("body <> ''"), 1, (3, zero, zero, neutral_markdown(F.col("body")))),
        lines(once(screen), 2, (0, zero, zero, F.lit("## Hard-subtitles (OCR)")), (1, zero, zero, F.lit(SCREEN)), (2, zero, zero, empty), (4, zero, zero, empty)),
        lines(screen, 2, (3, F.col("start"), F.col("cue_id"), F.concat(F.lit("- ["), clock(F.col("start")), F.lit("] "), neutral_markdown(F.col("text")), sure))),
        lines(once(totals), 3, (0, zero, zero, F.lit("## Danmaku")), (1, zero, zero, empty)),
        lines(totals, 4, (0, zero, zero, F.concat(F.lit("### "), at, F.lit(" ("), F.col("total").cast("string"), F.lit(" danmaku)"))), (3, zero, zero, empty)),
        lines(ordered.filter(F.col("elevated") | (F.col("ordinary") <= timeline.CAP)), 4, (1, zero, F.col("place"), comment)),
        lines(more, 4, (2, zero, zero, F.format_string(MORE.replace("{}", "%d"), "more"))),
    ]
    table = parts[0]
    for p in parts[1:]:
        table = table.unionByName(p)
    whole = F.array_join(F.sort_array(F.collect_list("x"))["line"], "\n")
    return table.groupBy(*_PAGE).agg(F.concat(F.regexp_replace(whole, f"{SPACES}+$", ""), F.lit("\n")).alias("body"))


@query(None)
def fuse_report(spark, sf_dir: str) -> DataFrame:
    """What fusing says about every recognised track: whether it repeats itself, in how many of its cues the screen shows
    something else, and the reason of its choice with these notes added once."""
    speech = records(spark, sf_dir, "cues", *_TRACK, "pos", "text", where="track = 'whisper'")
    loops = quality.repetition(speech, _TRACK).select("id", "part", "looping", "repeat_ratio", "top_text")
    crossed = timeline.agg_cross_source_all(spark, sf_dir).select("id", "part", F.col("disagreeing").alias("windows"))
    heads = records(spark, sf_dir, "transcripts", *_TRACK, "source_reason", where="track = 'whisper'").join(loops, _PAGE).join(crossed, _PAGE, "left").na.fill(0, ["windows"])
    share = F.concat(F.round(F.col("repeat_ratio") * 100, 0).cast("int").cast("string"), F.lit("%"))
    notes = F.array_compact(F.array(
        F.when(F.col("looping"), F.concat(F.lit("hallucination: ASR repeats '"), F.substring(F.coalesce("top_text", F.lit("")), 1, 30), F.lit("' for "), share, F.lit(" of cues"))),
        F.when(F.col("windows") > 0, F.format_string("cross-source: %d ASR windows disagree with overlapping OCR (OCR is the corroborated truth in those windows)", "windows")),
    ))
    note = F.concat(F.lit(" | fusion: "), F.array_join(notes, "; "))
    reason = F.coalesce("source_reason", F.lit(""))
    said = F.when((F.size(notes) > 0) & ~reason.contains(note), F.concat(reason, note)).otherwise(F.col("source_reason"))
    return heads.select("transcript_id", "looping", "repeat_ratio", "windows", said.alias("source_reason"))


@query("""with c as (select distinct cue_id, id, part, track, pos, "start", "end", text from cues), t as (select distinct transcript_id, id, part, track, source, language from transcripts),
 s as (select id, part, track, count(*) n, sum(case when text is null then 1 else 0 end) blank, min("start") a, max("end") b from c group by all), f as (select id, part, count(*) frames from (select distinct frame_id, id, part from frames) group by all)
 select transcript_id, id, part, source, language, coalesce(n, 0)::bigint as segments, coalesce(blank, 0)::bigint as blank, a as first_start, b as last_end, coalesce(frames, 0)::bigint as frames from t left join s using (id, part, track) left join f using (id, part)""")
def sink_bundle_json(spark, sf_dir: str) -> DataFrame:
    """Whole bundles, segments and frames nested, written as JSON and read back: what a reader of the documents finds."""
    cues = records(spark, sf_dir, "cues", *_TRACK, "pos", "start", "end", "text")
    segments = cues.groupBy(*_TRACK).agg(F.sort_array(F.collect_list(F.struct("pos", "start", "end", "text"))).alias("segments"))
    frames = records(spark, sf_dir, "frames", "id", "part", "ts", "phash").groupBy(*_PAGE).agg(F.sort_array(F.collect_list(F.struct("ts", "frame_id", "phash"))).alias("frames"))
    heads = records(spark, sf_dir, "transcripts", *_TRACK, "source", "language").join(segments, _TRACK, "left").join(frames, _PAGE, "left")
    body = F.to_json(F.struct("id", "part", F.struct("source", "language", "segments").alias("transcript"), "frames"))
    shape = "id string, part int, transcript struct<source:string,language:string,segments:array<struct<pos:int,start:double,`end`:double,text:string>>>, frames array<struct<ts:double,phash:string>>"
    b = heads.select("transcript_id", F.from_json(body, shape).alias("b")).select("transcript_id", "b.*").withColumn("s", F.coalesce("transcript.segments", F.array().cast("array<struct<pos:int,start:double,`end`:double,text:string>>")))
    return b.select(
        "transcript_id", "id", "part", "transcript.source", "transcript.language", F.size("s").cast("bigint").alias("segments"), F.size(F.filter("s", lambda x: x["text"].isNull())).cast("bigint").alias("blank"),
        F.array_min("s.start").alias("first_start"), F.array_max("s.end").alias("last_end"), F.coalesce(F.size("frames"), F.lit(0)).cast("bigint").alias("frames"),
    )
