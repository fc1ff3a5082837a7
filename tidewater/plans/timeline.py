"""Queries on content time: grids, chunks, windows, crowd tracks, overlaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.python import sequence_ratio
from tidewater.functions.text import comparison_key, source_key, stripped
from tidewater.operators import overlap, timeline
from tidewater.plans.base import query, records
from tidewater.tables import load

WIDTH, CROWD, CAP = 60.0, 15.0, 15
_GRID = """
pg as (select id, page part, duration from video_pages), cu as (select distinct * from cues), fr as (select distinct * from frames where ts is not null),
ce as (select id, part, max("end") last from cu group by 1, 2),
b as (select id, part, ts boundary from fr union select distinct id, part, 0.0 from fr
 union all select id, part, unnest(range(cast(floor(coalesce(coalesce(nullif(duration, 0), last), 0) / 60.0) as bigint) + 1)) * 60.0
 from pg left join ce using (id, part) where (id, part) not in (select id, part from fr)),
"""


def _grid(spark, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    pages = load(spark, sf_dir, "video_pages", "id", "page", "duration").withColumnRenamed("page", "part")
    cues = records(spark, sf_dir, "cues", "id", "part", "track", "pos", "start", "end", "text")
    frames = records(spark, sf_dir, "frames", "id", "part", "ts")
    return timeline.chunk_boundaries(pages, cues, frames, ["id", "part"], WIDTH), cues, frames


@query(f"with {_GRID} x as (select 1) select id, part, boundary from b")
def grid_chunk_boundaries(spark, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir)[0].select("id", "part", "boundary")


@query(f"""with {_GRID} c as (select cue_id, (select max(boundary) from b where b.id = cu.id and b.part = cu.part and b.boundary <= cu."start") boundary,
 (select min(boundary) from b where b.id = cu.id and b.part = cu.part) first from cu where exists (select 1 from b where b.id = cu.id and b.part = cu.part))
 select cue_id, coalesce(boundary, first) as boundary from c""")
def join_cue_chunk(spark, sf_dir: str) -> DataFrame:
    bounds, cues, _ = _grid(spark, sf_dir)
    return timeline.asof_backward(cues, bounds, ["id", "part"], "start").filter("boundary is not null").select("cue_id", "boundary")


@query(f"""with {_GRID} f as (select frame_id, (select max(boundary) from b where b.id = fr.id and b.part = fr.part and b.boundary <= fr.ts) boundary from fr) select frame_id, boundary from f""")
def join_frame_chunk(spark, sf_dir: str) -> DataFrame:
    bounds, _, frames = _grid(spark, sf_dir)
    return timeline.asof_backward(frames.filter("ts is not null"), bounds, ["id", "part"], "ts").select("frame_id", "boundary")


@query(r"""with t as (select distinct id, part, track, pos, "start", text from cues where "start" is not null)
 select id, part, track, floor("start" / 60.0) * 60.0 as chunk, count(*) as n, regexp_replace(string_agg(coalesce(text, ''), '' order by pos), '^[\s　]+|[\s　]+$', '', 'g') as body from t group by all""")
def timeline_chunks(spark, sf_dir: str) -> DataFrame:
    """Chunks of 60 s with the texts of their cues in order, none between them."""
    cues = records(spark, sf_dir, "cues", "id", "part", "track", "pos", "start", "text", where="start is not null")
    cues = cues.withColumn("chunk", timeline.fixed_window(F.col("start"), WIDTH))
    line = F.sort_array(F.collect_list(F.struct("pos", F.coalesce("text", F.lit("")).alias("t"))))
    return cues.groupBy("id", "part", "track", "chunk").agg(F.count("*").alias("n"), stripped(F.array_join(line["t"], "")).alias("body"))


_CROWD = """dm as (select distinct * from danmaku_raw where text is not null and content_ts is not null),
 dw as (select dm.*, case when coalesce(duration, 0) = 0 then 0.0 else least(greatest(floor(content_ts / 15.0), 0), floor(duration / 15.0)) * 15.0 end w, (high_like or author is not null) elevated
 from dm join video_pages v on dm.id = v.id and dm.part = v.page)"""


def _crowd(spark, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "video_pages", "id", "page", "duration").withColumnRenamed("page", "part")
    rows = records(spark, sf_dir, "danmaku_raw", "id", "part", "content_ts", "text", "high_like", "author", where="text is not null and content_ts is not null")
    rows = rows.join(pages, ["id", "part"])
    return rows.withColumn("w", timeline.fixed_window(F.col("content_ts"), CROWD, F.col("duration"))).withColumn("elevated", F.col("high_like") | F.col("author").isNotNull())


@query(f"with {_CROWD} select id, part, w, count(*) as total, count(distinct text) as texts from dw group by all")
def crowd_windows(spark, sf_dir: str) -> DataFrame:
    return _crowd(spark, sf_dir).groupBy("id", "part", "w").agg(F.count("*").alias("total"), F.count_distinct("text").alias("texts"))


@query(f"with {_CROWD} select id, part, w, text, count(*) as n, min(content_ts) as first_ts, min(seq) as first_seq from dw where not elevated group by all")
def crowd_exact_dedup(spark, sf_dir: str) -> DataFrame:
    plain = _crowd(spark, sf_dir).filter("not elevated")
    return plain.groupBy("id", "part", "w", "text").agg(F.count("*").alias("n"), F.min("content_ts").alias("first_ts"), F.min("seq").alias("first_seq"))


@query(f"with {_CROWD} select id, part, w, text, high_like, author, count(*) as n, min(content_ts) as first_ts from dw where elevated group by all")
def crowd_elevated_dedup(spark, sf_dir: str) -> DataFrame:
    raised = _crowd(spark, sf_dir).filter("elevated")
    return raised.groupBy("id", "part", "w", "text", "high_like", "author").agg(F.count("*").alias("n"), F.min("content_ts").alias("first_ts"))


def _lines(rows: DataFrame) -> DataFrame:
    """Lines of each window: ordinary ones merged by their comparison key and shown by the most frequent wording, raised
    ones by wording, promotion and author; in order of first appearance, ordinary before raised at the same time."""
    plain = rows.filter("not elevated").withColumn("k", comparison_key(F.col("text"))).groupBy("id", "part", "w", "k", "text").agg(
        F.count("*").alias("n"), F.min("content_ts").alias("ts"), F.min("seq").alias("seq")
    )
    plain = plain.groupBy("id", "part", "w", "k").agg(
        F.max_by("text", F.struct("n", (-F.col("seq")).alias("s"))).alias("text"), F.sum("n").alias("n"), F.min("ts").alias("ts"), F.min("seq").alias("seq")
    )
    raised = rows.filter("elevated").groupBy("id", "part", "w", "text", "high_like", "author").agg(F.count("*").alias("n"), F.min("content_ts").alias("ts"), F.min("seq").alias("seq"))
    plain = plain.select("id", "part", "w", "text", "n", "ts", "seq", F.lit(False).alias("elevated"), F.lit(False).alias("high_like"), F.lit(None).cast("string").alias("author"))
    return plain.unionByName(raised.select("id", "part", "w", "text", "n", "ts", "seq", F.lit(True).alias("elevated"), "high_like", "author"))


_KEY = r"lower(trim(regexp_replace(text, '[\s　]+', '', 'g'), '，。！？、!?.,;:：…—-()（）\"''*'))"
_LINES = f"""{_CROWD}, p1 as (select id, part, w, {_KEY} k, text, count(*) n, min(content_ts) ts, min(seq) seq from dw where not elevated group by all),
 p2 as (select id, part, w, k, (array_agg(text order by n desc, seq))[1] text, sum(n)::bigint n, min(ts) ts, min(seq) seq from p1 group by all),
 ln as (select id, part, w, text, n, ts, seq, false elevated, false high_like, null author from p2 union all
 select id, part, w, text, count(*), min(content_ts), min(seq), true, high_like, author from dw where elevated group by id, part, w, text, high_like, author),
 od as (select *, row_number() over (partition by id, part, w order by ts, elevated, seq, text) place,
 sum(case when elevated then 0 else 1 end) over (partition by id, part, w order by ts, elevated, seq, text rows unbounded preceding) ordinary from ln)"""


@query(f"with {_LINES} select id, part, w, place, text, n, elevated from od")
def crowd_interleave(spark, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("id", "part", "w").orderBy("ts", "elevated", "seq", "text")
    return _lines(_crowd(spark, sf_dir)).select("id", "part", "w", F.row_number().over(order).alias("place"), "text", "n", "elevated")


@query(f"""with {_LINES} select id, part, w, count(*) filter (where elevated or ordinary <= {CAP}) as shown, greatest(0, count(*) filter (where not elevated) - {CAP}) as more from od group by all""")
def crowd_overflow_cap(spark, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("id", "part", "w").orderBy("ts", "elevated", "seq", "text").rowsBetween(Window.unboundedPreceding, 0)
    rows = _lines(_crowd(spark, sf_dir)).withColumn("ordinary", F.sum(F.when(F.col("elevated"), 0).otherwise(1)).over(order))
    return rows.groupBy("id", "part", "w").agg(
        F.count_if(F.col("elevated") | (F.col("ordinary") <= CAP)).alias("shown"), F.greatest(F.lit(0), F.count_if(~F.col("elevated")) - CAP).alias("more")
    )


@query("""select seq, row_number() over (partition by id, part order by content_ts, seq) as place from (select distinct * from danmaku_raw where content_ts is not null)""")
def crowd_census_order(spark, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir, "danmaku_raw", "id", "part", "content_ts", where="content_ts is not null")
    return rows.select("seq", F.row_number().over(Window.partitionBy("id", "part").orderBy("content_ts", "seq")).alias("place"))


_PAIRS = """s as (select distinct cue_id, id, part, "start", "end", text from cues where track = 'whisper' and "end" > "start"),
 o as (select distinct cue_id, id, part, "start", "end", text from cues where track = 'ocr' and "end" > "start"),
 p as (select s.cue_id, o.cue_id r_cue_id, s.text, o.text r_text from s join o on s.id = o.id and s.part = o.part and o."end" > s."start" and o."start" < s."end")"""


def _speech_and_screen(spark, sf_dir: str) -> DataFrame:
    cues = records(spark, sf_dir, "cues", "id", "part", "track", "start", "end", "text")
    pick = lambda t: cues.filter(F.col("track") == t).select("cue_id", "id", "part", "start", "end", "text")
    return overlap.overlap_join(pick("whisper"), pick("ocr"), keys=["id", "part"])


@query(f"with {_PAIRS} select cue_id, r_cue_id from p")
def join_overlap(spark, sf_dir: str) -> DataFrame:
    return _speech_and_screen(spark, sf_dir).select("cue_id", "r_cue_id")


_SIM = r"""case when length(a) = 0 or length(b) = 0 then 0.0 when a = b then 1.0 else 1 - levenshtein(a, b) / greatest(length(a), length(b)) end"""
_BEST = f"""{_PAIRS}, n as (select cue_id, length(coalesce(text, '')) la, coalesce(regexp_replace(text, '[^a-zA-Z0-9 ]', '', 'g'), '') a, coalesce(regexp_replace(r_text, '[^a-zA-Z0-9 ]', '', 'g'), '') b from p),
 bst as (select cue_id, round(max({_SIM}), 4) best from n group by 1)"""


def _best(spark, sf_dir: str) -> DataFrame:
    # Edit distance counts bytes in the SQL engine: the comparison is on ASCII letters there and here.
    bare = lambda c: F.coalesce(F.regexp_replace(c, "[^a-zA-Z0-9 ]", ""), F.lit(""))
    return _speech_and_screen(spark, sf_dir).groupBy("cue_id").agg(F.round(F.max(overlap.similarity(bare("text"), bare("r_text"))), 4).alias("best"))


@query(f"with {_BEST} select cue_id, best from bst")
def join_best_overlap(spark, sf_dir: str) -> DataFrame:
    return _best(spark, sf_dir)


@query(None)
def join_best_overlap_all(spark, sf_dir: str) -> DataFrame:
    """``join_best_overlap`` on whole texts of any script, by the share of matching characters."""
    ratio = sequence_ratio(source_key(F.col("text")), source_key(F.col("r_text")))
    return _speech_and_screen(spark, sf_dir).withColumn("ratio", ratio).groupBy("cue_id").agg(F.max("ratio").alias("best"))


@query(None)
def agg_cross_source_all(spark, sf_dir: str) -> DataFrame:
    """``agg_cross_source`` by the best of ``join_best_overlap_all``."""
    where = records(spark, sf_dir, "cues", "id", "part").select("cue_id", "id", "part")
    best = join_best_overlap_all(spark, sf_dir).join(where, "cue_id")
    return best.groupBy("id", "part").agg(F.count("*").alias("windows"), F.count_if(F.col("best") < 0.30).alias("disagreeing"))


@query(f"with {_BEST} select c.id, c.part, count(*) as windows, count(*) filter (where best < 0.30) as disagreeing from bst join (select distinct cue_id, id, part from cues) c using (cue_id) group by all")
def agg_cross_source(spark, sf_dir: str) -> DataFrame:
    where = records(spark, sf_dir, "cues", "id", "part").select("cue_id", "id", "part")
    return _best(spark, sf_dir).join(where, "cue_id").groupBy("id", "part").agg(F.count("*").alias("windows"), F.count_if(F.col("best") < 0.30).alias("disagreeing"))


@query("""select id, page, len(w) as windows, cast(list_last(w) as double) as last_start from (select id, page, case when duration >= 6 then list_sort(list_distinct(list_concat(range(0, duration - 5, 3), [duration - 6]))) else [] end w from video_pages where duration is not null)""")
def grid_sliding_windows(spark, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "video_pages", "id", "page", "duration").filter("duration is not null")
    rows = rows.withColumn("w", timeline.sliding_starts(F.col("duration").cast("bigint"), 6, 3))
    return rows.select("id", "page", F.size("w").alias("windows"), F.try_element_at("w", F.lit(-1)).cast("double").alias("last_start"))


@query("""select id, page, n, round(duration * 1.0 / n * 0.5, 4) as first_probe from (select id, page, duration, greatest(3, duration // 30) n from video_pages where duration > 0)""")
def grid_probe_times(spark, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "video_pages", "id", "page", "duration").filter("duration > 0").withColumn("n", F.greatest(F.lit(3), F.floor(F.col("duration") / 30)))
    return rows.select("id", "page", "n", F.round(F.col("duration") / F.col("n") * 0.5, 4).alias("first_probe"))


@query("""select cue_id, (row_number() over (partition by id, part, track order by pos) - 1) // 20 as batch from (select distinct cue_id, id, part, track, pos from cues)""")
def grid_batches(spark, sf_dir: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("id", "part", "track").orderBy("pos"))
    return records(spark, sf_dir, "cues", "id", "part", "track", "pos").select("cue_id", F.floor((n - 1) / 20).alias("batch"))


@query("select id, unnest(range(1, max(page) + 1)) as part from video_pages group by id")
def grid_part_selection(spark, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "video_pages", "id", "page").groupBy("id").agg(F.max("page").alias("n")).select("id", F.explode(F.sequence(F.lit(1), "n")).alias("part"))
