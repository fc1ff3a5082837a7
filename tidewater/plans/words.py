"""Queries on word timelines: gaps, windows, lines, index coverage, membership."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.text import join_words
from tidewater.operators import folds, timeline
from tidewater.plans.base import query, records
from tidewater.tables import load

_TRACK = ["id", "part", "track"]
_W = """w as (select distinct cue_id, id, part, track, pos, "start" s, "end" e, text from cues), d as (select id, page part, duration from video_pages where duration > 0),
 m as (select w.*, duration, greatest(0.0, coalesce(max(e) over (partition by id, part, track order by pos rows between unbounded preceding and 1 preceding), 0.0)) cur from w join d using (id, part)),
 gp as (select id, part, track, duration, cur lo, s hi from m where s - cur >= 12 union all select id, part, track, duration, greatest(0.0, max(e)), duration from m group by all having duration - greatest(0.0, max(e)) >= 12)"""


def _gaps(spark, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "video_pages", "id", "page", "duration").withColumnRenamed("page", "part").filter("duration > 0")
    words = records(spark, sf_dir, "cues", *_TRACK, "pos", "start", "end").join(pages, ["id", "part"])
    before = Window.partitionBy(*_TRACK).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    words = words.withColumn("lo", F.greatest(F.lit(0.0), F.coalesce(F.max("end").over(before), F.lit(0.0))))
    inner = words.filter(F.col("start") - F.col("lo") >= 12).select(*_TRACK, "duration", "lo", F.col("start").alias("hi"))
    tail = words.groupBy(*_TRACK, "duration").agg(F.greatest(F.lit(0.0), F.max("end")).alias("lo")).filter(F.col("duration") - F.col("lo") >= 12)
    return inner.unionByName(tail.withColumn("hi", F.col("duration").cast("double")))


@query(f"with {_W} select id, part, track, round(lo, 3) as lo, round(hi, 3) as hi from gp")
def words_gap_scan(spark, sf_dir: str) -> DataFrame:
    return _gaps(spark, sf_dir).select(*_TRACK, F.round("lo", 3).alias("lo"), F.round("hi", 3).alias("hi"))


@query(f"""with {_W}, i as (select *, unnest(range(cast(ceil((hi - lo) / 54) as bigint))) k from gp) select id, part, track, round(lo + k * 54, 3) as core_start, round(least(lo + (k + 1) * 54, hi), 3) as core_end,
 round(greatest(0, lo + k * 54 - 3), 3) as w_start, round(least(duration, least(lo + (k + 1) * 54, hi) + 3), 3) as w_end from i""")
def words_short_windows(spark, sf_dir: str) -> DataFrame:
    one = F.array(F.struct(F.col("lo").alias("lo"), F.col("hi").alias("hi")))
    rows = _gaps(spark, sf_dir).withColumn("x", F.explode(timeline.gap_windows(F.col("duration").cast("double"), one, 54.0, 3.0)))
    r = lambda c, a: F.round(F.col(c), 3).alias(a)
    return rows.select(*_TRACK, r("x.core_start", "core_start"), r("x.core_end", "core_end"), r("x.start", "w_start"), r("x.end", "w_end"))


@query(f"with {_W} select cue_id, coalesce(e > lead(s) over (partition by id, part, track order by pos) + 0.3, false) as overlaps, coalesce(s > lag(s) over (partition by id, part, track order by pos), true) as ahead from w")
def words_neighbours(spark, sf_dir: str) -> DataFrame:
    w = Window.partitionBy(*_TRACK).orderBy("pos")
    rows = records(spark, sf_dir, "cues", *_TRACK, "pos", "start", "end")
    return rows.select(
        "cue_id", F.coalesce(F.col("end") > F.lead("start").over(w) + 0.3, F.lit(False)).alias("overlaps"), F.coalesce(F.col("start") > F.lag("start").over(w), F.lit(True)).alias("ahead")
    )


_LINES = """w as (select distinct id, part, track, pos, "start" s, "end" e from cues), r as (select *, row_number() over (partition by id, part, track order by pos) rn from w),
 x as (select id, part, track, rn, pos, s, e, s f, pos first, 1 n from r where rn = 1 union all
 select r.id, r.part, r.track, r.rn, r.pos, r.s, r.e, case when b then r.s else x.f end, case when b then r.pos else x.first end, case when b then 1 else x.n + 1 end
 from x join r on r.id = x.id and r.part = x.part and r.track = x.track and r.rn = x.rn + 1, lateral (select x.n >= 12 or x.e - x.f >= 8 or r.s - x.e > 1.8 b)),
 ln as (select id, part, track, first, max(pos) as last from x group by id, part, track, first)"""


def _lines(spark, sf_dir: str) -> DataFrame:
    return folds.line_breaks(records(spark, sf_dir, "cues", *_TRACK, "pos", "start", "end"), _TRACK, "pos")


@query(f"with recursive {_LINES} select id, part, track, first, last from ln")
def words_line_breaks(spark, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir)


@query(f"""with recursive {_LINES}, c as (select *, lag(last) over (partition by id, part, track order by first) before from ln)
 select id, part, track, count(*) as lines, bool_and(last >= first and (before is null or first = before + 1)) as sound from c group by all""")
def words_index_partition(spark, sf_dir: str) -> DataFrame:
    before = F.lag("last").over(Window.partitionBy(*_TRACK).orderBy("first"))
    rows = _lines(spark, sf_dir).withColumn("before", before)
    sound = (F.col("last") >= F.col("first")) & (F.col("before").isNull() | (F.col("first") == F.col("before") + 1))
    return rows.groupBy(*_TRACK).agg(F.count("*").alias("lines"), F.bool_and(sound).alias("sound"))


@query(f"""with recursive {_LINES}, c as (select id, part, track, unnest(range(first, last + 1)) pos from ln where last > first) select w.id, w.part, w.track, w.pos from w anti join c using (id, part, track, pos)""")
def words_missing_indices(spark, sf_dir: str) -> DataFrame:
    """Positions that no line of two words or more covers."""
    covered = _lines(spark, sf_dir).filter("last > first").select(*_TRACK, F.explode(F.sequence("first", "last")).alias("pos"))
    return records(spark, sf_dir, "cues", *_TRACK, "pos").select(*_TRACK, "pos").join(covered, [*_TRACK, "pos"], "left_anti")


@query("""with w as (select distinct cue_id, id, part, ("start" + "end") / 2 mid from cues), c as (select distinct id clip, source id, coalesce(part, 1) part, "start" s, "end" e from clip_inputs where "end" > "start")
 select clip, cue_id from w join c on w.id = c.id and w.part = c.part and mid >= s and mid < e""")
def join_midpoint_range(spark, sf_dir: str) -> DataFrame:
    words = records(spark, sf_dir, "cues", "id", "part", "start", "end").withColumn("mid", (F.col("start") + F.col("end")) / 2).select("cue_id", "id", "part", "mid")
    clips = records(spark, sf_dir, "clip_inputs", "source", "part", "start", "end").filter(F.col("end") > F.col("start"))
    clips = clips.select(F.col("id").alias("clip"), F.col("source").alias("id"), F.coalesce("part", F.lit(1)).alias("part"), F.col("start").alias("s"), F.col("end").alias("e"))
    cells = clips.withColumn("b", F.explode(F.sequence(F.floor(F.col("s") / 16), F.floor(F.col("e") / 16))))
    hits = words.withColumn("b", F.floor(F.col("mid") / 16)).join(cells, ["id", "part", "b"])
    return hits.filter((F.col("mid") >= F.col("s")) & (F.col("mid") < F.col("e"))).select("clip", "cue_id")


@query("""with t as (select distinct cue_id, id, part, track, pos, text from cues where text is not null and text <> '' and regexp_full_match(text, '[A-Za-z0-9 .,]+')) select id, part, track, string_agg(text, ' ' order by pos) as line from t
 where regexp_full_match(text, '[A-Za-z0-9][A-Za-z0-9 .,]*[A-Za-z0-9]') group by all""")
def words_join(spark, sf_dir: str) -> DataFrame:
    words = records(spark, sf_dir, "cues", *_TRACK, "pos", "text").filter(F.col("text").rlike("^[A-Za-z0-9][A-Za-z0-9 .,]*[A-Za-z0-9]$"))
    return words.groupBy(*_TRACK).agg(F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("x")).select(*_TRACK, join_words(F.col("x.text")).alias("line"))


@query(None)
def words_join_all(spark, sf_dir: str) -> DataFrame:
    """``words_join`` over every cue with text, whatever its script and punctuation; the tests hold it against a plain loop."""
    words = records(spark, sf_dir, "cues", *_TRACK, "pos", "text", where="text is not null")
    return words.groupBy(*_TRACK).agg(F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("x")).select(*_TRACK, join_words(F.col("x.text")).alias("line"))


@query("""with recursive w as (select distinct id, part, track, pos, "start" - pos * 3.0 v from cues), r as (select *, row_number() over (partition by id, part, track order by pos) rn from w),
 x as (select id, part, track, rn, pos, pos first, v head from r where rn = 1 union all
 select r.id, r.part, r.track, r.rn, r.pos, case when abs(x.head - r.v) < 2 then x.first else r.pos end, case when abs(x.head - r.v) < 2 then x.head else r.v end
 from x join r on r.id = x.id and r.part = x.part and r.track = x.track and r.rn = x.rn + 1) select id, part, track, first, max(pos) as last, round(min(head), 3) as value from x group by id, part, track, first""")
def words_merged_offsets(spark, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir, "cues", *_TRACK, "pos", "start").withColumn("v", F.col("start") - F.col("pos") * 3.0)
    return folds.merged_offsets(rows, _TRACK, "pos", "v", 2.0).withColumn("value", F.round("value", 3))
