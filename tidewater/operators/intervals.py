"""Problem 5: merging overlapping intervals per entity and listing the gaps between the merged periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.tables import cut_lineage, load, to_ms

SHARD_MS = 262_144


def merge_intervals(
    df: DataFrame, *, keys: Sequence[str], record: str | Sequence[str], start: str, end: str, min_gap: int = 1,
    shard: int = SHARD_MS,
) -> DataFrame:
    """(keys, kind, start, end, shared) of the merged periods and of the gaps between them.

    Time is discretised into exact units (BIGINT ``start`` and ``end``, half-open) and cut into shards. Each (entity,
    shard) has a run bitmap: its set runs, as arrays of their bounds. It is the union of all intervals there, made from
    the positions at which the number of covering records changes; these are summed before the shuffle, so a shard
    never has more than ``shard`` + 1 of them however many records there are. A shard that an interval covers entirely
    is one set bit in a second bitmap whose units are shards, so a very long interval costs three rows. The bitmaps are
    written once. Runs and clear runs inside a shard come out of its bitmap alone; only runs that touch a shard's edge
    are stitched, at most two per shard.

    ``kind`` is ``period`` or ``gap``; ``shared`` tells whether somewhere in the period at least two records overlap by
    more than nothing (NULL for gaps). Gaps shorter than ``min_gap`` are left out.

    Defined results: intervals with a NULL bound or end <= start are left out; NULL keys form their own entity; records
    are told apart by ``record`` and count once however often repeated; intervals that touch merge without sharing; an
    empty table gives no rows; other columns, whatever their names, are not read.
    """
    ks = [f"_k{i}" for i in range(len(keys))]
    maps = cut_lineage(run_bitmaps(df, keys, record, start, end, shard))
    size = F.lit(shard).cast("bigint")
    base = F.col("sh") * size

    # The bitmap over whole shards, and of each shard its outermost runs.
    by_entity = Window.partitionBy(*ks).orderBy("sh")
    n = F.size("lo")
    run = lambda i: F.struct((base + F.get("lo", i)).alias("s"), (base + F.get("hi", i)).alias("e"), F.get("two", i).alias("two"))
    shards = maps.select(*ks, "sh", "d", n.alias("n"), F.when(n > 0, run(F.lit(0))).alias("head"), F.when(n > 0, run(n - 1)).alias("tail"))
    shards = shards.withColumn("depth", F.sum("d").over(by_entity)).withColumn("next", F.lead("sh").over(by_entity))
    whole = F.struct(base.alias("s"), (F.col("next") * size).alias("e"), ((F.col("depth") > 1) | (F.col("n") > 0)).alias("two"))
    none = F.lit(None).cast("struct<s:bigint,e:bigint,two:boolean>")
    at_start, at_end = F.col("head.s") == base, F.col("tail.e") == base + size
    edges = F.array(F.when(at_start, F.col("head")).otherwise(none), F.when(at_end & ~(at_start & (F.col("n") == 1)), F.col("tail")).otherwise(none))
    covered = F.col("depth") > 0
    pieces = shards.select(*ks, F.explode(F.array_compact(F.when(covered, F.array(whole)).otherwise(edges))).alias("x")).select(*ks, "x.*")
    by_start = Window.partitionBy(*ks).orderBy("s", "e")
    so_far = F.max("e").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    stitched = (
        pieces.withColumn("new", F.when(F.col("s") <= so_far, 0).otherwise(1))
        .withColumn("grp", F.sum("new").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*ks, "grp").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.max("two").alias("shared"))
        .select(*ks, F.lit("period").alias("kind"), "s", "e", "shared")
    )
    no = F.lit(None).cast("boolean")
    bounds = shards.filter(covered | (F.col("n") > 0)).select(
        *ks, F.when(covered, base).otherwise(F.col("head.s")).alias("s"), F.when(covered, F.col("next") * size).otherwise(F.col("tail.e")).alias("e")
    )
    across = bounds.select(*ks, F.lit("gap").alias("kind"), so_far.alias("from"), F.col("s").alias("to"))
    across = across.filter(F.col("to") - F.col("from") >= max(1, min_gap)).select(*ks, "kind", F.col("from").alias("s"), F.col("to").alias("e"), no.alias("shared"))

    # Set and clear runs inside the shards that no interval covers entirely.
    under = shards.filter(covered & (F.col("n") > 0)).select(*(F.col(k).alias(f"c{k}") for k in ks), F.col("sh").alias("csh"))
    same = [F.col(k).eqNullSafe(F.col(f"c{k}")) for k in ks] + [F.col("sh") == F.col("csh")]
    zipped = F.arrays_zip("lo", "hi", "two", F.slice("lo", F.lit(2), F.greatest(n, F.lit(1))).alias("after"))
    runs = maps.filter(n > 0).join(under, same, "left_anti").select(*ks, base.alias("base"), F.explode(zipped).alias("r")).select(*ks, "base", "r.*")
    row = lambda kind, s, e, shared: F.struct(F.lit(kind).alias("kind"), (F.col("base") + s).alias("s"), (F.col("base") + e).alias("e"), shared.alias("shared"))
    inner = F.when((F.col("lo") > 0) & (F.col("hi") < size), row("period", F.col("lo"), F.col("hi"), F.col("two")))
    clear = F.when(F.col("after") - F.col("hi") >= max(1, min_gap), row("gap", F.col("hi"), F.col("after"), no))
    within = runs.select(*ks, F.explode(F.array_compact(F.array(inner, clear))).alias("x")).select(*ks, "x.*")
    out = within.unionByName(stitched).unionByName(across)
    return out.select(*(F.col(a).alias(k) for k, a in zip(keys, ks)), "kind", F.col("s").alias(start), F.col("e").alias(end), "shared")


def run_bitmaps(df: DataFrame, keys: Sequence[str], record: str | Sequence[str], start: str, end: str, shard: int = SHARD_MS) -> DataFrame:
    """(keys as _k0, ..., sh, lo, hi, two, d): the run bitmap of every entity and shard of time.

    ``lo`` and ``hi`` are the bounds of its set runs inside the shard, in order, and ``two`` tells which of them two records
    share somewhere. ``d`` is by how many the records change that cover whole shards from this one on.
    """
    ks = [f"_k{i}" for i in range(len(keys))]
    rec = [record] if isinstance(record, str) else list(record)
    rows = df.select(
        *(F.col(k).alias(a) for k, a in zip(keys, ks)), *(F.col(r).alias(f"_r{i}") for i, r in enumerate(rec)),
        F.col(start).cast("bigint").alias("_s"), F.col(end).cast("bigint").alias("_e"),
    ).filter(F.col("_e") > F.col("_s")).distinct()
    size = F.lit(shard).cast("bigint")
    first, last = F.floor(F.col("_s") / size).cast("bigint"), F.floor((F.col("_e") - 1) / size).cast("bigint")
    edge = lambda sh, pos, d: F.struct(sh.alias("sh"), pos.cast("int").alias("pos"), F.lit(d).alias("d"))
    head = F.array(edge(first, F.col("_s") - first * size, 1), edge(first, F.least(F.col("_e") - first * size, size), -1))
    tail = F.array(edge(last, F.lit(0), 1), edge(last, F.col("_e") - last * size, -1))
    # Position -1 marks the bitmap over whole shards.
    middle = F.array(edge(first + 1, F.lit(-1), 1), edge(last, F.lit(-1), -1))
    none = F.array().cast("array<struct<sh:bigint,pos:int,d:int>>")
    pieces = F.concat(head, F.when(last > first, tail).otherwise(none), F.when(last > first + 1, middle).otherwise(none))
    changes = rows.select(*ks, F.explode(pieces).alias("x")).select(*ks, "x.*").groupBy(*ks, "sh", "pos").agg(F.sum("d").alias("d"))
    w = Window.partitionBy(*ks, "sh").orderBy("pos")
    step = F.when(F.col("pos") >= 0, F.col("d")).otherwise(0)
    steps = changes.withColumn("depth", F.sum(step).over(w)).withColumn("prior", F.col("depth") - step)
    opens = F.sum(F.when((F.col("prior") == 0) & (F.col("depth") > 0), 1).otherwise(0)).over(w)
    runs = steps.withColumn("run", F.when(F.col("pos") >= 0, opens)).groupBy(*ks, "sh", "run").agg(
        F.min("pos").alias("lo"), F.max("pos").alias("hi"), (F.max("depth") > 1).alias("two"), F.sum("d").alias("d")
    )
    set_run = F.when(F.col("run").isNotNull(), F.struct("lo", "hi", "two"))
    maps = runs.groupBy(*ks, "sh").agg(F.sort_array(F.collect_list(set_run)).alias("x"), F.coalesce(F.sum(F.when(F.col("run").isNull(), F.col("d"))), F.lit(0)).alias("d"))
    return maps.select(*ks, "sh", F.col("x.lo").alias("lo"), F.col("x.hi").alias("hi"), F.col("x.two").alias("two"), "d")


def _all_intervals(spark, sf_dir: str) -> DataFrame:
    cues = load(spark, sf_dir, "cues", "id", "part", "track", "cue_id", "start", "end").select(
        F.lit("cues").alias("tab"), "id", "part", "track", F.col("cue_id").cast("string").alias("rec"),
        to_ms("start").alias("start_ms"), to_ms("end").alias("end_ms"),
    )
    clips = load(spark, sf_dir, "clip_inputs", "id", "source", "part", "start", "end").select(
        F.col("id").alias("rec"), F.col("source").alias("id"), F.coalesce("part", F.lit(1)).cast("int").alias("part"), "start", "end"
    )
    open_ended = clips.filter(F.col("end").isNull())
    pages = load(spark, sf_dir, "video_pages", "id", "page", "duration").select("id", F.col("page").alias("part"), "duration")
    closed = clips.filter(F.col("end").isNotNull()).select("rec", "id", "part", to_ms("start").alias("start_ms"), to_ms("end").alias("end_ms"))
    ended = open_ended.join(pages, ["id", "part"], "left").select(
        "rec", "id", "part", to_ms("start").alias("start_ms"), (F.col("duration").cast("bigint") * 1000).alias("end_ms")
    )
    clips = closed.unionByName(ended).withColumn("tab", F.lit("clip_inputs")).withColumn("track", F.lit(""))
    return cues.unionByName(clips)


def interval_periods(spark, sf_dir: str) -> DataFrame:
    """Every merged period and every gap of the cues of a track and of the clips of a page."""
    out = merge_intervals(_all_intervals(spark, sf_dir), keys=["tab", "id", "part", "track"], record="rec", start="start_ms", end="end_ms")
    return out.select("tab", "id", "part", "track", "kind", "start_ms", "end_ms", "shared")


def p5_found(spark, sf_dir: str) -> DataFrame:
    """Periods in which at least two records overlap, and gaps of at least 3000 ms."""
    out = merge_intervals(
        _all_intervals(spark, sf_dir), keys=["tab", "id", "part", "track"], record="rec", start="start_ms", end="end_ms", min_gap=3000
    )
    return out.filter((F.col("kind") == "gap") | F.col("shared")).select("tab", "id", "part", "track", "kind", "start_ms", "end_ms")


_P5_CTE = """
with iv as (
  select distinct 'cues' tab, id, part, track, cast(cue_id as varchar) rec, cast(round("start" * 1000) as bigint) s,
    cast(round("end" * 1000) as bigint) e from cues
  union
  select 'clip_inputs', c.source, coalesce(c.part, 1), '', c.id, cast(round(c."start" * 1000) as bigint),
    case when c."end" is null then cast(v.duration as bigint) * 1000 else cast(round(c."end" * 1000) as bigint) end
  from (select distinct * from clip_inputs) c left join video_pages v on v.id = c.source and v.page = coalesce(c.part, 1)),
ok as (select * from iv where e > s),
m as (select *, max(e) over (partition by tab, id, part, track order by s, e, rec rows between unbounded preceding and 1 preceding) pe from ok),
g as (select *, sum(case when pe is null or s > pe then 1 else 0 end) over (partition by tab, id, part, track order by s, e, rec rows unbounded preceding) grp from m),
p as (select tab, id, part, track, grp, min(s) s, max(e) e, bool_or(coalesce(s < pe, false)) shared from g group by all),
n as (select *, lead(s) over (partition by tab, id, part, track order by s) ns from p)
"""
P5_SQL = _P5_CTE + """
select tab, id, part, track, 'period' kind, s as start_ms, e as end_ms from p where shared
union all select tab, id, part, track, 'gap', e, ns from n where ns - e >= 3000
"""
PERIODS_SQL = _P5_CTE + """
select tab, id, part, track, 'period' kind, s as start_ms, e as end_ms, shared from p
union all select tab, id, part, track, 'gap', e, ns, null from n where ns > e
"""
