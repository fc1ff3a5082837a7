"""Problem 1: pairing records of two tables by nearest time for the same entity within a tolerance."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.tables import load, to_ms


def ring_widths(tolerance: int, rings: int) -> list[int]:
    """How far the rings reach, each double the one before, the last equal to the tolerance."""
    first = max(1, -(-tolerance // 2 ** (rings - 1)))
    widths = [min(tolerance, first * 2**k) for k in range(rings)]
    return [w for k, w in enumerate(widths) if k == 0 or w > widths[k - 1]] if tolerance else [1]


def nearest_in_time(
    left: DataFrame, right: DataFrame, *, keys: Sequence[str], left_id: str, left_time: str | Column, right_id: str,
    right_time: str | Column, tolerance_ms: int, rings: int = 3,
) -> DataFrame:
    """(left id, right id, distance_ms) of the right record nearest in time to each left record, by expanding rings.

    Times are DOUBLE seconds, compared as whole milliseconds. Ring k reaches w_k to either side, doubled from ring
    to ring up to the tolerance, and cuts time into buckets of 2 w_k, so a left time looks at two adjacent buckets.
    Whatever lies within w_k is seen there, so a match at most w_k away is provably the nearest and is accepted; only
    left times without one go on to the next ring. Both sides are first reduced to distinct (keys, millisecond), so a
    bucket never holds more than 2 w_k rows a side, however many records share one key or one instant.

    Defined results: NULL or NaN times and NULL keys never match; a left record without a match gives no row; ties take
    the earlier time, then the smaller right id; repeated rows count once; an empty table on either side gives no rows;
    other columns, whatever their names, are not read.
    """
    ks = [f"_k{i}" for i in range(len(keys))]
    lt = to_ms(left_time)
    rt = to_ms(right_time)
    lefts = left.select(*(F.col(k).alias(a) for k, a in zip(keys, ks)), lt.alias("_ms"), F.col(left_id).alias("_left"))
    lefts = lefts.dropna()
    rights = right.select(*(F.col(k).alias(a) for k, a in zip(keys, ks)), rt.alias("_rms"), F.col(right_id).alias("_rid"))
    rights = rights.dropna().groupBy(*ks, "_rms").agg(F.min("_rid").alias("_rid"))
    points = lefts.select(*ks, "_ms").distinct()

    found = []
    open_points = points
    widths = ring_widths(tolerance_ms, rings)
    for n, width in enumerate(widths):
        # Never NULL by type: else the planner would push a filter on each ring's own bucket below the aggregate of the
        # right side, and the rings could no longer share that shuffle.
        at = lambda t: F.coalesce(F.floor(t / (2 * width)), F.lit(0))  # noqa: B023, E731
        reach = F.array_distinct(F.array(at(F.col("_ms") - width), at(F.col("_ms") + width)))
        probes = open_points.withColumn("_b", F.explode(reach))
        cells = rights.withColumn("_b", at(F.col("_rms")))
        gap = F.abs(F.col("_ms") - F.col("_rms"))
        near = F.min(F.when(gap <= (width if tolerance_ms else 0), F.struct(gap.alias("d"), "_rms", "_rid")))
        tried = probes.join(cells, [*ks, "_b"], "left").groupBy(*ks, "_ms").agg(near.alias("_near"))
        found.append(tried.filter(F.col("_near").isNotNull()))
        if n + 1 < len(widths):
            open_points = tried.filter(F.col("_near").isNull()).select(*ks, "_ms")
    matches = reduce(DataFrame.unionByName, found)
    pairs = lefts.join(matches, [*ks, "_ms"])
    return pairs.groupBy("_left").agg(F.min("_near").alias("_near")).select(
        F.col("_left").alias(left_id), F.col("_near._rid").alias(right_id if right_id != left_id else f"{right_id}_right"),
        F.col("_near.d").alias("distance_ms"),
    )


def p1_found(spark, sf_dir: str) -> DataFrame:
    """For each frame the nearest cue (1500 ms) and the nearest comment (400 ms) of its page."""
    frames = load(spark, sf_dir, "frames", "frame_id", "id", "part", "ts")
    cues = load(spark, sf_dir, "cues", "cue_id", "id", "part", "start")
    comments = load(spark, sf_dir, "danmaku_raw", "seq", "id", "part", "content_ts")
    page = dict(keys=["id", "part"], left_id="frame_id", left_time="ts")
    by_cue = nearest_in_time(frames, cues, **page, right_id="cue_id", right_time="start", tolerance_ms=1500)
    by_comment = nearest_in_time(frames, comments, **page, right_id="seq", right_time="content_ts", tolerance_ms=400)
    return by_cue.select(F.lit("cue").alias("kind"), "frame_id", F.col("cue_id").alias("other_id")).unionByName(
        by_comment.select(F.lit("danmaku").alias("kind"), "frame_id", F.col("seq").alias("other_id"))
    )


P1_SQL = """
with f as (select distinct frame_id, id, part, cast(round(ts * 1000) as bigint) ms from frames where ts is not null),
c as (select distinct cue_id oid, id, part, cast(round("start" * 1000) as bigint) ms from cues where "start" is not null),
d as (select distinct seq oid, id, part, cast(round(content_ts * 1000) as bigint) ms from danmaku_raw where content_ts is not null),
p as (
  select 'cue' kind, frame_id, oid, row_number() over (partition by frame_id order by abs(f.ms - c.ms), c.ms, oid) rn
  from f join c on f.id = c.id and f.part = c.part and c.ms between f.ms - 1500 and f.ms + 1500
  union all
  select 'danmaku', frame_id, oid, row_number() over (partition by frame_id order by abs(f.ms - d.ms), d.ms, oid)
  from f join d on f.id = d.id and f.part = d.part and d.ms between f.ms - 400 and f.ms + 400)
select kind, frame_id, oid as other_id from p where rn = 1
"""
