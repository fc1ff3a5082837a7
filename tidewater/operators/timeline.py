"""Grids over content time and as-of assignment of records to them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fixed_grid(duration: Column, width: float) -> Column:
    """Boundaries 0, w, 2w, ... up to the duration, inclusive of an exact multiple; only 0 for NULL or 0."""
    last = F.floor(F.coalesce(duration.cast("double"), F.lit(0.0)) / width).cast("int")
    return F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: i * F.lit(float(width)))


def chunk_boundaries(pages: DataFrame, cues: DataFrame, frames: DataFrame, keys: Sequence[str], width: float) -> DataFrame:
    """(keys, boundary) of every page: 0 and the frame times where it has frames, else a fixed grid over its duration,
    or over its last cue's end where the duration is unknown. One row per boundary, so no page is gathered."""
    framed = frames.filter("ts is not null").select(*keys, F.col("ts").alias("boundary"))
    at = framed.union(framed.select(*keys).distinct().withColumn("boundary", F.lit(0.0))).distinct()
    ends = cues.groupBy(*keys).agg(F.max("end").alias("_last"))
    bare = pages.join(framed.select(*keys).distinct(), [*keys], "left_anti").join(ends, [*keys], "left")
    end = F.coalesce(F.nullif(F.col("duration"), F.lit(0)).cast("double"), F.col("_last"))
    grid = bare.select(*keys, F.explode(fixed_grid(end, width)).alias("boundary"))
    return at.unionByName(grid)


def asof_backward(events: DataFrame, boundaries: DataFrame, keys: Sequence[str], time: str, boundary: str = "boundary", clamp: bool = True) -> DataFrame:
    """``events`` with the greatest boundary at or before their time, in one pass over both sides sorted by time.

    Events before the first boundary get the first one if ``clamp``, else NULL. Events with a NULL time get NULL.
    """
    marks = boundaries.select(*keys, F.col(boundary).alias("_t"), F.lit(0).alias("_is"), F.lit(None).cast("struct<x:int>").alias("_none")).drop("_none")
    body = F.struct(*(F.col(c) for c in events.columns))
    rows = events.select(*keys, F.col(time).alias("_t"), F.lit(1).alias("_is"), body.alias("_row"))
    both = marks.unionByName(rows, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.col("_t").asc_nulls_first(), "_is")
    seen = F.last(F.when(F.col("_is") == 0, F.col("_t")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    first = F.min(F.when(F.col("_is") == 0, F.col("_t"))).over(Window.partitionBy(*keys))
    found = F.when(F.col("_t").isNotNull(), F.coalesce(seen, first) if clamp else seen)
    return both.withColumn(boundary, found).filter("_is = 1").select("_row.*", boundary)


def fixed_window(time: Column, width: float, duration: Column | None = None) -> Column:
    """Start of the fixed window that holds a time, clamped to the first and, with a duration, to the last one."""
    n = F.greatest(F.lit(0), F.floor(time / width))
    if duration is not None:
        last = F.floor(F.coalesce(duration.cast("double"), F.lit(0.0)) / width)
        n = F.when(time.isNotNull(), F.least(n, last))
    return n * F.lit(float(width))


def gap_windows(duration: Column, gaps: Column, core: float, margin: float) -> Column:
    """Windows of at most ``core`` seconds over each gap (struct lo, hi), with margins clipped to the duration."""
    def split(g):
        n = F.ceil((g["hi"] - g["lo"]) / core).cast("int")
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(
            (g["lo"] + i * core).alias("core_start"), F.least(g["lo"] + (i + 1) * core, g["hi"]).alias("core_end"),
            F.greatest(F.lit(0.0), g["lo"] + i * core - margin).alias("start"),
            F.least(duration, F.least(g["lo"] + (i + 1) * core, g["hi"]) + margin).alias("end")))
    return F.flatten(F.transform(F.filter(gaps, lambda g: g["hi"] > g["lo"]), split))


def sliding_starts(total: Column, size: int, hop: int) -> Column:
    """Starts of windows of ``size`` every ``hop``, and of the one that ends flush with the total; none if it doesn't fit."""
    last = total - size
    return F.when(last >= 0, F.array_sort(F.array_distinct(F.concat(F.sequence(F.lit(0).cast("bigint"), last, F.lit(hop).cast("bigint")), F.array(last))))).otherwise(
        F.array().cast("array<bigint>")
    )
