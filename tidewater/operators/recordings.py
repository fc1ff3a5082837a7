"""Telling whether one recording is part of another, window by window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.signal import HOP_S, MATCH, RATE, WINDOW_S, best_place
from tidewater.operators import folds, timeline

_BYTES = 4


def window_matches(pairs: DataFrame, keys: list[str], samples: str, reference: str) -> DataFrame:
    """(keys, cells, start, at, correlation, match) of every window of a recording against its reference.

    Each window is a row with its own samples, so the windows of a long recording spread over tasks. ``cells`` is the
    recording's length in tenths of a second; ``start`` and ``at`` count samples.
    """
    n = (F.octet_length(samples) / _BYTES).cast("bigint")
    rows = pairs.select(*keys, n.alias("n"), F.col(samples).alias("_s"), F.col(reference).alias("_r"))
    rows = rows.select(*keys, "n", F.explode(timeline.sliding_starts(F.col("n"), WINDOW_S * RATE, HOP_S * RATE)).alias("start"), "_s", "_r")
    piece = F.substring(F.col("_s"), (F.col("start") * _BYTES + 1).cast("int"), F.lit(WINDOW_S * RATE * _BYTES))
    rows = rows.withColumn("x", best_place(piece, F.col("_r")))
    good = (F.col("x.correlation") >= MATCH["correlation"]) & (F.col("x.median") >= MATCH["median"]) & (F.col("x.fifth") >= MATCH["fifth"])
    cells = F.ceil(F.col("n") * 10 / RATE)
    return rows.select(*keys, cells.alias("cells"), "start", "x.at", "x.correlation", F.coalesce(good, F.lit(False)).alias("match"))


def offsets(windows: DataFrame, keys: list[str], within: float = 0.01) -> DataFrame:
    """(keys, first, last, value): stretches of matching windows whose offset in seconds stays the same."""
    good = windows.filter("match").withColumn("value", (F.col("at") - F.col("start")) / RATE)
    return folds.merged_offsets(good, keys, "start", "value", within)


def decisions(pairs: DataFrame, keys: list[str], samples: str, reference: str) -> DataFrame:
    """(keys, decision, fraction, coverage, longest_gap) of every pair.

    Tenths of a second that no matching window covers make up gaps, found from the windows' bounds. Recordings of fewer
    than eight seconds, and NULL ones, are too short to tell.
    """
    w = Window.partitionBy(*keys).orderBy("start")
    rows = window_matches(pairs, keys, samples, reference)
    lo, hi = F.col("start") * 10 / RATE, (F.col("start") + WINDOW_S * RATE) * 10 / RATE
    good = rows.filter("match").select(*keys, "cells", "start", "at", F.bround(lo).cast("bigint").alias("lo"), F.least("cells", F.bround(hi).cast("bigint")).alias("hi"))
    good = good.withColumn("gap", F.greatest(F.lit(0), F.col("lo") - F.coalesce(F.lag("hi").over(w), F.lit(0)))).withColumn("back", F.col("at") <= F.lag("at").over(w))
    tail = F.col("cells") - F.max("hi")
    found = good.groupBy(*keys, "cells").agg(
        F.count("*").alias("found"), (1 - (F.sum("gap") + tail) / F.col("cells")).alias("coverage"), (F.greatest(F.max("gap"), tail) / 10).alias("longest_gap"),
        F.coalesce(F.bool_or("back"), F.lit(False)).alias("disordered"),
    )
    tried = rows.groupBy(*keys).agg(F.count("*").alias("tried"))
    seconds = lambda c: F.coalesce(F.octet_length(c), F.lit(0)) / (_BYTES * RATE)
    base = pairs.select(*keys, seconds(samples).alias("s"), seconds(reference).alias("r"))
    out = base.join(tried, keys, "left").join(found, keys, "left").na.fill(0, ["found", "coverage"])
    fraction = F.coalesce(F.col("found") / F.col("tried"), F.lit(0.0))
    gap = F.coalesce("longest_gap", "s")
    same = (
        (fraction >= MATCH["fraction"]) & (F.col("coverage") >= MATCH["coverage"]) & ~F.coalesce("disordered", F.lit(True))
        & (gap <= F.greatest(F.lit(MATCH["gap_s"]), F.col("s") * MATCH["gap_share"]))
    )
    short = (F.col("s") < MATCH["least_s"]) | (F.col("r") < MATCH["least_s"])
    decision = F.when(short, "too_short").when(same, "same_recording_high_fit").when(fraction >= MATCH["review"], "needs_review").otherwise("not_established")
    return out.select(*keys, decision.alias("decision"), F.round(fraction, 4).alias("fraction"), F.round("coverage", 4).alias("coverage"), F.round(gap, 1).alias("longest_gap"))
