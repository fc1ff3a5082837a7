"""Quality of subtitle tracks: metrics, gates with their reasons, repetition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.text import DIGITS, PUNCTUATION_CLASS, SPACES, cjk_count, comparison_key, count_class

# Thresholds of the gates, and words by which a request to act is recognised.
GATE = {"punct_min": 0.04, "dup_max": 0.30, "nonzh_max": 0.20, "cps_min": 1.0, "cps_max": 8.0, "foreign_cps_max": 40.0}
NET = {"min_cues": 5, "coverage_min": 0.70, "coverage_max": 1.10, "cps_min": 0.5}
REPEAT, RUN = 0.40, 5
DISTRUST = "(?i)send|post|like|click|publish|modify|delete|bag_send|comment|share"


def track_metrics(cues: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per track the counts all gates work from, in a single aggregation."""
    t = F.coalesce(F.col("text"), F.lit(""))
    punct, digits, cjk, spaces = count_class(t, PUNCTUATION_CLASS), count_class(t, DIGITS), cjk_count(t), count_class(t, SPACES)
    return cues.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_distinct(t).alias("distinct_texts"), F.sum(F.length(t)).alias("chars"), F.sum(punct).alias("punct"),
        F.sum(digits).alias("digits"), F.sum(cjk).alias("cjk"), F.sum(spaces).alias("spaces"), F.max("end").alias("last_end"),
    )


def gate(metrics: DataFrame, *, source: Column, language: Column, duration: Column, t: dict = GATE) -> DataFrame:
    """The verdict of the quality gate and the metrics rounded for show: any one metric that trips rejects the track.

    Punctuation counts for human tracks only. A track whose language is named without ``zh`` is foreign: its share of
    other characters is 0 and only a very high reading speed trips. The verdict uses the metrics before rounding.
    """
    per = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    c = F.col
    foreign = F.coalesce((language != "") & ~language.contains("zh"), F.lit(False))
    m = metrics.withColumns({
        "punct_density": per(c("punct"), c("chars")), "dup_ratio": per(c("n") - c("distinct_texts"), c("n")),
        "nonzh_ratio": F.when(foreign, 0.0).otherwise(per(c("chars") - c("spaces") - c("cjk") - c("punct") - c("digits"), c("chars") - c("spaces"))),
        "cps": F.when(duration > 0, c("chars") / duration),
    })
    slow = F.when(foreign, c("cps") > t["foreign_cps_max"]).otherwise(~c("cps").between(t["cps_min"], t["cps_max"]))
    trips = ((source != "auto-sub") & (c("punct_density") < t["punct_min"])) | (c("dup_ratio") > t["dup_max"]) | (c("nonzh_ratio") > t["nonzh_max"]) | F.coalesce(slow, F.lit(False))
    shown = {x: F.round(x, 4) for x in ("punct_density", "dup_ratio", "nonzh_ratio", "cps")}
    return m.withColumn("passed", ~trips).withColumns(shown)


def failures(source: Column, t: dict = GATE) -> Column:
    """Names of the metrics that trip by their rounded values, whatever the language; ``passed`` if none does."""
    c = F.col
    names = F.array_compact(F.array(
        F.when((source != "auto-sub") & (c("punct_density") < t["punct_min"]), "punct_density"), F.when(c("dup_ratio") > t["dup_max"], "dup_ratio"),
        F.when(c("nonzh_ratio") > t["nonzh_max"], "nonzh_ratio"), F.when((c("cps") < t["cps_min"]) | (c("cps") > t["cps_max"]), "cps")))
    return F.when(F.size(names) > 0, F.array_join(names, ", ")).otherwise("passed")


def net_reason(duration: Column, t: dict = NET) -> Column:
    """First reason for which the structural net rejects a track, or ``passed``."""
    c = F.col
    ratio, cps = c("last_end") / duration, c("chars") / duration
    return (
        F.when(c("n") < t["min_cues"], "cues").when(~(duration > 0) | duration.isNull(), "passed")
        .when(~ratio.between(t["coverage_min"], t["coverage_max"]), "coverage").when(cps < t["cps_min"], "speed").otherwise("passed")
    )


def repetition(cues: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n, repeat_ratio, longest_run, top_text, looping) of each track.

    The most frequent key, the first seen among equals, and the longest stretch of equal non-empty keys. Tracks of fewer
    than three cues and tracks whose most frequent key is empty never loop.
    """
    rows = cues.withColumn("_k", comparison_key(F.coalesce("text", F.lit(""))))
    counts = rows.groupBy(*keys, "_k").agg(F.count("*").alias("c"), F.min(F.struct("pos")).alias("_at"))
    top = counts.groupBy(*keys).agg(F.sum("c").alias("n"), F.max("c").alias("most"), F.max_by("_k", F.struct("c", (-F.col("_at.pos")).alias("p"))).alias("top"))
    w = Window.partitionBy(*keys).orderBy("pos")
    islands = rows.withColumn("_g", F.row_number().over(w) - F.row_number().over(Window.partitionBy(*keys, "_k").orderBy("pos")))
    runs = islands.filter("_k <> ''").groupBy(*keys, "_k", "_g").agg(F.count("*").alias("r")).groupBy(*keys).agg(F.max("r").alias("run"))
    ratio = F.col("most") / F.col("n")
    judged = (F.col("n") >= 3) & (F.col("top") != "")
    return top.join(runs, [*keys], "left").select(
        *keys, "n", F.when(judged, F.round(ratio, 3)).otherwise(0.0).alias("repeat_ratio"), F.coalesce("run", F.lit(0)).alias("longest_run"),
        F.when(judged, F.col("top")).alias("top_text"), (judged & ((ratio >= REPEAT) | (F.coalesce("run", F.lit(0)) >= RUN))).alias("looping"),
    )
