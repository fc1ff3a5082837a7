"""Choosing a transcript: walking a video's tracks in order of preference, and what speaks against each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The order in which track keys are tried, people's before machines', Chinese before the others.
HUMAN_CHINESE = ["zh-Hans", "zh-CN", "zh"]
AUTO_CHINESE = ["ai-zh"]
OTHERS = ["ai-en", "en", "ai-ja", "ja", "ai-es", "es", "ai-ar", "ar", "ai-pt", "pt", "ai-ko", "ko", "ai-th", "th", "ai-id", "id", "ai-vi", "vi"]
# Fixed value: the marks that censorship leaves in Chinese tracks.
REDACTED = r"\*\*|XX|和[Xx]"
SANE = (0.70, 1.10)


def preference(key: Column, offered_by_people: Column) -> Column:
    """Place of a track in the order of preference; NULL for one that is never tried.

    A key counts as people's captions only among the Chinese ones; further down both kinds of offer are alike, and an
    offer by people goes first.
    """
    order = [*((k, True) for k in HUMAN_CHINESE), *((k, p) for k in AUTO_CHINESE for p in (True, False)), *((k, p) for k in OTHERS for p in (True, False))]
    out = F.lit(None).cast("int")
    for i, (k, people) in reversed(list(enumerate(order))):
        out = F.when((key == k) & (offered_by_people == people), i).otherwise(out)
    return out


def provenance(key: Column) -> Column:
    return F.when(key.isin(HUMAN_CHINESE), "human-sub").otherwise("auto-sub")


def marker(key: Column, body: Column) -> Column:
    """The mark of censorship in a Chinese track's whole text; NULL for other tracks and clean ones."""
    return F.when(key.isin(HUMAN_CHINESE + AUTO_CHINESE), F.nullif(F.regexp_extract(body, REDACTED, 0), F.lit("")))


def walk(tracks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, key, source, rejected, proxy) of the first track that isn't rejected, with the trail of those before it.

    ``tracks`` has keys, key, rank and marker. ``proxy`` tells whether a track in another language stands in for a
    rejected Chinese one. Of a key offered twice below the Chinese ones the first offer alone is tried. Entities all of
    whose tracks are rejected come with NULL as key; those without any track don't come.
    """
    once = Window.partitionBy(*keys, "key").orderBy("rank")
    rows = tracks.filter("rank is not null").withColumn("_n", F.row_number().over(once)).filter((F.col("_n") == 1) | F.col("key").isin(AUTO_CHINESE))
    taken = F.min(F.when(F.col("marker").isNull(), F.struct("rank", "key")))
    tried = F.sort_array(F.collect_list(F.when(F.col("marker").isNotNull(), F.struct("rank", F.concat("key", F.lit(" ("), "marker", F.lit(")")).alias("why")))))
    out = rows.groupBy(*keys).agg(taken.alias("_t"), tried.alias("_r"))
    before = F.filter("_r", lambda r: F.col("_t").isNull() | (r["rank"] < F.col("_t.rank")))
    key = F.col("_t.key")
    return out.select(
        *keys, key.alias("key"), F.when(key.isNotNull(), provenance(key)).alias("source"), F.array_join(before["why"], ", ").alias("rejected"),
        ((F.size(before) > 0) & key.isNotNull() & (F.regexp_replace(key, "^ai-", "") != "zh")).alias("proxy"),
    )


def sane(last_end: Column, duration: Column) -> Column:
    """Whether a track ends about where its video does; NULL where the duration is unknown or 0."""
    return F.when(duration > 0, (last_end / duration).between(*SANE))
