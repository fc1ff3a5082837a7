"""Joins of intervals that overlap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlap_join(left: DataFrame, right: DataFrame, *, keys: Sequence[str], bucket: float = 8.0, how: str = "inner") -> DataFrame:
    """Pairs of rows of equal keys whose half-open intervals (start, end) overlap.

    Columns of ``right`` but the keys are prefixed with ``r_``. Both sides are cut into time buckets and joined by hash;
    a pair that meets in several buckets is kept in the one where the later of the two starts lies, so nothing has to be
    deduplicated. Rows with a NULL bound or end <= start pair with nothing.
    """
    cut = lambda s, e: F.sequence(F.floor(s / bucket), F.greatest(F.floor(s / bucket), F.ceil(e / bucket) - 1))
    valid = F.col("end") > F.col("start")
    a = left.filter(valid).withColumn("_b", F.explode(cut(F.col("start"), F.col("end"))))
    b = right.filter(valid).select(*keys, *(F.col(c).alias(f"r_{c}") for c in right.columns if c not in keys))
    b = b.withColumn("_b", F.explode(cut(F.col("r_start"), F.col("r_end"))))
    hit = a.join(b, [*keys, "_b"])
    hit = hit.filter((F.col("r_end") > F.col("start")) & (F.col("r_start") < F.col("end")))
    return hit.filter(F.floor(F.greatest("start", "r_start") / bucket) == F.col("_b")).drop("_b")


def similarity(a, b):
    """Similarity of two keys by edit distance: 0 if either is empty, 1 if they are equal."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(1 - F.levenshtein(a, b) / longest)
