"""Telling the comments of a video's owner and staff by the hash of their poster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.media import poster_hash


def hash_number(shown: Column) -> Column:
    """A hash shown in hexadecimal digits as a number, whatever its case and leading zeros; NULL for anything else."""
    return F.when(shown.rlike("^[0-9a-fA-F]{1,15}$"), F.conv(shown, 16, 10).cast("bigint"))


def posters(people: DataFrame, *, video: str, member: str, role: str) -> DataFrame:
    """(video, poster, role) of a table of the members who made each video."""
    return people.filter(F.col(member).isNotNull()).select(F.col(video).alias("id"), poster_hash(F.col(member)).alias("poster"), F.col(role).alias("role"))


def classify_authors(comments: DataFrame, people: DataFrame, *, video: str, poster: str, into: str = "author") -> DataFrame:
    """``comments`` with the role of whoever may have posted each: ``owner`` before ``staff``, NULL for nobody known.

    ``people`` has (id, poster, role). It is reduced to a row per video and hash before the join, so no comment is
    doubled. Hashes that are empty or no hexadecimal number match nobody.
    """
    known = people.filter("poster is not null").groupBy(F.col("id").alias("_video"), F.col("poster").alias("_poster")).agg(F.min("role").alias(into))
    rows = comments.withColumn("_hash", hash_number(F.col(poster)))
    return rows.join(known, (F.col(video) == F.col("_video")) & (F.col("_hash") == F.col("_poster")), "left").drop("_video", "_poster", "_hash")
