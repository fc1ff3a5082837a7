"""Problem 3: bringing texts that look the same to one consistent form."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.text import canonical_many, many_distinct, read_many
from tidewater.tables import load


@F.arrow_udf(T.StringType())
def _folded(texts: pa.Array) -> pa.Array:
    return many_distinct(texts, canonical_many)


@F.arrow_udf(T.StringType())
def _read(texts: pa.Array) -> pa.Array:
    return many_distinct(texts, read_many)


def unified(text: str | Column, fold: bool = True) -> Column:
    """The consistent form of a text column: compatibility composition, full case folding unless ``fold`` is off, mapped
    white space, no default-ignorable characters, one letter of each group of equal shape.

    Worked out once per distinct value of an Arrow batch. NULL gives NULL, empty text gives empty text; a text of
    invisible characters alone gives empty text; texts of any length are read whole.
    """
    col = F.col(text) if isinstance(text, str) else text
    return (_folded if fold else _read)(col)


def reads_as(texts: DataFrame, phrases: DataFrame, *, text: str, phrase: str, phrase_id: str) -> DataFrame:
    """The rows of ``texts`` whose whole text reads as a phrase without being the same string, with the phrase's id.

    Both sides are joined on the unified form. Case changes what is read, so the matches are then held against the
    unified form with case kept. Defined results: NULL on either side never matches; phrases that read alike each give
    a row; repeated rows stay repeated; either table may be empty; of ``phrases`` only the two columns are read.
    """
    right = phrases.select(F.col(phrase_id).alias("_pid"), F.col(phrase).alias("_p"), unified(phrase).alias("_key"), unified(phrase, False).alias("_shape"))
    hits = texts.withColumn("_key", unified(text)).join(right, "_key").filter(F.col(text) != F.col("_p"))
    hits = hits.withColumn("_read", unified(text, False)).filter(F.col("_read") == F.col("_shape"))
    return hits.drop("_key", "_p", "_shape", "_read").withColumnRenamed("_pid", phrase_id)


def _lines(spark, sf_dir: str) -> DataFrame:
    cues = load(spark, sf_dir, "cues", "cue_id", "text").select(F.lit("cues").alias("tab"), F.col("cue_id").alias("row_id"), "text")
    crowd = load(spark, sf_dir, "danmaku_raw", "seq", "text").select(F.lit("danmaku_raw").alias("tab"), F.col("seq").alias("row_id"), "text")
    live = load(spark, sf_dir, "live_events", "event_type", "seq", "msg").filter("event_type = 'danmaku'")
    return cues.unionByName(crowd).unionByName(live.select(F.lit("live_events").alias("tab"), F.col("seq").alias("row_id"), F.col("msg").alias("text")))


def p3_unified(spark, sf_dir: str) -> DataFrame:
    """The unified form of every distinct line and the number of rows that read as it."""
    lines = _lines(spark, sf_dir).filter("text is not null")
    return lines.groupBy("tab", "text").agg(F.count_distinct("row_id").alias("n")).select("tab", unified("text").alias("form"), "n").groupBy("tab", "form").agg(F.sum("n").alias("n"))


def p3_found(spark, sf_dir: str) -> DataFrame:
    """Lines that read as a catchphrase but are not the same string."""
    phrases = load(spark, sf_dir, "catchphrases", "phrase_id", "text")
    hits = reads_as(_lines(spark, sf_dir), phrases, text="text", phrase="text", phrase_id="phrase_id")
    return hits.select("tab", "row_id", "phrase_id").distinct()
