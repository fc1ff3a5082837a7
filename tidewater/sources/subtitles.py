"""Readers of subtitle texts, one row per file in, one row per cue out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.text import stripped

_LINE = r"(\d+:\d{1,2}:\d{1,2}[.,]\d{1,3})\s*-->\s*(\d+:\d{1,2}:\d{1,2}[.,]\d{1,3})"


def stamp_seconds(stamp: Column) -> Column:
    """Seconds of ``h:mm:ss,mmm``."""
    part = lambda i: F.regexp_extract(stamp, r"(\d+):(\d{1,2}):(\d{1,2})[.,](\d{1,3})", i)
    millis = F.rpad(part(4), 3, "0").cast("bigint")
    return (part(1).cast("bigint") * 3600000 + part(2).cast("bigint") * 60000 + part(3).cast("bigint") * 1000 + millis) / 1000


def parse_timed_blocks(files: DataFrame, body: str, *keys: str) -> DataFrame:
    """(keys, pos, start, end, text) of the cues of SRT or VTT texts.

    Blocks are separated by blank lines; a block without a timing line, like a header or a note, is dropped, and so is
    one whose times lack hours. The non-empty lines behind the timing line are joined with a space. NULL and empty
    bodies have no cues.
    """
    blocks = F.split(F.regexp_replace(F.col(body), r"\r\n?", "\n"), r"\n[ \t]*\n")
    rows = files.select(*keys, F.posexplode(blocks).alias("_b", "block")).filter(F.col("block").rlike(_LINE))
    after = F.regexp_extract("block", r"(?s)-->[^\n]*\n(.*)$", 1)
    lines = F.filter(F.transform(F.split(after, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = rows.select(
        *keys, "_b", stamp_seconds(F.regexp_extract("block", _LINE, 1)).alias("start"), stamp_seconds(F.regexp_extract("block", _LINE, 2)).alias("end"), F.array_join(lines, " ").alias("text")
    ).filter("text <> ''")
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy("_b")) - 1).select(*keys, "pos", "start", "end", "text")


def parse_json_cues(files: DataFrame, body: str, *keys: str) -> DataFrame:
    """(keys, pos, start, end, text) of JSON bodies ``{"body": [{"from", "to", "content"}]}`` or of the bare list."""
    cue = "array<struct<`from`:double,`to`:double,content:string>>"
    text = F.trim(F.col(body))
    found = F.when(text.startswith("["), F.from_json(text, cue)).otherwise(F.from_json(text, f"struct<body:{cue}>")["body"])
    rows = files.select(*keys, F.posexplode(found).alias("pos", "x"))
    return rows.select(*keys, "pos", F.col("x.from").alias("start"), F.col("x.to").alias("end"), F.trim("x.content").alias("text"))


def without_turn_marks(text: Column) -> Column:
    """A cue of an unrolled caption without its leading ``>>``; NULL if nothing is left."""
    return F.nullif(stripped(F.regexp_replace(text, r"^>>\s*", "")), F.lit(""))


def parse_speech_words(files: DataFrame, body: str, offset: str, duration: str, *keys: str) -> DataFrame:
    """(keys, start, end, text) of the valid words of a recogniser's JSON: milliseconds, punctuation appended, inside
    the clip, shifted by its offset."""
    word = "struct<begin_time:bigint,end_time:bigint,text:string,punctuation:string>"
    shape = f"struct<transcripts:array<struct<sentences:array<struct<words:array<{word}>>>>>>"
    rows = files.withColumn("_j", F.from_json(body, shape)).select(*keys, offset, duration, F.explode("_j.transcripts").alias("t"))
    rows = rows.select(*keys, offset, duration, F.explode("t.sentences").alias("s")).select(*keys, offset, duration, F.explode("s.words").alias("w"))
    s, e = F.col("w.begin_time") / 1000, F.col("w.end_time") / 1000
    ok = (s >= 0) & (e >= s) & (e <= F.col(duration) + 0.25)
    text = F.concat(F.coalesce("w.text", F.lit("")), F.coalesce("w.punctuation", F.lit("")))
    return rows.filter(ok).select(*keys, (s + F.col(offset)).alias("start"), (F.least(e, F.col(duration)) + F.col(offset)).alias("end"), text.alias("text"))
