"""Flattening the nested records that describe a video and what is offered with it, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VIEW = "struct<cid:bigint,title:string,duration:int,owner:struct<mid:bigint,name:string>,pages:array<struct<page:int,cid:bigint,part:string,duration:int>>>"
INFO = "struct<id:string,duration:double,timestamp:double,upload_date:string,subtitles:map<string,string>,automatic_captions:map<string,string>>"
OFFER = "array<struct<ext:string,data:string,url:string>>"


def view_pages(df: DataFrame, key: str, body: str) -> DataFrame:
    """(key, part, cid, title, duration) of every page of a view record in JSON.

    A record without pages stands for its only page. One that is no JSON, or whose answer is no success, gives no rows.
    """
    view = F.from_json(F.get_json_object(body, "$.data"), VIEW)
    rows = df.filter(F.get_json_object(body, "$.code") == "0").select(F.col(key), view.alias("v")).filter("v is not null")
    page = lambda part, cid, title, duration: F.struct(part.alias("part"), cid.alias("cid"), title.alias("title"), duration.alias("duration"))
    own = F.array(page(F.lit(1), F.col("v.cid"), F.lit(None).cast("string"), F.col("v.duration")))
    pages = F.transform("v.pages", lambda p: page(p["page"], p["cid"], p["part"], p["duration"]))
    return rows.select(key, F.explode(F.when(F.size("v.pages") > 0, pages).otherwise(own)).alias("p")).select(key, "p.*")


def offered_tracks(df: DataFrame, key: str, body: str) -> DataFrame:
    """(key, code, source) of every track an info record in JSON offers: its subtitles, then its automatic captions."""
    info = F.from_json(F.col(body), INFO)
    entries = lambda m, source: F.transform(F.coalesce(F.map_keys(m), F.array().cast("array<string>")), lambda k: F.struct(k.alias("code"), F.lit(source).alias("source")))
    rows = df.select(key, info.alias("i"))
    return rows.select(key, F.explode(F.concat(entries(F.col("i.subtitles"), "human-sub"), entries(F.col("i.automatic_captions"), "auto-sub"))).alias("t")).select(key, "t.*")


def published_at(timestamp: Column, upload_date: Column) -> Column:
    """ISO time in UTC of an epoch, or else of ``yyyymmdd``; NULL without either."""
    day = F.when(F.length(upload_date) == 8, F.concat_ws("-", F.substring(upload_date, 1, 4), F.substring(upload_date, 5, 2), F.substring(upload_date, 7, 2)))
    at = F.date_format(F.timestamp_seconds(F.floor(timestamp)), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.coalesce(F.when(timestamp != 0, at), F.concat(day, F.lit("T00:00:00Z")))


def delivery(formats: Column) -> Column:
    """What is taken of a track's formats {ext, data, url}: text formats first, else in their order; inline data before an
    address; formats with neither are passed over. A struct of ext and body, NULL if nothing can be fetched."""
    usable = F.filter(formats, lambda f: (f["data"] != "") | (f["url"] != ""))
    known = lambda f: F.coalesce(f["ext"].isin("json", "srt", "vtt"), F.lit(False))
    first = F.get(F.concat(F.filter(usable, known), F.filter(usable, lambda f: ~known(f))), F.lit(0))
    return F.when(first.isNotNull(), F.struct(first["ext"].alias("ext"), F.coalesce(F.nullif(first["data"], F.lit("")), first["url"]).alias("body")))


def model_object(response: Column) -> Column:
    """Verdict on a model's response in JSON: ``ok``, or why its content can't be used as an object."""
    reason = F.get_json_object(response, "$.choices[0].finish_reason")
    content = F.get_json_object(response, "$.choices[0].message.content")
    return (
        F.when(F.get_json_object(response, "$.choices[0]").isNull() | ~F.coalesce(reason.isin("stop"), F.lit(True)), "missing or truncated")
        .when(F.schema_of_variant(F.try_parse_json(content)).startswith("OBJECT"), "ok").when(F.try_parse_json(content).isNull(), "no JSON").otherwise("no object")
    )
