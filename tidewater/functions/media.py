"""Scalar functions on addresses, times and amounts of media records, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^(?:[a-z]+:)?//([^/?#:]+)", 1))


def on_host(url: Column, domain: str) -> Column:
    """Whether an address is on a domain or one under it."""
    host = url_host(url)
    return (host == domain) | host.endswith("." + domain)


def url_in(text: Column) -> Column:
    """The first address in a text, with a scheme; a text without one as it is, trimmed."""
    found = F.regexp_extract(text, r"((?:https?:)?//[^\s\"'<>]+)", 1)
    url = F.when(found != "", found).otherwise(F.trim(text))
    return F.when(url.startswith("//"), F.concat(F.lit("https:"), url)).otherwise(url)


def query_value(url: Column, name: str) -> Column:
    """Value of a query parameter; NULL if it isn't there."""
    return F.nullif(F.regexp_extract(url, rf"[?&]{name}=([^&#]*)", 1), F.lit(""))


def video_identity(url: Column) -> Column:
    """(id, part) of a video page's address: the path segment after ``video``, and parameter ``p`` or 1."""
    vid = F.nullif(F.regexp_extract(url, r"/video/([A-Za-z0-9_]+)", 1), F.lit(""))
    return F.struct(vid.alias("id"), F.coalesce(query_value(url, "p").try_cast("int"), F.lit(1)).alias("part"))


def watch_identity(url: Column) -> Column:
    """The eleven-character id of a watch address in any of its forms; NULL if there is none."""
    forms = [r"youtu\.be/([A-Za-z0-9_-]{11})", r"[?&]v=([A-Za-z0-9_-]{11})", r"/(?:shorts|embed|v)/([A-Za-z0-9_-]{11})"]
    return F.coalesce(*(F.nullif(F.regexp_extract(url, f, 1), F.lit("")) for f in forms))


def part_address(url: Column, part: Column) -> Column:
    """The address of another part: parameter ``p`` set, every other parameter kept in its place."""
    base = F.regexp_extract(url, r"^([^?#]*)", 1)
    params = F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda x: (x != "") & ~x.rlike("^p(=|$)"))
    return F.concat(base, F.lit("?"), F.array_join(F.concat(params, F.array(F.concat(F.lit("p="), part.cast("string")))), "&"))


def iso_time(epoch: Column, offset: str = "+08:00") -> Column:
    """ISO time of epoch seconds at an offset; NULL for NULL and 0."""
    local = F.from_utc_timestamp(F.timestamp_seconds(F.floor(epoch)), offset)
    return F.when(epoch != 0, F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(offset)))


def iso_date(compact: Column) -> Column:
    """``yyyy-mm-dd`` of ``yyyymmdd``; NULL for anything else."""
    return F.when(compact.rlike("^[0-9]{8}$"), F.concat_ws("-", compact.substr(1, 4), compact.substr(5, 2), compact.substr(7, 2)))


def epoch_seconds(stamp: Column) -> Column:
    """Epoch seconds of a stamp in seconds or, beyond 1e11, milliseconds; NULL unless positive."""
    return F.when(stamp > 1e11, stamp / 1000).when(stamp > 0, stamp)


def gift_value(coin_type: Column, coins: Column) -> Column:
    """Worth of a gift: a thousandth of its coins if they are gold, else nothing."""
    return F.when(coin_type == "gold", F.round(coins / 1000, 2)).otherwise(0.0)


def guard_level(level: Column) -> Column:
    """Level of a guard, 3 for anything but 1 to 3."""
    return F.when(level.between(1, 3), level).otherwise(3)


def lrc_text(text: Column) -> Column:
    """Text on one line, with full-width brackets, so that none is taken for a stamp."""
    return F.translate(F.regexp_replace(text, "[\r\n]+", " "), "[]", "［］")


def poster_hash(member: Column) -> Column:
    """The hash a comment shows of its poster: CRC-32 of the member number's digits."""
    return F.crc32(member.cast("string"))


def failure_code(message: Column) -> Column:
    """Class of a failed request by its message."""
    code = F.regexp_extract(message, r"HTTP Error ([45]\d{2})", 1)
    return F.when(code == "412", "precondition").when(code == "404", "missing").when(code.isin("401", "403"), "refused").when(
        code == "429", "throttled").when(code != "", "http").when(message.rlike("(?i)timed? ?out"), "timeout").otherwise("unknown")


def stage_key(platform: Column, video: Column, part: Column, params: Column) -> Column:
    """Key of a cached stage: identity and the first ten digits of the parameters' SHA-1."""
    return F.concat(platform, F.lit(":"), video, F.lit(":"), part.cast("string"), F.lit("#"), F.substring(F.sha1(params), 1, 10))


def contained_path(path: Column) -> Column:
    """A relative path that stays inside its folder; NULL for any other."""
    return F.when(~path.rlike(r"^/|^[A-Za-z]:|(^|[/\\])\.\.([/\\]|$)"), path)


def lrc_stamp(seconds: Column) -> Column:
    """``[mm:ss.cc]`` in whole centiseconds."""
    ticks = F.bround(seconds * 100).cast("bigint")
    two = lambda x: F.lpad(F.floor(x).cast("string"), F.greatest(F.lit(2), F.length(F.floor(x).cast("string"))), F.lit("0"))
    return F.concat(F.lit("["), two(ticks / 6000), F.lit(":"), two((ticks % 6000) / 100), F.lit("."), two(ticks % 100), F.lit("]"))
