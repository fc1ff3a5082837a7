"""Scalar functions on text, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The punctuation that quality metrics count, the signs stripped from the edges of comparison keys, the
# white space and digits beyond ASCII, and the characters a file name must not hold.
PUNCTUATION = "。，、！？；：「」『』（）《》〈〉【】—…·.,!?;:\"'()[]{}<>-"
EDGE = "，。！？、!?.,:：…—-()（）\"'"
SPACES = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
DIGITS = r"[\p{Nd}\x{b2}\x{b3}\x{b9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}]"
#: The punctuation as a class of a regular expression.
PUNCTUATION_CLASS = "[" + "".join("\\" + c if c in "[]-" else c for c in PUNCTUATION) + "]"


def clock(seconds: Column) -> Column:
    """``MM:SS`` of seconds rounded half to even; minutes run beyond 59 and beyond two digits. NULL gives NULL."""
    whole = F.bround(seconds).cast("bigint")
    minutes = F.floor(whole / 60).cast("string")
    return F.concat(F.lpad(minutes, F.greatest(F.lit(2), F.length(minutes)), F.lit("0")), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0"))


def neutral_markdown(text: Column) -> Column:
    """Text whose lines can't be taken for headings, rules or fences: a backslash goes before a leading marker."""
    return F.regexp_replace(text, r"(?m)^([^\S\n]*)(#{1,6}|-{3,}|\*{3,}|_{3,}|`{3,}|~{3,})", r"$1\\$2")


def pills(high_like: Column, author: Column) -> Column:
    """Marks before a crowd line: a promoted one, and one that may be by the owner or the staff."""
    marks = F.concat_ws(" ", F.when(high_like, "👍"), F.when(author == "owner", "UP主?").when(author == "staff", "合作?"))
    return F.when(marks == "", marks).otherwise(F.concat(marks, F.lit(" ")))


def file_name(text: Column) -> Column:
    """A name usable on any file system: illegal characters become spaces, runs of spaces one, the edges are trimmed."""
    clean = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r'[\\/:*?"<>|\r\n\t]', " "), r"[\s　]+", " ")
    return F.trim(clean, F.lit(" ."))


def comparison_key(text: Column, fold: bool = True) -> Column:
    """Text without white space and without punctuation, ``;`` with it, at its edges; with ``fold`` in small letters and
    without ``*`` at its edges too."""
    bare = F.regexp_replace(text, r"[\s　]+", "")
    trimmed = F.trim(bare, F.lit(EDGE + (";*" if fold else ";")))
    return F.lower(trimmed) if fold else trimmed


def source_key(text: Column, fold: bool = True) -> Column:
    """The key by which sources are compared: without white space and edge punctuation, all scripts kept; with ``fold`` in
    small letters and without ``*`` at its edges."""
    trimmed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[\s\x1c-\x1f]+", ""), F.lit(EDGE + (";*" if fold else ";")))
    return F.lower(trimmed) if fold else trimmed


def bare(text: Column) -> Column:
    """Text without white space at its edges, of every kind that Python strips."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def stripped(text: Column) -> Column:
    """Text without white space of any kind at its edges."""
    return F.regexp_replace(text, r"^[\s　]+|[\s　]+$", "")


def count_class(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def cjk_count(text: Column) -> Column:
    return count_class(text, "[\\u4e00-\\u9fff]")


def phash_bits(phash: Column) -> Column:
    """A 64-bit perceptual hash in hexadecimal digits as BIGINT; NULL for anything else."""
    return F.when(phash.rlike("^[0-9a-fA-F]{1,16}$"), F.conv(phash, 16, -10).cast("bigint"))


def hamming(a: Column, b: Column) -> Column:
    """Number of bits in which two BIGINTs differ."""
    return F.bit_count(a.bitwiseXOR(b))


def join_words(words: Column) -> Column:
    """Words of an array joined; a space goes between two of which one ends and the next begins with an ASCII letter or digit."""
    step = lambda acc, w: F.when((acc != "") & acc.rlike("[A-Za-z0-9]$") & w.rlike("^[A-Za-z0-9]"), F.concat(acc, F.lit(" "), w)).otherwise(F.concat(acc, w))
    return F.regexp_replace(F.aggregate(F.filter(words, lambda w: w.isNotNull()), F.lit(""), step), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


# Fixed value: what a caption's track key looks like, behind the mark of machine-made tracks.
LANGUAGE_KEY = "^[a-z]{2,3}(-[A-Za-z]{2,8})*$"


def track_kind(key: Column) -> Column:
    """``auto-sub`` or ``human-sub`` by a track's key; NULL for a key that is no caption's."""
    made = key.startswith("ai-")
    return F.when(made, F.when(language_of_key(key).rlike(LANGUAGE_KEY), "auto-sub")).when(key.rlike(LANGUAGE_KEY), "human-sub")


def language_of_key(key: Column) -> Column:
    """The language of a track key: without the mark of machine-made tracks."""
    return F.regexp_replace(key, "^ai-", "")


def base_language(tag: Column) -> Column:
    return F.split_part(tag, F.lit("-"), F.lit(1))


def clean_tag(tag: Column) -> Column:
    """Whether a tag is a language followed by scripts and regions only."""
    return tag.rlike("^[A-Za-z]+(-([A-Za-z]{4}|[A-Za-z]{2}|[0-9]{3}))*$")


def masked(secret: Column) -> Column:
    """A credential that can be shown: its first and last four characters, nothing of a short one, ``<none>`` if there is none."""
    shown = F.concat(F.substring(secret, 1, 4), F.lit("..."), F.right(secret, F.lit(4)))
    return F.when(secret.isNull() | (secret == ""), "<none>").when(F.length(secret) <= 8, "***").otherwise(shown)


def redacted(text: Column) -> Column:
    """Text without addresses, bearer tokens and API keys."""
    out = F.regexp_replace(text, r"https?://[^\s\"']+", "[url]")
    out = F.regexp_replace(out, r"(?i)bearer\s+[A-Za-z0-9._-]+", "bearer [token]")
    return F.regexp_replace(out, r"sk-[A-Za-z0-9_-]{8,}", "[key]")


def json_array_in(text: Column) -> Column:
    """The lines {text, count} of the outermost JSON array in a model's answer, behind its first thought; a count that is
    missing is 1. An empty array if there is none or it is no JSON."""
    thought = F.regexp_extract(text, r"(?s)^(.*?)<think>.*?</think>", 0)
    kept = F.regexp_extract(text, r"(?s)^(.*?)<think>.*?</think>", 1)
    spoken = F.when(thought != "", F.concat(kept, F.substring(text, F.length(thought) + 1, F.length(text)))).otherwise(text)
    found = F.from_json(F.regexp_extract(spoken, r"(?s)\[.*\]", 0), "array<struct<text:string,count:int>>", {"mode": "PERMISSIVE"})
    lines = F.transform(found, lambda x: F.struct(x["text"].alias("text"), F.coalesce(x["count"], F.lit(1)).alias("count")))
    return F.coalesce(lines, F.array().cast("array<struct<text:string,count:int>>"))


def labelled_part(text: Column, label: str, stop: str | None) -> Column:
    """What follows ``LABEL:`` up to the next label; NULL if it is missing, empty or NONE."""
    body = stripped(F.regexp_extract(text, rf"(?s){label}:(.*?)" + (rf"(?:{stop}:|$)" if stop else "$"), 1))
    return F.when((body != "") & (F.upper(body) != "NONE"), body)
