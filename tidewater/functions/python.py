"""Functions Spark has no expression for, in Arrow batches and once per distinct value or pair."""

from __future__ import annotations

import difflib
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T


def folded(text: str) -> str:
    """Letters and digits alone, in compatibility form and folded."""
    return re.sub(r"\W", "", unicodedata.normalize("NFKC", text)).casefold()


@F.arrow_udf(T.StringType())
def compatibility_fold(texts: pa.Array) -> pa.Array:
    coded = texts.dictionary_encode()
    return pa.array([folded(x) for x in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)


@F.arrow_udf(T.StringType())
def word_fold(texts: pa.Array) -> pa.Array:
    """Word characters of any script alone, folded."""
    coded = texts.dictionary_encode()
    return pa.array([re.sub(r"\W", "", x).casefold() for x in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)


def romanised(text: str) -> str:
    """Kana as Latin letters by the names of their characters; other letters and digits as they are, the rest left out."""
    out: list[str] = []
    double = False
    for c in unicodedata.normalize("NFKC", text).casefold():
        name = unicodedata.name(c, "").split()
        if name[:2] not in (["HIRAGANA", "LETTER"], ["KATAKANA", "LETTER"]):
            out += c if c.isalnum() and "PROLONGED" not in " ".join(name) else ""
            continue
        sound = name[-1].lower()
        if name[2] == "SMALL" and sound == "tu":
            double = True
        elif name[2] == "SMALL" and sound[0] == "y" and out and out[-1].endswith("i"):
            out[-1] = out[-1][:-1] + sound
        else:
            out.append((sound[0] if double else "") + sound)
            double = False
    return "".join(out)


#: How a text in a language is read aloud, in Latin letters; readers for other languages can be added.
READERS = {"ja": romanised}


@F.arrow_udf(T.StringType())
def phonetic_key(texts: pa.Array, languages: pa.Array) -> pa.Array:
    """By the reader of each text's language, else the folded text."""
    said = zip(texts.to_pylist(), languages.to_pylist())
    return pa.array([None if t is None else READERS.get(k, folded)(t) for t, k in said], pa.string())


def ratio(a: str, b: str) -> float:
    """Share of matching characters of two keys: 0 if either is empty, 1 if they are equal."""
    if not a or not b:
        return 0.0
    return 1.0 if a == b else difflib.SequenceMatcher(None, a, b).ratio()


@F.arrow_udf(T.DoubleType())
def sequence_ratio(a: pa.Array, b: pa.Array) -> pa.Array:
    seen: dict[tuple, float] = {}
    out = []
    for pair in zip(a.to_pylist(), b.to_pylist()):
        if pair not in seen:
            seen[pair] = ratio(pair[0] or "", pair[1] or "")
        out.append(seen[pair])
    return pa.array(out, pa.float64())


def near(a: str, b: str, least: float) -> bool:
    """Whether two texts are equal or their ratio is ``least`` or more; its upper bounds are tried first."""
    if not a or not b:
        return False
    m = difflib.SequenceMatcher(None, a, b)
    return a == b or m.real_quick_ratio() >= least and m.quick_ratio() >= least and m.ratio() >= least


@F.arrow_udf(T.BooleanType())
def near_copy(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([near(x or "", y or "", 0.90) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.bool_())


def support(line: str, heard: str) -> float:
    """Best ratio of a line with a stretch of the heard text as long as itself."""
    if not line or not heard:
        return 0.0
    if line in heard:
        return 1.0
    blocks = difflib.SequenceMatcher(None, line, heard, autojunk=False).get_matching_blocks()
    return max((ratio(line, heard[max(0, m.b - m.a) : max(0, m.b - m.a) + len(line)]) for m in blocks if m.size), default=0.0)


@F.arrow_udf(T.DoubleType())
def line_support(lines: pa.Array, heard: pa.Array) -> pa.Array:
    return pa.array([support(a or "", b or "") for a, b in zip(lines.to_pylist(), heard.to_pylist())], pa.float64())
