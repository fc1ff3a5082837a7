"""Problem 2: collapsing runs of identical or near-identical consecutive events into one event."""

from __future__ import annotations

import os
import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.blocks import BLOCK, block_of, carried, in_block, once, stitch, with_carried
from tidewater.llm.text import canonical_many, many_distinct, osa, says_nothing
from tidewater.tables import load

SLIPS = 2
_TOKENS = re.compile(r"\d+|[^\W\d_]+")
_DRAWN = re.compile(r"([^\W\d_])\1{2,}")
_IDEOGRAPH = re.compile("[぀-ヿ㐀-鿿가-힯]")


def event_forms(texts: list[str]) -> list[str | None]:
    """Words and numbers of each text in one form, drawn-out letters shortened; None for a text that says nothing."""
    out: list[str | None] = []
    for said in canonical_many(texts):
        form = None if says_nothing(said) else " ".join(_TOKENS.findall(said))
        out.append((_DRAWN.sub(r"\1", form) if _DRAWN.search(form) else form) or None if form else None)
    return out


def event_form(text: str) -> str | None:
    return event_forms([text])[0]


def says_the_same(a: str, b: str, slips: int = SLIPS) -> bool:
    """Whether two event forms differ at most in spacing and in up to ``slips`` slipped letters.

    A slip is a letter lost, added or swapped with its neighbour, or, inside a longer alphabetic word, one replaced.
    Numbers must be equal, and an exchanged ideograph or short word is another word.
    """
    if a == b:
        return True
    x, y = a.replace(" ", ""), b.replace(" ", "")
    if x == y:
        return True
    if abs(len(x) - len(y)) > slips or re.findall(r"\d+", a) != re.findall(r"\d+", b):
        return False
    # A short line has little to tell a slip from another word by.
    most = slips if len(x) >= 8 else 1
    if min(len(x), len(y)) < 3:
        return False
    # One ideograph in another's place is another word, not a letter lost and one added.
    lo = len(os.path.commonprefix([x, y]))
    hi = len(os.path.commonprefix([x[lo:][::-1], y[lo:][::-1]]))
    if len(x) - lo - hi == len(y) - lo - hi == 1 and _IDEOGRAPH.match(x[lo]):
        return False
    swap = lambda p, q: slips + 1 if _IDEOGRAPH.match(p) or _IDEOGRAPH.match(q) else 1
    if osa(x, y, most, swap) > most:
        return False
    v, w = a.split(), b.split()
    if len(v) != len(w) or _IDEOGRAPH.search(x):
        return True
    for p, q in zip(v, w):
        if p != q:
            if min(len(p), len(q)) <= 3 and len(p) == len(q) and sorted(p) != sorted(q):
                return False
            if osa(p, q, slips) > (1 if max(len(p), len(q)) < 4 else slips):
                return False
    return True


@F.arrow_udf(T.StringType())
def _event_form(texts: pa.Array) -> pa.Array:
    return many_distinct(texts, event_forms)


@F.arrow_udf(T.BooleanType())
def _same(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([p is not None and q is not None and says_the_same(p, q) for p, q in zip(a.to_pylist(), b.to_pylist())], pa.bool_())


def collapse_runs(
    df: DataFrame, *, keys: Sequence[str], order: str, record: str, text: str, start: str, end: str, block: int = BLOCK
) -> DataFrame:
    """(keys, first record, last record, n, start, end, duration, text) of each maximal run of events that say the same.

    Texts are canonicalised, and an event that says nearly the same as the one before it takes over that event's
    canonical value. Row number in the sequence minus row number within the value is constant exactly along a run: a value
    that comes back later has another difference. Counts and times are aggregated by value and difference. Sequences are worked on in blocks of ``block`` positions and the runs that reach a
    block's end are stitched, so no task holds a whole long sequence.

    Defined results: runs of one event are given as well (n = 1); events with NULL or blank text or sound marks alone
    are in no run and end one; rows repeated alike count once; NULL keys form their own sequence; events at one
    position are ordered by ``record``; an empty table gives no rows; other columns, whatever their names, are not read.
    """
    ks = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(
        *(F.col(k).alias(a) for k, a in zip(keys, ks)), F.col(order).alias("_o"), F.col(record).alias("_r"),
        F.col(start).alias("_s"), F.col(end).alias("_e"), _event_form(F.col(text)).alias("_v"), block_of(order, block).alias("_block"),
    )
    rows = once(rows, ks, "_o", "_r")
    w = in_block(ks, "_o", "_r")
    ends = carried(rows, ks, "_o", "_r", F.struct("_v"))
    rows = rows.withColumn("_n", F.row_number().over(w)).withColumn("_p", F.lag("_v").over(w))
    rows = with_carried(rows, ks, ends)
    rows = rows.withColumn("_p", F.when(F.col("_n") == 1, F.col("_in._v")).otherwise(F.col("_p")))
    # Equal forms need no comparison of letters; only unequal neighbours go to Python.
    near = F.col("_p").isNotNull() & F.col("_v").isNotNull() & (F.col("_p") != F.col("_v"))
    rows = rows.withColumn("_near", _same(F.when(near, F.col("_p")), F.when(near, F.col("_v"))))
    rows = rows.withColumn("_same", F.coalesce((F.col("_p") == F.col("_v")) | F.col("_near"), F.lit(False)))
    # Values are told apart by their hash from here on, so that texts move on only where they are asked for.
    rows = rows.withColumn("_said", F.col("_v").isNotNull()).withColumn("_h", F.xxhash64("_v"))
    rows = rows.withColumn("_canon", F.last(F.when(~F.col("_same"), F.col("_h")), True).over(w))
    # A slip of a slip may lead back to a value just left: such a return is another value.
    back = ~F.col("_same") & F.coalesce(F.lag("_canon").over(w) == F.col("_canon"), F.lit(False))
    rows = rows.withColumn("_value", F.struct("_canon", F.sum(F.when(back, 1).otherwise(0)).over(w).alias("_back")))
    within = Window.partitionBy(*ks, "_block", "_value").orderBy("_o", "_r")
    rows = rows.withColumn("_run", F.col("_n") - F.row_number().over(within)).filter("_said")
    place = F.struct("_o", "_r")
    runs = rows.groupBy(*ks, "_block", "_value", "_run").agg(
        F.min(place).alias("_first"), F.max(place).alias("_last"), F.count("*").alias("n"), F.min("_s").alias("_s"),
        F.max("_e").alias("_e"), F.min_by("_v", place).alias("_v"), F.min("_n").alias("_n"),
        F.bool_or((F.col("_n") == 1) & F.col("_same")).alias("_on"), F.bool_or(F.coalesce("_more", F.lit(False))).alias("_more"),
    )
    # The run at a block's end is its last one; it may go on in the next block.
    runs = runs.withColumn("_tail", F.col("_more") & (F.lead("_n").over(Window.partitionBy(*ks, "_block").orderBy("_n")).isNull()))
    done = stitch(runs, ks, [
        F.max("_last").alias("_last"), F.sum("n").alias("n"), F.min("_s").alias("_s"),
        F.max("_e").alias("_e"), F.min_by("_v", "_first").alias("_v"), F.min("_first").alias("_first"),
    ], [*ks, "_first", "_last", "n", "_s", "_e", "_v"])
    return done.select(
        *(F.col(a).alias(k) for k, a in zip(keys, ks)), F.col("_first._r").alias(f"first_{record}"),
        F.col("_last._r").alias(f"last_{record}"), "n", F.col("_s").alias(start), F.col("_e").alias(end),
        F.round(F.col("_e") - F.col("_s"), 3).alias("duration"), F.col("_v").alias("event"),
    )


def p2_runs(spark, sf_dir: str) -> DataFrame:
    """Every event of every track, runs collapsed."""
    cues = load(spark, sf_dir, "cues", "id", "part", "track", "pos", "cue_id", "start", "end", "text")
    return collapse_runs(cues, keys=["id", "part", "track"], order="pos", record="cue_id", text="text", start="start", end="end")


def p2_found(spark, sf_dir: str) -> DataFrame:
    """Runs of two or more cues."""
    return p2_runs(spark, sf_dir).filter("n > 1").select("first_cue_id", "last_cue_id")
