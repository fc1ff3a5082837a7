"""Ordered passes over sequences too long for one task: a sequence is cut into blocks, block ends are carried on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096


def block_of(order: str, size: int = BLOCK) -> Column:
    """Number of the block that holds a position; NULL positions come first, in a block of their own."""
    return F.coalesce(F.floor(F.col(order) / size), F.lit(-(2**40))).cast("bigint")


def in_block(keys: Sequence[str], *order: str):
    return Window.partitionBy(*keys, "_block").orderBy(*order)


def once(df: DataFrame, keys: Sequence[str], order: str, record: str) -> DataFrame:
    """Drop repeated deliveries of a record inside its block, on the partitioning and order the passes use anyway."""
    w = in_block(keys, order, record)
    return df.withColumn("_again", F.lag(record).over(w)).filter(~F.col("_again").eqNullSafe(F.col(record)) | F.col("_again").isNull()).drop("_again")


def carried(df: DataFrame, keys: Sequence[str], order: str, record: str, value: Column, skip_null: bool = False) -> DataFrame:
    """(keys, _block, _in, _more): the last ``value`` before each block and whether a later block follows.

    One row per block goes through the window over the whole sequence. Sequences of one block give no rows.
    """
    return carried_all(df, keys, order, record, {"_in": (value, skip_null)})


def carried_all(df: DataFrame, keys: Sequence[str], order: str, record: str, values: dict[str, tuple[Column, bool]]) -> DataFrame:
    """``carried`` of several values at once, each with whether its NULLs are skipped."""
    place = F.struct(F.col(order), F.col(record))
    lasts = [F.max_by(v, F.when(v.isNotNull(), place) if skip else place).alias(f"_last{n}") for n, (v, skip) in values.items()]
    ends = df.groupBy(*keys, "_block").agg(*lasts)
    w = Window.partitionBy(*keys).orderBy("_block")
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    before = [(F.last(f"_last{n}", ignorenulls=True).over(earlier) if skip else F.lag(f"_last{n}").over(w)).alias(n) for n, (_, skip) in values.items()]
    return ends.select(
        *(F.col(k).alias(f"_c{k}") for k in keys), F.col("_block").alias("_cblock"), *before,
        F.lead("_block").over(w).isNotNull().alias("_more"), F.lag("_block").over(w).isNotNull().alias("_less"),
    ).filter("_more or _less")


def with_carried(df: DataFrame, keys: Sequence[str], ends: DataFrame) -> DataFrame:
    on = [F.col(k).eqNullSafe(F.col(f"_c{k}")) for k in keys] + [F.col("_block") == F.col("_cblock")]
    return df.join(ends, on, "left").drop(*(f"_c{k}" for k in keys), "_cblock")


def stitch(runs: DataFrame, keys: Sequence[str], aggs: Sequence[Column], out: Sequence[str]) -> DataFrame:
    """Join the runs of each sequence that go on across a block's end.

    ``runs`` has one row per run inside a block, with ``_first`` (its place), ``_on`` (it continues the run before the
    block) and ``_tail`` (it may go on in the next block). Only runs with either mark go through the window over the
    whole sequence, at most two per block. ``aggs`` merge the rows of one run; ``out`` names the resulting columns.
    """
    edge = F.col("_on") | F.col("_tail")
    seq = Window.partitionBy(*keys).orderBy("_first").rowsBetween(Window.unboundedPreceding, 0)
    joined = runs.filter(edge).withColumn("_g", F.sum(F.when(F.col("_on"), 0).otherwise(1)).over(seq)).groupBy(*keys, "_g").agg(*aggs)
    return runs.filter(~edge).select(*out).unionByName(joined.select(*out))
