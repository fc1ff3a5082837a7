"""Registering of queries with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tidewater.tables import load

Query = Callable[..., DataFrame]
QUERIES: dict[str, tuple[Query, str | None]] = {}
# The column that identifies a record of each table whose rows may be delivered more than once.
RECORD = {"transcripts": "transcript_id", "cues": "cue_id", "frames": "frame_id", "danmaku_raw": "seq", "live_events": "seq", "clip_inputs": "id"}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name or fn.__name__] = (fn, sql)
        return fn

    return register


def records(spark, sf_dir: str, name: str, *columns: str, where: str | None = None) -> DataFrame:
    """The named columns of a table, each record once however often it was delivered.

    Deliveries are alike in every column, so rows that ``where`` leaves out go before the shuffle that finds repeats.
    """
    key = RECORD[name]
    rows = load(spark, sf_dir, name, *dict.fromkeys([key, *columns]))
    return (rows.filter(where) if where else rows).dropDuplicates([key])
