"""Passes whose decision depends on what was kept before: last-kept removal, budgets, limiters, line breaking.

What was kept decides, not what was seen, so such a pass can't be split within a key. Each runs over the rows of a
partition, sorted by key and order, in Arrow batches: it holds one small state at a time, whatever a key's number of rows,
and the sort spills. Rows are never gathered.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Step = Callable[[tuple], Iterator[tuple]]


def fold_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], out: T.StructType, start: Callable[[], tuple[Step, Step]]) -> DataFrame:
    """(keys, columns of ``out``) of a pass over each key's rows in order, ties by the values.

    ``start`` gives two functions for a new key: one takes a row's (order, values) and yields rows of ``out``, the other is
    called with nothing when the key ends and may yield some as well.
    """
    columns = list(dict.fromkeys([*order, *values]))
    rows = df.select(*keys, *columns).repartition(*keys).sortWithinPartitions(*keys, *columns)
    shape = T.StructType([*(df.schema[k] for k in keys), *out.fields])
    names, n = shape.fieldNames(), len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(shape)
        made: list[tuple] = []
        now, step, close = None, None, None
        give = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made) if made else [[]] * len(names), arrow.types)], schema=arrow)
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if step is None or row[:n] != now:
                    if close:
                        made += [(*now, *x) for x in close(())]
                    now, (step, close) = row[:n], start()
                made += [(*now, *x) for x in step(row[n:])]
            if made:
                yield give()
                made.clear()
        if close:
            made += [(*now, *x) for x in close(())]
        if made:
            yield give()

    return rows.mapInArrow(run, shape)


def _nothing(_: tuple) -> Iterator[tuple]:
    return iter(())


def _fields(df: DataFrame, names: Sequence[str]) -> T.StructType:
    return T.StructType([df.schema[c] for c in names])


def last_kept(df: DataFrame, keys: Sequence[str], order: Sequence[str], bits: str, threshold: int) -> DataFrame:
    """Rows whose hash differs in more than ``threshold`` bits from that of the last row kept, not of the last one seen."""

    def start() -> tuple[Step, Step]:
        last: list[int] = []

        def step(row: tuple) -> Iterator[tuple]:
            own = row[-1]
            if own is not None and (not last or ((last[0] ^ own) & (1 << 64) - 1).bit_count() > threshold):
                last[:] = [own]
                yield row[:-1]

        return step, _nothing

    return fold_rows(df, keys, order, [bits], _fields(df, order), start)


def admitted(df: DataFrame, keys: Sequence[str], order: Sequence[str], amount: str, limit: float) -> DataFrame:
    """Rows admitted to a budget: each whose amount still fits what the admitted ones before it left. Refused rows use nothing."""

    def start() -> tuple[Step, Step]:
        spent = [0.0]

        def step(row: tuple) -> Iterator[tuple]:
            if row[-1] is not None and spent[0] + row[-1] <= limit + 1e-9:
                spent[0] += row[-1]
                yield row[:-1]

        return step, _nothing

    return fold_rows(df, keys, order, [amount], _fields(df, order), start)


def rate_limited(df: DataFrame, keys: Sequence[str], time: str, tie: str, limit: int, span: float) -> DataFrame:
    """Calls admitted by a limiter of ``limit`` calls in any ``span`` seconds; refused calls don't count."""

    def start() -> tuple[Step, Step]:
        held: deque[float] = deque()

        def step(row: tuple) -> Iterator[tuple]:
            while held and held[0] <= row[0] - span:
                held.popleft()
            if len(held) < limit:
                held.append(row[0])
                yield row

        return step, _nothing

    return fold_rows(df.filter(df[time].isNotNull()), keys, [time, tie], [], _fields(df, [time, tie]), start)


def merged_offsets(df: DataFrame, keys: Sequence[str], order: str, value: str, within: float) -> DataFrame:
    """Stretches of rows whose value stays within a distance of the stretch's first row: (keys, first, last, value)."""
    kind = df.schema[order].dataType

    def start() -> tuple[Step, Step]:
        stretch: list = []

        def step(row: tuple) -> Iterator[tuple]:
            if stretch and row[1] is not None and stretch[2] is not None and abs(stretch[2] - row[1]) < within:
                stretch[1] = row[0]
                return
            yield from close(())
            stretch[:] = [row[0], row[0], row[1]]

        def close(_: tuple) -> Iterator[tuple]:
            if stretch:
                yield tuple(stretch)

        return step, close

    out = T.StructType([T.StructField("first", kind), T.StructField("last", kind), T.StructField("value", T.DoubleType())])
    return fold_rows(df, keys, [order], [value], out, start)


def line_breaks(df: DataFrame, keys: Sequence[str], order: str, *, words: int = 12, span: float = 8.0, gap: float = 1.8) -> DataFrame:
    """(keys, first, last) of lines: one closes after so many words, so many seconds, or before a long enough pause."""
    kind = df.schema[order].dataType

    def start() -> tuple[Step, Step]:
        line: list = []  # place and start of its first word, place and end of its last one, number of words

        def step(row: tuple) -> Iterator[tuple]:
            place, begins, ends = row
            if line:
                first, since, last, until, n = line
                if n >= words or _more(until, since, span, True) or _more(begins, until, gap, False):
                    yield first, last
                    line.clear()
            line[:] = [line[0], line[1], place, ends, line[4] + 1] if line else [place, begins, place, ends, 1]

        def close(_: tuple) -> Iterator[tuple]:
            if line:
                yield line[0], line[2]

        return step, close

    return fold_rows(df, keys, [order], ["start", "end"], T.StructType([T.StructField("first", kind), T.StructField("last", kind)]), start)


def _more(a: float | None, b: float | None, than: float, equal: bool) -> bool:
    return a is not None and b is not None and (a - b > than or equal and a - b == than)


def changed(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, least: float) -> DataFrame:
    """Rows whose value differs by at least ``least`` from that of the last row that did; the first one always."""

    def start() -> tuple[Step, Step]:
        last: list = []

        def step(row: tuple) -> Iterator[tuple]:
            if not last or row[-1] is not None and abs(row[-1] - last[0]) >= least:
                if row[-1] is not None:
                    last[:] = [row[-1]]
                yield row[:-1]

        return step, _nothing

    return fold_rows(df, keys, order, [value], _fields(df, order), start)
