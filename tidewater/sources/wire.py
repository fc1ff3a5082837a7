"""Decoding of protobuf messages of comments and widgets. The pip distribution of Spark has no protobuf functions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMMENT = T.ArrayType(T.StructType([
    T.StructField("content_ts", T.DoubleType()), T.StructField("text", T.StringType()), T.StructField("high_like", T.BooleanType()), T.StructField("mid_hash", T.StringType()),
]))
WIDGET = T.ArrayType(T.StructType([
    T.StructField("id", T.LongType()), T.StructField("command", T.StringType()), T.StructField("content", T.StringType()), T.StructField("progress_ms", T.LongType()), T.StructField("extra", T.StringType()),
]))


class _Reader:
    """A cursor over one message."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def number(self) -> int:
        value = bits = 0
        while True:
            if self.at >= len(self.data):
                raise EOFError
            byte = self.data[self.at]
            self.at += 1
            value |= (byte & 127) << bits
            if byte < 128:
                return value
            bits += 7

    def message(self) -> dict[int, list]:
        """All values by field number; bytes for anything but varints."""
        out: dict[int, list] = {}
        while self.at < len(self.data):
            field, kind = divmod(self.number(), 8)
            if kind == 0:
                value: int | bytes = self.number()
            else:
                if kind not in (1, 2, 5):
                    raise ValueError(kind)
                size = self.number() if kind == 2 else 8 if kind == 1 else 4
                if self.at + size > len(self.data):
                    raise EOFError
                value = self.data[self.at : self.at + size]
                self.at += size
            out.setdefault(field, []).append(value)
        return out


def _bodies(data: bytes | None, field: int) -> list[dict[int, list]]:
    """The messages in a repeated field; none if any part of the data is no protobuf."""
    try:
        return [_Reader(x).message() for x in _Reader(data or b"").message().get(field, []) if isinstance(x, bytes)]
    except (EOFError, ValueError):
        return []


def _text(body: dict[int, list], field: int) -> str | None:
    value = body.get(field, [None])[-1]
    return value.decode("utf-8", "replace") if isinstance(value, bytes) else None


def _whole(body: dict[int, list], field: int) -> int:
    value = body.get(field, [0])[-1]
    return value if isinstance(value, int) else 0


def comments(data: bytes | None) -> list[dict]:
    return [
        {"content_ts": _whole(b, 2) / 1000, "text": _text(b, 7), "high_like": bool(_whole(b, 13) & 4), "mid_hash": _text(b, 6) or ""}
        for b in _bodies(data, 1) if _text(b, 7) is not None
    ]


def widgets(data: bytes | None) -> list[dict]:
    return [
        {"id": _whole(b, 1), "command": _text(b, 4), "content": _text(b, 5), "progress_ms": _whole(b, 6) or None, "extra": _text(b, 9)}
        for b in _bodies(data, 9)
    ]


@F.arrow_udf(COMMENT)
def decode_comments(data: pa.Array) -> pa.Array:
    """The comments of each segment; none for bytes that are no protobuf. Comments without text are left out."""
    kind = pa.list_(pa.struct([("content_ts", pa.float64()), ("text", pa.string()), ("high_like", pa.bool_()), ("mid_hash", pa.string())]))
    return pa.array([comments(x) for x in data.to_pylist()], kind)


@F.arrow_udf(WIDGET)
def decode_widgets(data: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("id", pa.int64()), ("command", pa.string()), ("content", pa.string()), ("progress_ms", pa.int64()), ("extra", pa.string())]))
    return pa.array([widgets(x) for x in data.to_pylist()], kind)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | bytes) -> bytes:
    if isinstance(value, int):
        return _varint(number * 8) + _varint(value)
    return _varint(number * 8 + 2) + _varint(len(value)) + value


def encode_comments(rows: list[dict]) -> bytes:
    """A segment with the given comments, for tests and round trips."""
    return b"".join(
        _field(1, _field(2, round((r["content_ts"] or 0) * 1000)) + (_field(6, r["mid_hash"].encode()) if r["mid_hash"] else b"") + _field(7, r["text"].encode()) + _field(13, 4 if r["high_like"] else 0))
        for r in rows
    )


@F.arrow_udf(T.BinaryType())
def encode_segment(rows: pa.Array) -> pa.Array:
    return pa.array([encode_comments(x or []) for x in rows.to_pylist()], pa.binary())
