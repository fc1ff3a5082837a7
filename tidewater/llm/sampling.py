"""A bounded, repeatable sample of rows for fitting models on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded_sample(df: DataFrame, key: str, rows: int, seed: int = 11) -> DataFrame:
    """About ``rows`` rows of ``df``, never more than twice as many, chosen by the hash of ``key``."""
    total = df.count()
    share = min(1.0, rows / max(1, total))
    picked = df.filter(F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 30)) < int(share * (1 << 30)))
    return picked.limit(2 * rows)
