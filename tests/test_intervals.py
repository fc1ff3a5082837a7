"""Merged periods and gaps against a plain sweep."""

from __future__ import annotations

import random

from conftest import rows

from tidewater.operators.intervals import merge_intervals

SHAPE = "e string, rec bigint, s bigint, t bigint, kind string, start_ms string"


def brute(data):
    out = []
    for e in {d[0] for d in data}:
        own = sorted({d[1:4] for d in data if d[0] == e and d[2] is not None and d[3] is not None and d[3] > d[2]}, key=lambda d: (d[1], d[2]))
        periods = []
        for _, s, t in own:
            if periods and s <= periods[-1][1]:
                periods[-1] = (periods[-1][0], max(t, periods[-1][1]), periods[-1][2] or s < periods[-1][1])
            else:
                periods.append((s, t, False))
        out += [(e, "period", *p) for p in periods] + [(e, "gap", a[1], b[0], None) for a, b in zip(periods, periods[1:])]
    return out


def run(spark, data, shard):
    df = spark.createDataFrame([(*d, "x", "y") for d in data], SHAPE)
    return rows(merge_intervals(df, keys=["e"], record="rec", start="s", end="t", shard=shard))


def key(x):
    return [(v is not None, str(type(v)), v) for v in x]


def test_against_a_sweep_across_shards(spark):
    rng = random.Random(4)
    data = []
    for i in range(400):
        s = rng.randrange(-200, 3000)
        data.append((rng.choice(["a", "b", None, "c"]), i, s, s + rng.choice([-3, 0, 1, 4, 9, 40, 150, 900])))
    data += data[:50]  # delivered again
    data += [("a", 900, None, 5), ("a", 901, 5, None), ("n", 902, None, None)]
    for shard in (16, 64, 1 << 18):
        assert run(spark, data, shard) == sorted(brute(data), key=key)


def test_touching_intervals_merge_without_sharing_and_very_long_ones_stay_cheap(spark):
    data = [("a", 1, 0, 10), ("a", 2, 10, 20), ("b", 1, 0, 10**12), ("b", 2, 10**12 + 5, 10**12 + 6), ("c", 1, 0, 100), ("c", 2, 30, 40)]
    got = run(spark, data, 16)
    assert ("a", "period", 0, 20, False) in got and ("c", "period", 0, 100, True) in got
    assert ("b", "period", 0, 10**12, False) in got and ("b", "gap", 10**12, 10**12 + 5, None) in got


def test_equal_records_in_one_place_and_empty_table(spark):
    assert run(spark, [("a", i, 5, 9) for i in range(1000)], 16) == [("a", "period", 5, 9, True)]
    assert merge_intervals(spark.createDataFrame([], SHAPE), keys=["e"], record="rec", start="s", end="t").count() == 0


def test_short_gaps_are_left_out(spark):
    df = spark.createDataFrame([("a", 1, 0, 10, "", ""), ("a", 2, 12, 20, "", ""), ("a", 3, 50, 60, "", "")], SHAPE)
    got = rows(merge_intervals(df, keys=["e"], record="rec", start="s", end="t", min_gap=5).filter("kind = 'gap'"))
    assert got == [("a", "gap", 20, 50, None)]
