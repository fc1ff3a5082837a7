"""Nearest matches against every pair."""

from __future__ import annotations

import random

from conftest import rows

from tidewater.llm.nearest import nearest_in_time, ring_widths

SHAPE = "id string, part int, n bigint, at double, d string, _ms string, distance_ms string"


def brute(left, right, tolerance):
    out = []
    for a in {x[:4] for x in left}:
        best = None
        for b in {x[:4] for x in right}:
            if None in a[:2] or None in b[:2] or a[:2] != b[:2] or a[3] is None or b[3] is None or a[3] != a[3] or b[3] != b[3]:
                continue
            x, y = round(a[3] * 1000), round(b[3] * 1000)
            if abs(x - y) <= tolerance:
                best = min(best or (10**9,), (abs(x - y), y, b[2]))
        if best:
            out.append((a[2], best[2], best[0]))
    return sorted(out)


def run(spark, left, right, tolerance, rings=3):
    make = lambda t: spark.createDataFrame([(*x, "extra", "extra", "extra") for x in t], SHAPE)
    out = nearest_in_time(make(left), make(right).withColumnRenamed("n", "m"), keys=["id", "part"], left_id="n", left_time="at", right_id="m", right_time="at", tolerance_ms=tolerance, rings=rings)
    assert out.columns == ["n", "m", "distance_ms"]
    return rows(out)


def test_against_every_pair(spark):
    rng = random.Random(1)
    at = lambda: rng.choice([None, float("nan"), -0.3, *(rng.randrange(0, 20000) / 1000 for _ in range(12))])
    left = [(rng.choice(["a", "b", None]), rng.choice([1, 2, None]), i, at()) for i in range(300)]
    right = [(rng.choice(["a", "b", None]), rng.choice([1, 2, None]), i, at()) for i in range(400)]
    left, right = left + left[:40], right + right[:40]
    for tolerance, rings in ((400, 3), (1500, 3), (7, 2), (1, 1), (0, 3)):
        assert run(spark, left, right, tolerance, rings) == brute(left, right, tolerance)


def test_ties_take_the_earlier_time_then_the_smaller_id(spark):
    left = [("a", 1, 1, 5.0)]
    right = [("a", 1, 9, 5.1), ("a", 1, 8, 4.9), ("a", 1, 3, 4.9), ("a", 1, 2, 5.1)]
    assert run(spark, left, right, 400) == [(1, 3, 100)]


def test_hot_instant_and_empty_sides(spark):
    left = [("a", 1, i, 5.0) for i in range(500)]
    right = [("a", 1, i, 5.2) for i in range(2000)]
    assert run(spark, left, right, 400) == [(i, 0, 200) for i in range(500)]
    assert run(spark, left, [], 400) == [] and run(spark, [], right, 400) == []


def test_ring_widths_double_up_to_the_tolerance():
    assert ring_widths(400, 3) == [100, 200, 400] and ring_widths(1500, 3) == [375, 750, 1500] and ring_widths(1, 3) == [1]
