"""Shares and caps of mixed sources."""

from __future__ import annotations

import os

import pytest

from tidewater.llm import mixing as M
from tidewater.llm.encode import VOCABULARY

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="needs the vocabulary")


def make(spark, sizes):
    data = [(i * 100000 + n, f"word{n} " * (5 + n % 9), s, "x") for i, (s, k) in enumerate(sizes.items()) for n in range(k)]
    return spark.createDataFrame(data + data[:3] + [(10**7, None, "a", "x"), (10**7 + 1, "", "a", "x"), (10**7 + 2, "no source", None, "x")], "doc bigint, text string, source string, repeats string")


def targets(spark, t):
    return spark.createDataFrame(t, "source string, target_share double, max_repeats int")


def run(spark, docs, t, **more):
    chosen, report = M.mix_sources(docs, targets(spark, t), key="doc", text="text", source="source", **more)
    return chosen.collect(), {r.source: r for r in report.collect()}


def test_shares_and_caps(spark):
    docs = make(spark, {"a": 600, "b": 90, "c": 300, "unasked": 10})
    chosen, report = run(spark, docs, [("a", 0.5, 1), ("b", 0.3, 4), ("c", 0.18, 2), ("gone", 0.02, 3)])
    assert len({r.doc for r in chosen}) == len(chosen) and all(1 <= r.repeats <= {"a": 1, "b": 4, "c": 2}[r.source] for r in chosen)
    for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.18)):
        assert abs(report[s].actual_share - share / 0.98) < 0.01 and report[s].reached
    assert report["gone"].actual_share == 0 and not report["gone"].reached and report["unasked"].tokens == 0
    assert abs(sum(r.actual_share for r in report.values()) - 1) < 1e-4


def test_a_total_that_can_not_be_reached(spark):
    chosen, report = run(spark, make(spark, {"a": 100, "b": 5}), [("a", 0.5, 1), ("b", 0.5, 2)], total=10**6)
    assert report["b"].most_repeats == 2 and report["b"].copies == 10 and not report["b"].reached and report["a"].copies >= 100


def test_a_high_cap(spark):
    docs = make(spark, {"a": 600, "b": 3})
    chosen, report = run(spark, docs, [("a", 0.4, 2), ("b", 0.6, 300)])
    assert report["b"].reached and abs(report["b"].actual_share - 0.6) < 0.01 and 100 < max(r.repeats for r in chosen) <= 300


def test_empty_tables(spark):
    docs = make(spark, {"a": 5})
    assert run(spark, docs.limit(0), [("a", 1.0, 1)])[0] == []
    chosen, report = run(spark, docs, [])
    assert chosen == [] and report["a"].tokens == 0


def test_poisson():
    assert M.capped_mean(0.0, 2) == 0.0 and abs(M.capped_mean(900.0, 10**6) - 900) < 1e-6 and M.capped_mean(M.highest_rate(199.0, 200), 200) > 199 and abs(M.capped_mean(0.2, 50) - 0.2) < 1e-9
