"""Runs against a plain loop, with blocks of several sizes."""

from __future__ import annotations

import random

from conftest import rows

from tidewater.llm.runs import collapse_runs, event_form, says_the_same

SHAPE = "id string, part int, pos int, cue bigint, text string, start double, end double, _v string, n string"


def run(spark, data, block):
    df = spark.createDataFrame([(*d, "x", "y") for d in data], SHAPE)
    out = collapse_runs(df, keys=["id", "part"], order="pos", record="cue", text="text", start="start", end="end", block=block)
    return rows(out.select("id", "part", "first_cue", "last_cue", "n", "start", "end"))


def brute(data):
    out = []
    for k in {d[:2] for d in data}:
        before = cur = None
        for d in sorted({d for d in data if d[:2] == k}, key=lambda d: (d[2] is not None, d[2] or 0, d[3])):
            form = event_form(d[4]) if d[4] is not None else None
            if form and before and says_the_same(before, form):
                cur[3:] = [d[3], cur[4] + 1, min(cur[5], d[5]), max(cur[6], d[6])]
            elif form:
                cur = [*k, d[3], d[3], 1, d[5], d[6]]
                out.append(cur)
            before = form
    return sorted((tuple(x) for x in out), key=lambda r: [(x is not None, str(type(x)), x) for x in r])


def test_against_a_loop(spark):
    rng = random.Random(3)
    words = ["the old kettle hums again", "The  old kettle hums again!", "the old ketle hums again", "round 11 starts now", "round 12 starts now", None, "", " ", "[music]", "把小轮子转两圈", "把小轮子转两圈圈圈圈", "别的话"]
    data = [(rng.choice(["a", None]), 1, i, i, rng.choice(words[:3] * 3 + words), i * 1.0, i + rng.random()) for i in range(160)]
    data += data[:30]
    for block in (1, 3, 7, 4096):
        assert run(spark, data, block) == brute(data)


def test_empty_table_and_one_long_run(spark):
    assert run(spark, [], 10) == []
    data = [("a", 1, i, i, "again and again", float(i), i + 1.0) for i in range(500)]
    assert run(spark, data, 16) == [("a", 1, 0, 499, 500, 0.0, 500.0)]
    long = "word " * 20000
    assert run(spark, [("a", 1, 0, 1, long, 0.0, 1.0), ("a", 1, 1, 2, long.upper(), 1.0, 2.0)], 16) == [("a", 1, 1, 2, 2, 0.0, 2.0)]


def test_what_says_the_same():
    same = lambda a, b: says_the_same(event_form(a), event_form(b))
    assert same("I like the microscope.", "i like the mircoscope") and same("说实话，谁也没料到结果", "说实话话话话，谁也没到料结果")
    assert same("ＡＢＣ now", "abc now...") and same("НАКОНЕЦ ВСЕ", "наконец все")
    assert not same("Round 11 starts", "Round 12 starts") and not same("我们走到了那个车站里面", "他们走到了那个车站里面")
    assert not same("what a nice kettle here", "what a nice teapot here") and event_form("♪ ♪") is None and event_form("(sighs)") is None
