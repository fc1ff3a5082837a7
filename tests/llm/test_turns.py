"""Turns from labels in many shapes, with blocks of several sizes."""

from __future__ import annotations

import numpy as np
import pytest
from conftest import rows

from tidewater.llm import turns as A

CUES = "id string, part int, track string, pos int, cue_id bigint, start double, end double, text string, speaker string"
ROSTER = [("v", 1, "Osk", "host"), ("v", 1, "阿岚", "guest"), ("v", 1, "Nilu", "guest"), ("w", 1, "Ada", "host"), (None, 1, "No", "host")]


COLON, COMMA = 1 << A.COLON | A.TAIL, 1 << A.COMMA | A.TAIL
# Pairs as the tables have them: openings, pauses and contexts.
PAIRS = [(bits, gap, ended, same) for gap in (None, 0.0, 100.0, 700.0, 2500.0) for ended in (True, False) for same in (True, False) for bits in (0, 0, 0, COLON, COMMA, COLON | A.TIMED, A.ARROW, COLON | A.ARROW, COLON & ~A.TAIL)]


@pytest.fixture(scope="module")
def model():
    lines = ["we finally carried the lantern across the harbor", "there is one thing I want to show you today", "把小轮子转两圈，木头的茶壶就会自己打开", "come closer so you can see like the others"] * 60
    return A.Model(PAIRS, lines)


def run(spark, model, said, block=4096, page="v"):
    cues = spark.createDataFrame([(page, 1, "t", i, i, float(i), i + 0.9, x, "clash") for i, x in enumerate(said)], CUES)
    cues = cues.unionByName(cues.limit(4))
    pairs = A.adjacent(cues, spark.createDataFrame(ROSTER, "id string, part int, speaker string, role string"), block=block)
    return A.speaker_turns(pairs, model=model)


SAID = [
    "before any label", "Osk: um, hello there", "and more (applause)", None, "♪ ♪", "[00:00:05.000] >> NILU: I am here", "Note: this is no label", "Nilu, look at that please", "<v 阿岚>好的", "【阿岚】继续", "Host: back again", "guest: who is this",
    "Osk (Host): you know, fine", "阿岚——再来", "(01:05) - osk: done", "", "nilu — bye", "Osk，看这里吧", "[nilu] and bye",
]
TURNS = [(1, 2, "Osk"), (5, 7, "Nilu"), (8, 9, "阿岚"), (10, 12, "Osk"), (13, 13, "阿岚"), (14, 14, "Osk"), (16, 18, "Nilu")]


def test_turns(spark, model):
    for block in (1, 2, 5, 4096):
        assert rows(run(spark, model, SAID, block).select("first_cue_id", "last_cue_id", "speaker")) == TURNS


def test_boundaries_come_from_the_trees(spark, model):
    """A model whose trees say the opposite, or nothing, gives other turns."""
    never, always = A.Model([(0, 0.0, True, False)] * 20, ["a line"]), A.Model([(COLON, 0.0, True, False)] * 20, ["a line"])
    turns = lambda m: rows(run(spark, m, SAID).select("first_cue_id", "last_cue_id", "speaker"))
    assert turns(never) == [] and turns(always) != TURNS and turns(model) == TURNS


def test_context_of_a_pair(spark):
    cues = spark.createDataFrame([("v", 1, "t", i, i, 10.0 * i, 10.0 * i + d, x, "") for i, (d, x) in enumerate([(1, "Osk: hello."), (2, "♪"), (3, "well"), (4, "Osk: again"), (5, "Nilu, you")])], CUES)
    roster = spark.createDataFrame(ROSTER, "id string, part int, speaker string, role string")
    for block in (1, 2, 64):
        got = rows(A.adjacent(cues, roster, block=block).select("_r", "_who", "_gap", "_ended", "_same"))
        assert got == [(0, "Osk", None, False, False), (2, None, 19000.0, True, False), (3, "Osk", 7000.0, False, True), (4, "Nilu", 6000.0, False, False)]


def test_clean_text_and_times(spark, model):
    first = run(spark, model, SAID).orderBy("first_cue_id").first()
    assert (first.start, first.end) == (1.0, 2.9) and first.text == "hello there and more"


def test_no_roster_no_cues_and_a_long_turn(spark, model):
    assert run(spark, model, ["Ada: hello"], page="x").count() == 0 and run(spark, model, []).count() == 0
    assert rows(run(spark, model, ["Osk: go"] + ["on and on"] * 300, 16).select("first_cue_id", "last_cue_id", "speaker")) == [(0, 300, "Osk")]
    assert rows(run(spark, model, ["Osk: " + "long " * 30000]).select("speaker")) == [("Osk",)]


def test_boosted_trees_learn_a_rule():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, (400, 4)).astype(float)
    y = ((x[:, 0] == 1) & (x[:, 2] == 0)).astype(float)
    assert (((A.Boosted(x, y).score(x)) >= 0.5) == y).all()


def test_fillers(model):
    assert model.fillers.strip("uh, we came like the others") == "we came like the others" and model.fillers.strip("额……好的") == "好的"
