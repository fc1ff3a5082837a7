"""Lines garbled here are found and restored; clean ones are left alone."""

from __future__ import annotations

import random

from conftest import SMALL, rows
from pyspark.sql import functions as F

from tidewater.llm import mojibake as m

LINES = [
    "我们今天在{}里看一个很有意思的东西，大家请看第{}个。", "来週は{}で{}を最初から作り直します。", "Слышно, как гудит {}, пока мы идут мимо {}.", "Je préfère dans ce {} démodé, c'est son silence à {}.",
    "Quiero enseñaros una cosa: un {} pequeño y más {}.", "Für {} dauerte es fast vier Stunden, später schön {}.", "That’s right — “{}” costs 5€, café {}.",
]
FILL = ["kettle", "drone", "lantern", "harbor", "桥", "山", "茶壶", "ドローン", "фонарь", "насос", "théâtre", "año", "Tür"]


def corpus(n=1500, seed=2):
    rng = random.Random(seed)
    return [rng.choice(LINES).format(rng.choice(FILL), rng.choice(FILL)) for _ in range(n)]


MODEL = None


def model():
    global MODEL
    MODEL = MODEL or m.Model(corpus())
    return MODEL


def test_held_out_lines():
    clean = corpus(400, 9)
    assert sum(x is not None for x in model().inspect(clean)) <= 2
    for chain in ([("utf-8", "latin-1")], [("utf-8", "cp1252")], [("gbk", "latin-1")], [("utf-8", "cp1251")], [("cp1251", "koi8-r")], [("utf-8", "cp1252"), ("utf-8", "cp1252")]):
        pairs = [(g, x) for x in clean if (g := m.garble(x, chain)) and g != x and len(g) - len(g.encode("ascii", "ignore")) > 3]
        found = model().inspect([g for g, _ in pairs])
        assert len(pairs) >= 10 and sum(f is not None for f in found) > 0.95 * len(pairs)
        assert sum(f is not None and f[1] == x for f, (_, x) in zip(found, pairs)) > 0.9 * len(pairs)


def test_round_trip_of_chains():
    for chain in m.CHAINS[:4]:
        for x in corpus(30, 5):
            g = m.garble(x, chain)
            if g and m._LOST not in g:
                assert m.invert(g, chain) == x
    assert m.invert("plain é", [("utf-8", "latin-1")]) is None


def test_documents(spark):
    good = "Je préfère ce théâtre démodé.\nÇa va très bien à la gare."
    bad = m.garble("Je préfère ce théâtre démodé, c'est son silence à Noël.", [("utf-8", "cp1252")])
    texts = [(1, good), (2, f"first line\r\n{bad}\r\nlast é"), (2, f"first line\r\n{bad}\r\nlast é"), (3, None), (4, ""), (5, "ascii only"), (6, "gone � here"), (7, (good + "\n") * 2000 + bad)]
    df = spark.createDataFrame([(*t, "z") for t in texts], "doc int, text string, restored string")
    got = {r.doc: r for r in m.find_garbled(df, key="doc", text="text", model=model()).collect()}
    assert sorted(got) == [2, 6, 7] and got[6].lost_lines == 1
    assert got[2].restored == "first line\r\nJe préfère ce théâtre démodé, c'est son silence à Noël.\r\nlast é" and got[2].garbled_lines == 1
    assert m.find_garbled(df.limit(0), key="doc", text="text", model=model()).count() == 0


def test_fit_on_tables(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert m.fit(docs, sample=50).inspect(["plain text"]) == [None]
    assert rows(m.find_garbled(docs.withColumn("text", F.lit(None).cast("string")), key="doc_id", text="text", model=model())) == []


def test_lines_of_one_or_two_accents(spark):
    made = [("mac-roman", "cp1252"), ("cp1252", "mac-roman"), ("cp1252", "cp1251"), ("cp850", "cp1252"), ("cp1252", "koi8-r")]
    rng, fill = random.Random(4), ["Löwe", "Tür", "Größe", "Käse", "théâtre", "forêt", "niño", "año", "señal"]
    lines = [f"{rng.choice(['Hier ist', 'Voici le', 'Mira el'])} {rng.choice(fill)} {rng.choice(['', 'und', 'et', 'y'])} {rng.choice(['Tisch', 'table', 'mesa'])}" for _ in range(600)]
    short = m.Model(corpus() + lines)
    for chain in ([c] for c in made):
        pairs = [(g, x) for x in dict.fromkeys(lines) if (g := m.garble(x, chain)) and g != x and sum(c > "\x7f" for c in g) < 3]
        found = short.inspect([g for g, _ in pairs])
        assert len(pairs) >= 10 and sum(f is not None for f in found) > 0.9 * len(pairs)
    assert not any(short.inspect(list(dict.fromkeys(lines)) + ["\xa0", "　 \xa0"]))
    bad = m.garble("Hier ist Löwe und Tisch", [("mac-roman", "cp1252")])
    df = spark.createDataFrame([(1, f"plain\n{bad}"), (2, "Hier ist Löwe und Tisch")], "doc int, text string")
    assert [r.restored for r in m.find_garbled(df, key="doc", text="text", model=short).collect()] == ["plain\nHier ist Löwe und Tisch"]


def test_weak_lines_count_together():
    weak = [{7: (2.5, "ä")}, {7: (2.0, "ö")}, {}]
    assert m.pooled(["Š x", "š y", "z"], [None] * 3, weak) == [(7, "ä"), (7, "ö"), None]
    assert m.pooled(["00 – 01", "01 – 02", "z"], [None] * 3, weak) == [None] * 3
