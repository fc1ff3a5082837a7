"""Queries that do the whole job where SQL can't express it, against plain loops over the smallest tables."""

from __future__ import annotations

import difflib
import os
import re
from collections import defaultdict

import pytest
from conftest import SMALL

from tidewater.functions.python import folded, near, ratio, support
from tidewater.plans import registry

if not os.path.isdir(SMALL):
    pytest.skip("needs the driver's tables", allow_module_level=True)


def table(name, key):
    pq = pytest.importorskip("pyarrow.parquet")
    return list({r[key]: r for r in pq.read_table(f"{SMALL}/{name}.parquet").to_pylist()}.values())


def tracks():
    out = defaultdict(list)
    for r in sorted(table("cues", "cue_id"), key=lambda r: (r["pos"], r["text"] or "")):
        out[r["id"], r["part"], r["track"]].append(r)
    return out


def run(spark, name):
    return registry.QUERIES[name][0](spark, SMALL).collect()


def test_words_of_every_script_are_joined(spark):
    want = {}
    for key, cues in tracks().items():
        text = ""
        for w in (r["text"] for r in cues if r["text"] is not None):
            text += " " * bool(re.search(r"[A-Za-z0-9]$", text) and re.match("[A-Za-z0-9]", w)) + w
            want[key] = text.strip()
    got = {(r.id, r.part, r.track): r.line for r in run(spark, "words_join_all")}
    assert got == want and any("一" <= c <= "鿿" for x in want.values() for c in x)


def source_key(text):
    return re.sub(r"[\s\u3000]+", "", text or "").strip("，。！？、!?.,;:：\"'…—-()（）*").lower()


def overlapping():
    spoken, shown = defaultdict(list), defaultdict(list)
    for r in table("cues", "cue_id"):
        if r["track"] in ("whisper", "ocr") and r["end"] > r["start"]:
            (spoken if r["track"] == "whisper" else shown)[r["id"], r["part"]].append(r)
    return {r["cue_id"]: (key, [(r, o) for o in shown[key] if o["end"] > r["start"] and o["start"] < r["end"]]) for key, rs in spoken.items() for r in rs}


def test_sources_of_every_script_are_compared(spark):
    want, windows = {}, defaultdict(lambda: [0, 0])
    for cue, (key, pairs) in overlapping().items():
        if pairs:
            want[cue] = max(ratio(source_key(a["text"]), source_key(b["text"])) for a, b in pairs)
            windows[key][0] += 1
            windows[key][1] += want[cue] < 0.30
    assert {r.cue_id: r.best for r in run(spark, "join_best_overlap_all")} == pytest.approx(want)
    assert {(r.id, r.part): [r.windows, r.disagreeing] for r in run(spark, "agg_cross_source_all")} == windows
    ascii_only = {r.cue_id: r.best for r in run(spark, "join_best_overlap")}
    assert any(want[c] > 0 == ascii_only[c] for c in want)


def test_windows_of_every_script_are_merged(spark):
    said = defaultdict(lambda: {"whisper": [], "ocr": []})
    for r in table("cues", "cue_id"):
        if r["track"] in ("whisper", "ocr"):
            mid = (r["start"] + r["end"]) / 2
            said[r["id"], r["part"], mid // 54][r["track"]].append((mid, r["cue_id"], r["text"] or ""))
    norm = lambda ws: re.sub(r"\W+", "", "".join(x[2] for x in sorted(ws))).casefold()
    want = {k: "short_window_empty" if not w["ocr"] else "short_window_conflict" if w["whisper"] and norm(w["whisper"]) != norm(w["ocr"]) else "replaced" for k, w in said.items()}
    assert {(r.id, r.part, r.core): r.outcome for r in run(spark, "words_window_merge_all")} == want


def test_near_copies_of_the_first_part(spark):
    body = {k: "".join((r["text"] or "").strip() for r in cues) for k, cues in tracks().items()}
    alike = lambda a, b: bool(a and b) and (a == b or difflib.SequenceMatcher(None, a, b).ratio() >= 0.90)
    want = {(i, p, t): alike(x, body[i, 1, t]) for (i, p, t), x in body.items() if p > 1 and (i, 1, t) in body}
    assert {(r.id, r.part, r.track): r.repeats for r in run(spark, "join_near_first_part")} == want
    assert near("abcdefghij" * 3, "abcdefghij" * 3 + "x", 0.90) and not near("abc", "xyz", 0.90) and not near("", "", 0.90)


def test_drifting_captions_are_one(spark, tmp_path):
    key = lambda t: re.sub(r"[\s\u3000]+", "", t).strip("，。！？、!?.,;:：\"'…—-()（）")
    pages = defaultdict(list)
    for r in table("frames", "frame_id"):
        pages[r["id"], r["part"]].append(r)
    want = []
    for page, frames in pages.items():
        groups, last = [], None
        for r in sorted(frames, key=lambda r: (r["ts"] is not None, r["ts"] or 0, r["frame_id"])):
            text = r["ocr"] or None
            if text is not None:
                if last is not None and ratio(key(last), key(text)) >= 0.80:
                    groups[-1].append(r)
                else:
                    groups.append([r])
            last = text
        for i, g in enumerate(groups):
            s, e = g[0]["ts"], groups[i + 1][0]["ts"] if i + 1 < len(groups) else g[-1]["ts"] + 6
            if e - s >= 0.3 and g[0]["ocr"].strip():
                want.append((*page, round(s, 3), round(e, 3), g[0]["ocr"].strip()))
    assert sorted(tuple(r) for r in run(spark, "screen_cues_near")) == sorted(want)
    made = [(i, "v", 1, 6.0 * i, x) for i, x in enumerate(["hello there world", "hello there worlb", None, "hello there world"])]
    spark.createDataFrame(made, "frame_id string, id string, part int, ts double, ocr string").write.parquet(f"{tmp_path}/frames.parquet")
    assert [r.start for r in registry.QUERIES["screen_cues_near"][0](spark, str(tmp_path)).collect()] == [0.0, 18.0]


def test_lyrics_heard_and_folds(spark):
    heard = {k[:2]: [r["text"] for r in cues if r["text"] is not None] for k, cues in tracks().items() if k[2] == "whisper"}
    notes = [r for r in table("documents", "doc_id") if r["source"] == "lyrics_note" and r["id"] and r["text"]]
    want = {}
    for d in notes:
        for line in d["text"].splitlines():
            line = re.sub(r"\[[^\]]*\]|<\d+:[^>]*>", "", line).strip()
            for (i, part), words in heard.items():
                if i == d["id"] and len(folded(line)) >= 3:
                    want[d["doc_id"], part, line] = round(support(folded(line), folded("".join(words))), 4)
    got = run(spark, "join_reference_support")
    assert {(r.doc_id, r.part, r.line): r.support for r in got} == pytest.approx(want) and all(r.supported == (r.support >= 0.64) for r in got)
    assert {r.cue_id: r.folded for r in run(spark, "fn_compatibility_fold")} == {r["cue_id"]: None if r["text"] is None else folded(r["text"]) for r in table("cues", "cue_id")}
    assert folded("½ Ａ") == "12a"


def test_markdown_of_every_page(spark):
    rank, best, chunks = {"human-sub": 0, "whisper": 1}, {}, defaultdict(lambda: defaultdict(str))
    with_text = {k: [r for r in cues if r["text"] is not None and r["start"] is not None] for k, cues in tracks().items()}
    for i, p, t in (k for k, v in with_text.items() if v):
        best[i, p] = min(best.get((i, p), (9, "")), (rank.get(t, 2), t))
    for (i, p), (_, t) in best.items():
        for r in with_text[i, p, t]:
            chunks[i, p][int(r["start"] // 60)] += r["text"]
    want = {}
    for page, windows in chunks.items():
        out = []
        for w, body in sorted(windows.items()):
            body = re.sub(r"(?m)^([^\S\n]*)(#{1,6}|-{3,}|\*{3,}|_{3,}|`{3,}|~{3,})", r"\1\\\2", body.strip())
            out += [f"### [{w:02d}:00]", *([body] if body else []), ""]
        want[page] = "\n".join(out)
    assert {(r.id, r.part): r.body for r in run(spark, "bundle_markdown_all")} == want


def test_markdown_keeps_signs(spark, tmp_path):
    made = [(1, "v", 1, "whisper", 0, 1.0, "# a *b*"), (2, "v", 1, "whisper", 1, 2.0, "\n--- c")]
    spark.createDataFrame(made, "cue_id int, id string, part int, track string, pos int, start double, text string").write.parquet(f"{tmp_path}/cues.parquet")
    assert [r.body for r in registry.QUERIES["bundle_markdown_all"][0](spark, str(tmp_path)).collect()] == ["### [00:00]\n\\# a *b*\n\\--- c\n"]


def test_texts_the_parsers_change(spark):
    timed, listed = [], []
    for key, cues in tracks().items():
        kept = [r for r in cues if r["text"] is not None and r["start"] >= 0 and r["end"] >= 0]
        said = [re.split(r"\n[ \t]*\n", "\n" + re.sub(r"\r\n?", "\n", r["text"]) + "\n\n")[0] for r in kept]
        lines = [" ".join(x for x in (y.strip(" ") for y in t.split("\n")) if x) for t in said]
        timed += [(*key, n, t) for n, t in enumerate(t for t in lines if t)]
        listed += [(*key, n, r["text"].strip(" ")) for n, r in enumerate(kept)]
    for name, want in (("source_srt_all", timed), ("source_vtt_all", timed), ("source_json_cues_all", listed)):
        assert sorted((r.id, r.part, r.track, r.pos, r.text) for r in run(spark, name)) == sorted(want)
