"""Every query of this subpackage, with the SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

from tidewater.llm import abuse, encode, language, mixing, mojibake, nearest, runs, turns, unify

QUERIES = {
    "p1_found": (nearest.p1_found, nearest.P1_SQL),
    "p2_found": (runs.p2_found, None),
    "p2_runs": (runs.p2_runs, None),
    "p3_found": (unify.p3_found, None),
    "p3_unified": (unify.p3_unified, None),
    "p4_found": (language.p4_found, None),
    "p4_documents": (language.p4_documents, None),
    "p4_tracks": (language.p4_tracks, None),
    "p4_segments": (language.p4_segments, None),
    "p6_found": (abuse.p6_found, None),
    "p6_rates": (abuse.p6_rates, None),
    "p6_scores": (abuse.p6_scores, None),
    "p7_found": (turns.p7_found, None),
    "p7_turns": (turns.p7_turns, None),
    "p8_ids": (encode.p8_ids, None),
    "p8_texts": (encode.p8_texts, encode.TEXTS_SQL),
    "p9_mix": (mixing.p9_mix, None),
    "p9_shares": (mixing.p9_shares, None),
    "p9_sequence": (mixing.p9_sequence, None),
    "p10_found": (mojibake.p10_found, None),
    "p10_restored": (mojibake.p10_restored, None),
}
