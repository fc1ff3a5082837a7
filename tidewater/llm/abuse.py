"""Problem 6: scoring records for abusive, hateful or sexual content, with rates per source."""

from __future__ import annotations

import random
import re
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.sampling import bounded_sample
from tidewater.llm.text import canonical
from tidewater.tables import cut_lineage, load

WEIGHTS = 1 << 18
#: Distinct unlabelled clauses a fit takes: so many of the most frequent ones, and about as many, at most twice as many,
#: each of those ever written in disguise and of all.
UNLABELLED = 5000
THRESHOLD = 0.5
#: Posterior of being a wording that some writers hide, from which a clause counts as a positive sample.
HIDDEN = 0.95
#: Parts of the unlabelled clauses, each scored by a model that hasn't seen it; descents of such a model and of the last one.
FOLDS, STEPS = 3, (40, 80)
#: Log odds up to which an unlabelled clause stays a harmless sample, and from which it becomes an abusive one.
DOUBT, SURE = -1.4, 1.0
#: Log odds of a clause nothing is known of: few clauses are abusive.
UNKNOWN = -1.5
#: Log odds that count as even: doubtful clauses took no part in the fit and lie about zero.
MARGIN = 1.0
_LEET = str.maketrans("0134578$@", "oieastb" + "sa")
_HAN = "㐀-鿿"
_MIXED = re.compile(r"(?=\w*\d)(?=\w*[a-z])[\w$@]+")
_SPELLED = re.compile(r"(?<!\w)\w(?:[^\w\s,，]{1,3}\w(?!\w))+")
_SPACED = re.compile(rf"(?<!\w)(?:[\w]\s){{2,}}\w(?!\w)|(?<![{_HAN}])(?:[{_HAN}぀-ヿ][^\w\s,，]{{1,3}}){{2,}}[{_HAN}぀-ヿ]")
_MASKED = re.compile(r"(?<=\w)[*•·|]+(?=\w)")
_DRAWN = re.compile(r"([^\W\d])\1{2,}")
_CLAUSE = re.compile(r"[,，;；。!！?？、:：\n]+|(?<=\w)[-.*·]+\s+[-.*·]*")
_NOT_WORD = re.compile(r"[^\w]")


@lru_cache(maxsize=1 << 16)
def unveiled(text: str) -> tuple[str, bool]:
    """The wording behind spaced-out, masked, digit-spelled, drawn-out or look-alike writing, and whether any of the first
    three had to be undone."""
    t = canonical(text)
    was = t
    if any(c in t for c in "-.*_·•|~/'+"):
        t = _SPELLED.sub(lambda m: _NOT_WORD.sub("", m.group()), t)
        t = _MASKED.sub("", t)
    if " " in t:
        t = _SPACED.sub(lambda m: _NOT_WORD.sub("", m.group()), t)
    if any("0" <= c <= "9" or c in "$@" for c in t):
        t = _MIXED.sub(lambda m: m.group().translate(_LEET), t)
    return _DRAWN.sub(r"\1", t), t != was


def undisguised(text: str) -> str:
    return unveiled(text)[0]


def pieces(text: str) -> list[str]:
    """The clauses of a text in their undisguised wording."""
    return [p for p in (" ".join(_NOT_WORD.sub(" ", p).split()) for p in _CLAUSE.split(undisguised(text))) if p]


def features(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of one to five characters of every part, and where each part's begin."""
    padded = [f" {p} " for p in parts]
    sizes = np.fromiter(map(len, padded), np.int64, len(padded))
    chars = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(padded)), sizes)
    wide = (chars >= 0x3040) & (chars < 0xA000)
    prime = np.uint64(0x9E3779B97F4A7C15)
    ids, at = [], []
    for n in (1, 2, 3, 4, 5):
        if len(chars) < n:
            break
        h = np.full(len(chars) - n + 1, np.uint64(n))
        for i in range(n):
            h = (h + chars[i : len(chars) - n + 1 + i]) * prime
        # Single alphabetic letters say nothing; ideographs do.
        keep = (owner[: len(h)] == owner[n - 1 :]) & (wide[: len(h)] if n == 1 else True)
        ids.append(((h >> np.uint64(40)) % np.uint64(WEIGHTS)).astype(np.int64)[keep])
        at.append(owner[: len(h)][keep])
    ids, at = np.concatenate(ids or [np.zeros(0, np.int64)]), np.concatenate(at or [np.zeros(0, np.int64)])
    order = np.argsort(at, kind="stable")
    return ids[order], np.searchsorted(at[order], np.arange(len(parts)))


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0.0], np.cumsum(values)])[np.append(starts, len(values))])


def hidden_wordings(counts: list[tuple[str, int, int]], cycles: int = 60) -> dict[str, float]:
    """For each wording, given with how often it stands alone and how often of those in disguise, the posterior that it
    is one some writers hide.

    A mixture of three binomials by expectation-maximisation: wordings never hidden but by chance, wordings hidden now
    and then, and wordings whose usual writing only looks like a disguise.
    """
    if not counts:
        return {}
    n, d = (np.array([c[i] for c in counts], float) for i in (1, 2))
    rate, share = np.array([1e-4, 0.15, 0.9]), np.array([0.9, 0.05, 0.05])
    for _ in range(cycles):
        ll = np.log(share) + d[:, None] * np.log(rate) + (n - d)[:, None] * np.log1p(-rate)
        p = np.exp(ll - ll.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        share = (p.sum(axis=0) + 1) / (len(n) + 3)
        rate = np.clip((p * d[:, None]).sum(axis=0) / np.maximum((p * n[:, None]).sum(axis=0), 1e-9), [1e-6, 0.02, 0.7], [0.01, 0.5, 0.999])
    return {c[0]: float(x) for c, x in zip(counts, p[:, 1])}


def interchangeable(hateful: list[str], abusive: list[str]) -> list[list[str]]:
    """Groups of terms that stand for each other in hateful clauses: what differs between two clauses equal before and
    behind it. One of the two is a judged one. Terms joined by a slot, however indirectly, are one group."""
    slots: dict[tuple[str, str], set[str]] = defaultdict(set)
    for judged in set(hateful):
        for other in set(abusive):
            if other == judged:
                continue
            lo = 0
            while lo < min(len(judged), len(other)) and judged[lo] == other[lo]:
                lo += 1
            hi = 0
            while hi < min(len(judged), len(other)) - lo and judged[-1 - hi] == other[-1 - hi]:
                hi += 1
            # Alphabetic words are taken whole; terms of ideographs may share their last sign.
            while lo and judged[lo - 1].isalpha() and judged[lo - 1] < "぀":
                lo -= 1
            while hi and judged[len(judged) - hi].isalpha() and judged[len(judged) - hi] < "぀":
                hi -= 1
            a, b = judged[lo : len(judged) - hi].strip(), other[lo : len(other) - hi].strip()
            if a and b and (lo + hi) * 2 >= max(len(a), len(b)) * 2 and max(len(a.split()), len(b.split())) <= 2:
                slots[judged[:lo], judged[len(judged) - hi :]] |= {a, b}
    groups: list[set[str]] = []
    for terms in slots.values():
        if len(terms) < 2:
            continue
        joined, rest = set(terms), []
        for g in groups:
            if g & joined:
                joined |= g
            else:
                rest.append(g)
        groups = [*rest, joined]
    return sorted(sorted(g) for g in groups)


class Classifier:
    """Logistic regression on hashed n-grams, fitted on judged samples and self-trained on unlabelled clauses.

    Beside the squared weights it penalises, for every training sentence that names a group, the squared change of the
    score when the group is swapped for another one, so the group's name by itself carries no weight. The groups are
    what the judged hateful sentences differ in. Unlabelled clauses become samples by two views that know nothing of each
    other: their wording, as the classifier of the round before scores it, and how often they are written in disguise.
    """

    def __init__(
        self, labelled: list[tuple[str, str]], unlabelled: list[tuple[str, int, int]] = (), seed: int = 5, counterfactual: float = 2.0,
        rounds: int = 4,
    ) -> None:
        rng = random.Random(seed)
        self.w, self.b, self.groups = np.zeros(WEIGHTS), UNKNOWN, []
        judged = [(pieces(t), y) for t, y in labelled]
        harmless = {c for parts, y in judged if y == "none" for c in parts}
        single = {c: y for parts, y in judged if y != "none" and len(parts) == 1 for c in parts}
        # The clauses of a judged sentence that are known to be harmless leave the others to be the abusive ones.
        several = [(left, y) for parts, y in judged if y != "none" and len(parts) > 1 and (left := [c for c in parts if c not in harmless])]
        hidden = hidden_wordings([u for u in unlabelled if u[1]])
        wordings = [u[0] for u in unlabelled if u[0] not in harmless and u[0] not in single]
        pseudo = {c for c in wordings if hidden.get(c, 0.0) >= HIDDEN}
        plain = {c for c in wordings if hidden.get(c, 0.0) < 0.5}
        folds = [[c for i, c in enumerate(wordings) if i % FOLDS != k] for k in range(FOLDS)]
        for step in range(rounds if wordings else 1):
            # A judged sentence is abusive if one of its clauses is: the one that scores highest, once there is a score.
            best = {max(parts, key=lambda c: self._raw([c])[0]): y for parts, y in several if step or len(parts) == 1}
            bad = [*single, *best]
            self.groups = interchangeable([c for c, y in [*single.items(), *best.items()] if y == "hate"], [*bad, *pseudo])

            def train(own: list[str], steps: int) -> None:
                self.w[:], self.b = 0.0, UNKNOWN
                sure = set(bad) | (pseudo & set(own))
                good = [c for c in dict.fromkeys([*harmless, *(c for c in own if c in plain)]) if c not in sure]
                samples = [(c, 1.0, 1.0) for c in sorted(sure)] + [(c, 0.0, 3.0 if c in harmless else 1.0) for c in good]
                samples += [(_drop(rng, c), y, k / 2) for c, y, k in samples if len(c) > 8 and (y or c in harmless)]
                self._fit(samples, self._swaps([s[0] for s in samples]), counterfactual, steps)

            # What a clause says is judged by a model that hasn't seen it, else the wrong half of the samples would prove itself.
            scores: dict[str, float] = {}
            for k, own in enumerate(folds if wordings else []):
                train(own, STEPS[0])
                out = wordings[k::FOLDS]
                scores |= zip(out, self._raw(out))
            plain = {c for c, z in scores.items() if z < DOUBT and hidden.get(c, 0.0) < 0.5}
            pseudo = {c for c, z in scores.items() if z > SURE or hidden.get(c, 0.0) >= HIDDEN}
            train(wordings, STEPS[1] if step == rounds - 1 or not wordings else STEPS[0])

    def _swaps(self, texts: list[str]) -> list[tuple[str, str]]:
        pairs = []
        for own in self.groups:
            any_of = re.compile("|".join(sorted(map(re.escape, own), key=len, reverse=True)))
            for t in dict.fromkeys(texts):
                m = any_of.search(t)
                if m:
                    pairs += [(t, t[: m.start()] + o + t[m.end() :]) for o in own if o != m.group()]
        return pairs

    def _raw(self, parts: list[str]) -> np.ndarray:
        ids, starts = features(parts)
        n = np.diff(np.append(starts, len(ids)))
        return _sums(self.w[ids], starts) / np.sqrt(np.maximum(n, 1)) + self.b

    def _fit(self, samples: list[tuple[str, float, float]], pairs: list[tuple[str, str]], counterfactual: float, steps: int) -> None:
        def matrix(parts: list[str]):
            ids, starts = features(parts)
            n = np.diff(np.append(starts, len(ids)))
            return [ids, starts, 1 / np.sqrt(np.maximum(n, 1)), np.repeat(np.arange(len(parts)), n)]

        y, c = np.array([s[1] for s in samples]), np.array([s[2] for s in samples])
        c = np.where(y == 1, c * (c[y == 0].sum() / max(1.0, c[y == 1].sum())) * 0.6, c) if (y == 0).any() else c
        all_ = [matrix([s[0] for s in samples]), *([matrix([p[i] for p in pairs]) for i in (0, 1)] if pairs else [])]
        used, place = np.unique(np.concatenate([m[0] for m in all_]), return_inverse=True)
        cuts = np.cumsum([0, *(len(m[0]) for m in all_)])
        for m, lo, hi in zip(all_, cuts, cuts[1:]):
            m[0] = place[lo:hi]
        (ids, starts, scale, rows), rest = all_[0], all_[1:]
        w, size = self.w[used], len(used)
        m, v = np.zeros(size), np.zeros(size)
        for step in range(1, steps + 1):
            z = _sums(w[ids], starts) * scale + self.b
            g = c * (1 / (1 + np.exp(-z)) - y) / c.sum()
            grad = np.bincount(ids, (g * scale)[rows], size)
            if rest:
                left, right = rest
                d = _sums(w[left[0]], left[1]) * left[2] - _sums(w[right[0]], right[1]) * right[2]
                d = counterfactual * d / len(pairs)
                grad += np.bincount(left[0], (d * left[2])[left[3]], size) - np.bincount(right[0], (d * right[2])[right[3]], size)
            grad = grad + 1e-6 * w
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
            w = w - 0.08 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
        self.w[used] = w

    def score(self, texts: list[str]) -> list[float]:
        """Probability of the worst clause of each text."""
        parts = [pieces(t) for t in texts]
        flat = [c for p in parts for c in p]
        if not flat:
            return [0.0] * len(texts)
        z = 1 / (1 + np.exp(MARGIN - self._raw(flat)))
        out, i = [], 0
        for p in parts:
            out.append(float(z[i : i + len(p)].max()) if p else 0.0)
            i += len(p)
        return out


def _drop(rng: random.Random, text: str) -> str:
    """A copy in which about every second longer word lacks a letter."""
    return re.sub(r"[^\W\d_぀-鿿]{4,}", lambda m: m.group() if rng.random() < 0.5 else (lambda w, i: w[:i] + w[i + 1 :])(m.group(), rng.randrange(1, len(m.group()))), text)


_CLAUSES = T.ArrayType(T.StructType([T.StructField("clause", T.StringType()), T.StructField("alone", T.BooleanType()), T.StructField("hidden", T.BooleanType())]))
_CLAUSES_PA = pa.list_(pa.struct([("clause", pa.string()), ("alone", pa.bool_()), ("hidden", pa.bool_())]))


@F.arrow_udf(_CLAUSES)
def _clauses(texts: pa.Array) -> pa.Array:
    out = []
    for t in texts.to_pylist():
        parts, hidden = pieces(t), unveiled(t)[1]
        out.append([{"clause": c, "alone": len(parts) == 1, "hidden": hidden} for c in dict.fromkeys(parts)])
    return pa.array(out, _CLAUSES_PA)


def wordings(texts: list[DataFrame]) -> DataFrame:
    """(clause, n, alone, hidden): every clause of the given one-column tables, how many texts hold it, how many hold
    nothing else and how many of these are written in disguise. Counts cover all rows, deliveries as they come."""
    one = [t.toDF("text") for t in texts]
    rows = one[0]
    for t in one[1:]:
        rows = rows.unionByName(t)
    rows = rows.filter("text is not null").groupBy("text").agg(F.count("*").alias("k"))
    parts = rows.select("k", F.explode(_clauses("text")).alias("c"))
    total = lambda when: F.sum(F.when(when, F.col("k")).otherwise(0))
    return parts.groupBy("c.clause").agg(F.sum("k").alias("n"), total(F.col("c.alone")).alias("alone"), total(F.col("c.alone") & F.col("c.hidden")).alias("hidden"))


def fit(labels: DataFrame, unlabelled: list[DataFrame] = (), *, text: str = "text", label: str = "label", sample: int = UNLABELLED) -> Classifier:
    """The classifier from a table of judged samples and a bounded number of the clauses of unlabelled one-column tables.

    The clauses and their counts come from all rows; those taken, at most 5 * ``sample``, are the most frequent ones and
    two samples by hash, one of them among the clauses written in disguise at times.
    """
    judged = [(r[0], r[1]) for r in labels.select(text, label).filter(F.col(text).isNotNull()).collect()]
    if not unlabelled:
        return Classifier(judged)
    counts = cut_lineage(wordings(list(unlabelled)))
    taken: dict[str, tuple[str, int, int]] = {}
    for some in (counts.orderBy(F.desc("n"), "clause").limit(sample), bounded_sample(counts, "clause", sample), bounded_sample(counts.filter("hidden > 0"), "clause", sample)):
        taken |= {r.clause: (r.clause, r.alone, r.hidden) for r in some.collect()}
    return Classifier(judged, sorted(taken.values()))


def score_udf(spark, model: Classifier):
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        coded = texts.dictionary_encode()
        return pa.array(shared.value.score(coded.dictionary.to_pylist()), pa.float64()).take(coded.indices)

    return score


def abuse_scores(df: DataFrame, texts: list, model: Classifier, into: str = "score") -> DataFrame:
    """``df`` with the probability that one of the text columns is abusive, hateful or sexual: the highest of them.

    Scores come from the worst clause of a text in its undisguised wording; texts are read whole. Defined results: the
    score is NULL where all the columns are NULL, and 0 for empty text and text without words; repeated rows stay
    repeated; an empty table stays empty; a column named ``into`` is replaced, other columns stay as they are.
    """
    score = score_udf(df.sparkSession, model)
    scores = [score(t) for t in texts]
    return df.withColumn(into, F.greatest(*scores) if len(scores) > 1 else scores[0])


def _scored(spark, sf_dir: str) -> DataFrame:
    crowd = load(spark, sf_dir, "danmaku_raw", "id", "seq", "text")
    live = load(spark, sf_dir, "live_events", "event_type", "seq", "room_id", "msg", "message_trans")
    chats = live.filter("event_type = 'super_chat'")
    labels = load(spark, sf_dir, "moderation_labels", "text", "label")
    phrases = load(spark, sf_dir, "catchphrases", "phrase_id", "text")
    model = fit(labels, [crowd.select("text"), live.filter("event_type in ('danmaku', 'super_chat')").select("msg"), chats.select("message_trans"), phrases.select("text")])
    crowd = abuse_scores(crowd.filter("text is not null"), [F.col("text")], model)
    live = live.filter("event_type in ('danmaku', 'super_chat') and (msg is not null or message_trans is not null)")
    live = abuse_scores(live, [F.col("msg"), F.when(F.col("event_type") == "super_chat", F.col("message_trans"))], model)
    return crowd.select(F.lit("danmaku_raw").alias("tab"), F.col("id").alias("source"), F.col("seq").alias("row_id"), "score").unionByName(
        live.select(F.lit("live_events").alias("tab"), F.col("room_id").cast("string").alias("source"), F.col("seq").alias("row_id"), "score")
    )


def p6_scores(spark, sf_dir: str) -> DataFrame:
    """The score of every record with text."""
    rows = _scored(spark, sf_dir)
    return rows.groupBy("tab", "source", "row_id").agg(F.round(F.max("score"), 6).alias("score"))


def p6_rates(spark, sf_dir: str) -> DataFrame:
    """Records, flagged records and the rate of flagged ones per video id and per room."""
    rows = _scored(spark, sf_dir).groupBy("tab", "source", "row_id").agg(F.max("score").alias("score"))
    flagged = F.count_if(F.col("score") >= THRESHOLD)
    return rows.groupBy("tab", "source").agg(F.count("*").alias("n"), flagged.alias("flagged"), F.round(flagged / F.count("*"), 6).alias("rate"))


def p6_found(spark, sf_dir: str) -> DataFrame:
    """Records that insult, threaten, degrade or are sexually explicit."""
    return _scored(spark, sf_dir).filter(F.col("score") >= THRESHOLD).select("tab", "row_id").distinct()
