"""Problem 4: a language with a confidence for every document, track and segment."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.mojibake import CHAINS, garble
from tidewater.llm.sampling import bounded_sample
from tidewater.llm.text import LOOKALIKES, canonical, osa, per_distinct, wordless
from tidewater.tables import cut_lineage, load

LANGS = ["zh", "en", "ja", "es", "fr", "de", "ru"]
LATIN = [LANGS.index(x) for x in ("en", "es", "fr", "de")]
# The subtags that name each language.
SUBTAGS = {
    "zh": "zh zho chi cmn yue chinese mandarin", "en": "en eng english", "ja": "ja jpn jp japanese", "es": "es spa spanish español",
    "fr": "fr fra fre french français", "de": "de deu ger german deutsch", "ru": "ru rus russian русский",
}
# A few sentences that set the first model up where a sample holds none of a language.
SEEDS = {
    "zh": ["我们今天在这里看一个很有意思的东西，大家请看。", "这是什么？我也不知道，不过他们说没有问题。"],
    "en": ["This is what we have been looking for, and it was right there all along.", "They said that you should not have to wait for it."],
    "ja": ["これはとても面白いものですが、どうしてここにあるのでしょうか。", "私たちは明日も来ますので、よろしくお願いします。"],
    "es": ["Esto es lo que hemos estado buscando y estaba aquí mismo todo el tiempo.", "Dijeron que no tendrías que esperar mucho más por ello."],
    "fr": ["C'est ce que nous avons cherché et c'était juste ici depuis le début.", "Ils ont dit que vous ne devriez pas attendre plus longtemps pour cela."],
    "de": ["Das ist genau das, was wir gesucht haben, und es war die ganze Zeit hier.", "Sie haben gesagt, dass du nicht länger darauf warten musst."],
    "ru": ["Это именно то, что мы искали, и оно всё время было здесь.", "Они сказали, что вам не придётся больше этого ждать."],
}
FEATURES = 1 << 17
SAMPLE_DOCS = 1500
#: n-grams overlap, so a text's log likelihood counts only in part.
TEMPER = 0.35
#: Grid on which the log odds of a segment's likeliest language against each language are kept, a hexadecimal digit each.
LEVELS = [0.0, 0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 5.0, 6.0, 8.0, 11.0, 16.0]
ODDS = [float(np.exp(-(a + b) / 2)) for a, b in zip(LEVELS, LEVELS[1:])] + [1e-9]
ODDS[0] = 1.0
#: Letters of a segment from which on its letters count in full; a few may be a loanword or a name.
FULL = 12
CYCLES = 25
#: Characters worked on at once; the arrays take some fifty bytes for each.
SLICE = 1 << 19


@lru_cache(maxsize=1)
def _folding() -> tuple[np.ndarray, np.ndarray]:
    """For each code point the one that stands for it (0: leave out, 32: no letter) and whether that is a letter."""
    fold = np.full(0x110000, 32, np.uint32)
    for c in range(0x80, 0x30000):
        if 0xD800 <= c < 0xE000 or 0x3400 <= c < 0xA000 or 0xAC00 <= c < 0xD7A4 or c >= 0x20000:
            fold[c] = c
            continue
        kind = unicodedata.category(chr(c))
        if kind in ("Cf", "Mn") or 0xFE00 <= c < 0xFE10:
            fold[c] = 0
        else:
            one = unicodedata.normalize("NFKC", chr(c)).lower()
            if one and unicodedata.category(one[0])[0] == "L":
                fold[c] = ord(one[0])
            elif kind[0] != "N" and kind not in ("Zs", "Po", "Pd", "Ps", "Pe", "Pi", "Pf"):
                fold[c] = c  # symbols and controls are what garbled text consists of
    for c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
        fold[c] = c + 32
    for c in b"abcdefghijklmnopqrstuvwxyz":
        fold[c] = c
    letter = (fold != 32) & (fold != 0)
    return fold, letter


def segments(texts: list[str], split: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded characters of all texts, the segment each is in, and the text each segment is of.

    With ``split`` a line or sentence is a segment, else a text.
    """
    raw = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.zeros(len(raw) + 1, bool)
    starts[np.cumsum(sizes)[:-1]] = True
    starts[0] = True
    if split:
        ends = np.isin(raw, np.array([10, 13, 33, 46, 63, 0x3002, 0xFF01, 0xFF1F, 0x2026], np.uint32))
        starts[1:] |= ends
    owner = np.repeat(np.arange(len(texts)), sizes)
    seg = np.cumsum(starts[: len(raw)]) - 1
    seg_owner = owner[starts[: len(raw)]] if len(raw) else np.zeros(0, np.int64)
    fold = _folding()[0][raw]
    keep = fold != 0
    return fold[keep].astype(np.uint64), seg[keep], seg_owner


def _features(chars: np.ndarray, seg: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashed n-grams of one to three characters, each with its segment."""
    prime = np.uint64(0x9E3779B97F4A7C15)
    out = []
    for n in (1, 2, 3):
        if len(chars) < n:
            continue
        h = np.zeros(len(chars) - n + 1, np.uint64)
        letters = np.zeros(len(h), bool)
        for i in range(n):
            part = chars[i : len(chars) - n + 1 + i]
            h = (h + part) * prime
            letters |= part != 32
        same = (seg[: len(h)] == seg[n - 1 :]) & letters if n > 1 else letters
        out.append((((h >> np.uint64(40)) % np.uint64(FEATURES)).astype(np.int64)[same], seg[: len(h)][same]))
    return out


class Model:
    """Log probability of every hashed n-gram in each language."""

    def __init__(self, texts: list[str], labels: list[int | None], rounds: int = 2) -> None:
        self._train([x for v in SEEDS.values() for x in v], [i for i, v in enumerate(SEEDS.values()) for _ in v], augment=False)
        known = [(t, y) for t, y in zip(texts, labels) if y is not None and t]
        if not known:
            return
        lines = [(x, y) for t, y in known for x in re.split(r"[\r\n]+", t) if x.strip()]
        parts, tags = [x for x, _ in lines], [y for _, y in lines]
        self._train(parts, tags, augment=False)
        for i in range(rounds):
            # Labels may be wrong and documents mixed: go on with the language the lines themselves suggest.
            ll, n, _ = self.likelihoods(parts, split=False)
            tags = [int(x) if k else y for x, k, y in zip(ll.argmax(axis=1), n, tags)]
            self._train(parts, tags, augment=i == rounds - 1)

    def _train(self, texts: list[str], labels: list[int], augment: bool) -> None:
        sets: list[list[str]] = [list(SEEDS[lang]) for lang in LANGS]
        for t, y in zip(texts, labels):
            sets[y].append(t)
        counts = np.zeros((FEATURES, 8), np.float64)
        for y, own in enumerate(sets):
            groups = [(own, 1.0)]
            if augment:
                some = own[:: max(1, len(own) // 150)]
                groups += [([g for x in some if (g := garble(x, c)) and g != x], 0.02 * len(own) / max(1, len(some))) for c in CHAINS]
                if LANGS[y] in ("en", "es", "fr", "de"):
                    groups.append(([_disguise(x) for x in some], 0.05 * len(own) / max(1, len(some))))
            for texts_, weight in groups:
                if texts_:
                    chars, seg, _ = segments(texts_, False)
                    for ids, _ in _features(chars, seg):
                        counts[:, y] += weight * np.bincount(ids, minlength=FEATURES)
        counts += 0.05
        self.logp = np.log(counts / counts.sum(axis=0)).astype(np.float32)
        self.logp[:, 7] = 0

    def likelihoods(self, texts: list[str], split: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per segment: tempered log likelihood by language, number of letters, and the text it is of."""
        chars, seg, owner = segments(texts, split)
        ll = np.zeros((len(owner), 8), np.float64)
        for ids, at in _features(chars, seg):
            for lo in range(0, len(ids), 1 << 19):
                part, where = self.logp[ids[lo : lo + (1 << 19)]], at[lo : lo + (1 << 19)]
                firsts = np.flatnonzero(np.diff(where, prepend=-1))
                if len(firsts):
                    ll[where[firsts]] += np.add.reduceat(part, firsts, axis=0)
        letters = np.bincount(seg[chars != 32], minlength=len(owner)) if len(owner) else np.zeros(0, np.int64)
        if not split and len(owner) < len(texts):  # empty texts have no segment of their own
            full = np.zeros((len(texts), 8))
            n = np.zeros(len(texts), np.int64)
            full[owner], n[owner] = ll, letters
            ll, letters, owner = full, n, np.arange(len(texts))
        return ll[:, :7] * TEMPER, letters, owner

    def codes(self, texts: list[str], split: bool) -> tuple[np.ndarray, np.ndarray]:
        """Code of each segment with letters, and the text it is of. Works on about SLICE characters at a time."""
        done, lo, size = [], 0, 0
        for hi, t in enumerate(texts, 1):
            size += len(t)
            if size >= SLICE or hi == len(texts):
                code, owner = self._codes(texts[lo:hi], split)
                done.append((code, owner + lo))
                lo, size = hi, 0
        if not done:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([c for c, _ in done]), np.concatenate([o for _, o in done])

    def _codes(self, texts: list[str], split: bool) -> tuple[np.ndarray, np.ndarray]:
        ll, letters, owner = self.likelihoods(texts, split)
        keep = letters > 0
        ll, owner, letters = ll[keep], owner[keep], letters[keep]
        if not len(ll):
            return np.zeros(0, np.int64), owner
        best = ll.argmax(axis=1)
        gap = ll[np.arange(len(ll)), best][:, None] - ll
        # A few letters may be a loanword: between languages of one script they count for less.
        latin = np.isin(best, LATIN)
        gap[:, LATIN] *= np.where(latin, np.minimum(1.0, letters / FULL), 1.0)[:, None]
        level = np.searchsorted(LEVELS, gap, "right") - 1
        return (level << (4 * np.arange(7))).sum(axis=1), owner


def _disguise(text: str) -> str:
    table = str.maketrans({line[0]: line[2] for line in LOOKALIKES.split("\n") if line and line[0].isascii()})
    return text.translate(table)


def mixtures(entity: np.ndarray, code: np.ndarray, count: np.ndarray, entities: int) -> tuple[np.ndarray, np.ndarray]:
    """Language proportions of each entity by expectation-maximisation, and the number of segments.

    Segments come as counts of codes, those of an entity side by side. A language whose part explains the segments
    hardly better than the others would, by less than a penalty that grows with their number, is taken out and the rest
    is fitted again.
    """
    odds = np.array(ODDS)[code[:, None] >> (4 * np.arange(7)) & 15]
    total = np.bincount(entity, count, entities)
    firsts = np.flatnonzero(np.diff(entity, prepend=-1))
    there = entity[firsts]

    def summed(values: np.ndarray) -> np.ndarray:
        out = np.zeros((entities, 7))
        if len(firsts):
            out[there] = np.add.reduceat(values, firsts, axis=0)
        return out

    def fit(pi: np.ndarray) -> np.ndarray:
        for _ in range(CYCLES):
            share = pi[entity] * odds
            share *= (count / np.maximum(share.sum(axis=1), 1e-300))[:, None]
            new = summed(share) * (pi > 0)
            pi = new / np.maximum(new.sum(axis=1, keepdims=True), 1e-300)
        return pi

    pi = fit(np.full((entities, 7), 1 / 7))
    # Loss of log likelihood if a language weren't there: its segments fall to the others they could be of.
    mine = pi[entity] * odds
    mix = mine.sum(axis=1, keepdims=True)
    loss = summed(count[:, None] * np.log(np.maximum(mix, 1e-300) / np.maximum(mix - mine, 1e-12)))
    penalty = np.log(total + 1) + 1.0
    pi = pi * ((loss >= penalty[:, None]) | (pi == pi.max(axis=1, keepdims=True)))
    return fit(pi / np.maximum(pi.sum(axis=1, keepdims=True), 1e-300)), total


def fit(documents: DataFrame, sample: int = SAMPLE_DOCS) -> Model:
    """The n-gram model, fitted on at most 2 * ``sample`` documents and their labels, right or wrong."""
    rows = bounded_sample(documents.select("doc_id", "text", named(F.col("lang")).alias("lang")), "doc_id", sample).select("text", "lang").collect()
    return Model([r.text for r in rows], [LANGS.index(r.lang) if r.lang in LANGS else None for r in rows])


def named(label: str | Column) -> Column:
    """The language a label names in any customary spelling, a region, a script and a machine prefix aside; else NULL."""
    col = F.col(label) if isinstance(label, str) else label
    tag = F.split(F.regexp_replace(F.lower(F.trim(col)), r"^(ai|auto|machine)[-_]", ""), "[-_. ]")[0]
    out = F.lit(None).cast("string")
    for lang, words in SUBTAGS.items():
        out = F.when(tag.isin(words.split()), lang).otherwise(out)
    return out


_VERDICT = T.StructType([
    T.StructField("lang", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("langs", T.ArrayType(T.StringType())),
    T.StructField("shares", T.ArrayType(T.DoubleType())),
])
_VERDICT_PA = pa.struct([("lang", pa.string()), ("confidence", pa.float64()), ("langs", pa.list_(pa.string())), ("shares", pa.list_(pa.float64()))])


def _verdicts(pi: np.ndarray, total: np.ndarray) -> pa.Array:
    top = pi[:, :7].argmax(axis=1)
    rows = [
        None if not n else {"lang": LANGS[t], "confidence": float(p[t]), "langs": [x for x, v in zip(LANGS, p) if v > 0], "shares": p[:7].tolist()}
        for p, n, t in zip(pi, total, top)
    ]
    return pa.array(rows, _VERDICT_PA)


def document_udf(spark, model: Model):
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf(_VERDICT)
    def language(texts: pa.Array) -> pa.Array:
        coded = texts.dictionary_encode()
        values = coded.dictionary.to_pylist()
        code, owner = shared.value.codes(values, split=True) if values else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        done = _verdicts(*mixtures(owner, code, np.ones(len(code)), len(values)))
        return done.take(coded.indices)

    return language


def segment_udf(spark, model: Model):
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf(T.IntegerType())
    def code(texts: pa.Array) -> pa.Array:
        coded = texts.dictionary_encode()
        values = coded.dictionary.to_pylist()
        found: list[int | None] = [None] * len(values)
        worded = [i for i, x in enumerate(values) if not (x[:1] in "[(（【［*♪♫♬<" or len(x) < 3) or not wordless(x)]
        for c, o in zip(*shared.value.codes([values[i] for i in worded], split=False)):
            found[worded[o]] = int(c)
        return pa.array(found, pa.int32()).take(coded.indices)

    return code


@F.arrow_udf(_VERDICT)
def _mixture(codes: pa.Array, counts: pa.Array) -> pa.Array:
    sizes = np.array([len(x) for x in codes], np.int64)
    entity = np.repeat(np.arange(len(sizes)), sizes)
    flat = lambda x, kind: np.array(x.flatten().to_numpy(zero_copy_only=False), kind)
    return _verdicts(*mixtures(entity, flat(codes, np.int64), flat(counts, np.float64), len(sizes)))


def document_languages(df: DataFrame, *, key: str, text: str, model: Model) -> DataFrame:
    """(key, lang, confidence, langs): the language most of a document's sentences are in, and its share of them.

    Each line or sentence gets its likelihood in each language from character n-grams (garbled spellings included);
    expectation-maximisation over the sentences of a document estimates its language proportions, and a penalised
    likelihood selects its set of languages. Defined results: NULL, empty and wordless texts give NULLs; texts are read
    whole; repeated rows of a key give one row; an empty table gives no rows; other columns are not read.
    """
    language = document_udf(df.sparkSession, model)
    rows = df.select(F.col(key).alias("_key"), language(F.col(text)).alias("x")).dropDuplicates(["_key"])
    return rows.select(F.col("_key").alias(key), "x.lang", "x.confidence", "x.langs")


def sequence_languages(df: DataFrame, *, keys: list[str], record: str, text: str, model: Model) -> tuple[DataFrame, DataFrame]:
    """The languages of sequences of segments, as (keys, lang, confidence, langs) and (keys, record, lang, confidence).

    Per sequence only the counts of segment codes are gathered, whose number is bounded by the grid, however long the
    sequence is. A segment's language follows from its own likelihoods in all languages and the proportions of its
    sequence, so a short or ambiguous segment stands in the language of the sequence, with little confidence. Wordless
    segments and sound marks have no row and no vote; repeated rows count once; an empty table gives no rows; other
    columns are not read.
    """
    ks = [f"_k{i}" for i in range(len(keys))]
    code = segment_udf(df.sparkSession, model)
    rows = df.select(*(F.col(k).alias(a) for k, a in zip(keys, ks)), F.col(record).alias("_r"), code(F.col(text)).alias("code"))
    rows = cut_lineage(rows.filter("code is not null").groupBy(*ks, "_r").agg(F.min("code").alias("code")))
    counts = rows.groupBy(*ks, "code").agg(F.count("*").alias("n"))
    whole = counts.groupBy(*ks).agg(F.collect_list(F.struct("code", "n")).alias("x"))
    whole = whole.select(*ks, _mixture(F.col("x.code"), F.col("x.n")).alias("v"))
    names = F.array(*map(F.lit, LANGS))
    on = [F.col(k).eqNullSafe(F.col(f"s{k}")) for k in ks]
    side = whole.select(*(F.col(k).alias(f"s{k}") for k in ks), "v")
    # The proportions are smoothed a little: any segment may be in any language.
    table = F.array(*map(F.lit, ODDS))
    each = F.array(*((F.get("v.shares", F.lit(i)) + 0.003) * F.get(table, F.shiftright("code", 4 * i).bitwiseAND(15)) for i in range(7)))
    parts = rows.join(side, on).withColumn("p", each).select(
        *ks, "_r", F.col("v.lang").alias("whole"), F.get(names, (F.array_position("p", F.array_max("p")) - 1).cast("int")).alias("lang"),
        (F.array_max("p") / F.aggregate("p", F.lit(0.0), lambda a, x: a + x)).alias("confidence"),
    )
    back = [F.col(a).alias(k) for k, a in zip(keys, ks)]
    return (
        whole.select(*back, "v.lang", "v.confidence", "v.langs"),
        parts.select(*back, F.col("_r").alias(record), "lang", "confidence", "whole"),
    )


class Phrases:
    """Tells texts that are one of a few phrases, up to case, punctuation, more signs than half or lost or changed letters.

    A text longer than twice the longest phrase can be none, so texts of any length are told exactly.
    """

    def __init__(self, phrases: list[str], slips: int = 2) -> None:
        self.slips, self.of_length = slips, {}
        for p in {"".join(c for c in canonical(p) if c.isalnum()) for p in phrases}:
            self.of_length.setdefault(len(p), []).append(p)
        self.longest = max(self.of_length, default=0)

    def like(self, text: str) -> bool:
        form = "".join(c for c in canonical(text) if c.isalnum())
        if len(form) >= max(2 * self.longest, self.longest + self.slips + 1):
            return False
        for n, same in self.of_length.items():
            if n * 2 > len(form) and any(p in form for p in same):
                return True
            if abs(n - len(form)) <= self.slips and any(osa(p, form, self.slips) <= self.slips for p in same):
                return True
        return False


#: Phrases beyond which a table is no configuration that may be sent to every executor.
MOST_PHRASES = 20_000


def phrase_udf(spark, phrases: DataFrame, text: str = "text"):
    known = [r[0] for r in phrases.select(text).filter(F.col(text).isNotNull()).limit(MOST_PHRASES + 1).collect()]
    if len(known) > MOST_PHRASES:
        raise ValueError(f"more than {MOST_PHRASES} phrases")
    shared = spark.sparkContext.broadcast(Phrases(known))

    @F.arrow_udf(T.BooleanType())
    def like(texts: pa.Array) -> pa.Array:
        return per_distinct(texts, shared.value.like, pa.bool_())

    return like


def _cues(spark, sf_dir: str, model: Model) -> tuple[DataFrame, DataFrame]:
    cues = load(spark, sf_dir, "cues", "id", "part", "track", "cue_id", "text")
    return sequence_languages(cues, keys=["id", "part", "track"], record="cue_id", text="text", model=model)


def _model(spark, sf_dir: str) -> Model:
    return fit(load(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def p4_documents(spark, sf_dir: str) -> DataFrame:
    """Language, confidence and set of languages of every document."""
    return document_languages(load(spark, sf_dir, "documents", "doc_id", "text"), key="doc_id", text="text", model=_model(spark, sf_dir))


def p4_tracks(spark, sf_dir: str) -> DataFrame:
    """Language, confidence and set of languages of every track."""
    return _cues(spark, sf_dir, _model(spark, sf_dir))[0]


def p4_segments(spark, sf_dir: str) -> DataFrame:
    """Language and confidence of every worded cue."""
    return _cues(spark, sf_dir, _model(spark, sf_dir))[1].drop("whole")


def p4_found(spark, sf_dir: str) -> DataFrame:
    """Tracks and documents with a missing or wrong label, and cues in another language than their track."""
    model = _model(spark, sf_dir)
    tracks, parts = _cues(spark, sf_dir, model)
    heads = load(spark, sf_dir, "transcripts", "transcript_id", "id", "part", "track", "language").distinct()
    wrong = ~named("language").eqNullSafe(F.col("lang"))
    headed = heads.join(tracks, ["id", "part", "track"]).filter(wrong).select(F.lit("transcripts").alias("tab"), F.col("transcript_id").alias("row_id"), "lang")
    # A catchphrase, a fixed small table, stands in the language of its track.
    like = phrase_udf(spark, load(spark, sf_dir, "catchphrases", "text"))
    odd = parts.filter("lang <> whole").select("cue_id", "lang")
    texts = load(spark, sf_dir, "cues", "cue_id", "text")
    # The condition names a column of either side, else it would be worked out for every cue, below the join.
    odd_text = F.when(F.col("lang").isNotNull(), F.col("text"))
    odd = odd.join(texts, "cue_id").distinct().filter(~F.coalesce(like(odd_text), F.lit(False)))
    odd = odd.select(F.lit("cues").alias("tab"), F.col("cue_id").alias("row_id"), "lang")
    documents = load(spark, sf_dir, "documents", "doc_id", "text", "lang")
    language = document_udf(spark, model)
    docs = documents.select("doc_id", named("lang").alias("said"), language("text").alias("x")).filter("x.lang is not null and not (said <=> x.lang)")
    docs = docs.select(F.lit("documents").alias("tab"), F.col("doc_id").alias("row_id"), "x.lang").distinct()
    return headed.distinct().unionByName(odd).unionByName(docs)
