"""Problem 7: turning transcripts with speaker labels into clean, ordered speaker turns."""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.blocks import BLOCK, block_of, carried, carried_all, in_block, once, stitch, with_carried
from tidewater.llm.sampling import bounded_sample
from tidewater.llm.text import SOUND, many_distinct, plain, plain_many, says_nothing, wordless
from tidewater.tables import cut_lineage, load

# Words for the two roles.
ROLES = {
    "host": "host presenter moderator moderatorin moderation gastgeber gastgeberin 主持人 主持 主播 司会 司会者 ホスト presentador presentadora anfitrión animateur animatrice "
    "présentateur présentatrice ведущий ведущая хост",
    "guest": "guest 嘉宾 来宾 ゲスト invitado invitada huésped gast invité invitée гость гостья",
}
# Fillers, and which of them are words of their own elsewhere.
FILLERS = (
    "uh|um|uhm|er|erm|hmm|mm|you know|i mean|like|well|so|basically|äh|ähm|hm|na ja|also|halt|euh|heu|ben|bah|du coup|en fait|este|pues|o sea|eh|bueno|呃|额|嗯|啊|那个|这个这个|就是说|"
    "えっと|えーと|あのー|あの|うーん|まあ|そのー|э|э-э|эм|ну|как бы|это самое|типа|в общем"
).split("|")
SAMPLE_CUES = 2000
_TIME = re.compile(r"^\s*(?:[\[(（]?\s*\d{1,2}:\d\d(?::\d\d)?(?:[.,]\d{1,3})?\s*[\])）]?)(?:\s*[-–—]\s+|\s+|(?=\W|[^\W\d]))")
_MARK = re.compile(r"^\s*(>>+|[-–—•*](?=\s))\s*")
_NAME = r"(?P<name>[^\s:：,，.。!！?？()（）\[\]【】<>«»\"“”—–-][^:：,，.。!！?？()（）\[\]【】<>\"“”\n]*?)"
_OPENINGS = [
    re.compile(r"^<v(?:\.\w+)?\s+(?P<name>[^<>]+)>\s*"),
    re.compile(r"^[\[【［](?P<name>[^\[\]【】［］]+)[\]】］]\s*[:：]?\s*"),
    re.compile(rf"^{_NAME}\s*[(（](?P<role>[^()（）]+)[)）]\s*[:：]\s*"),
    re.compile(rf"^{_NAME}\s*[:：]\s*"),
    re.compile(rf"^{_NAME}(?:\s+[—–]+\s+|——+\s*|\s+-\s+)"),
    re.compile(rf"^{_NAME}\s*[,，、]\s*"),
]
_SIGN = re.compile(r"^(?:[<\[【［]|[^.。!！?？\n]*?(?:[:：(（,，、—–]|\s-\s))")
FORMS = VOICE, BRACKET, ROLE, COLON, DASH, COMMA = range(6)
#: Bits of an opening beside its form: a time before it, a mark of one of two kinds, a role instead of a name, words behind
#: it, and a role in brackets that is the speaker's.
TIMED, ARROW, BULLET, BY_ROLE, TAIL, AGREES = (1 << i for i in range(6, 12))


@lru_cache(maxsize=1 << 14)
def _fold(name: str) -> str:
    return "".join(plain(name).casefold().split())


@lru_cache(maxsize=1)
def _roles() -> dict[str, str]:
    return {_fold(w): role for role, words in ROLES.items() for w in words.split()}


@lru_cache(maxsize=1 << 12)
def _cast(speakers: tuple[tuple[str, str], ...]) -> tuple[dict[str, str], dict[str, str], dict[str, str]]:
    """Of a page's roster: the speaker by folded name, by folded word for a role that only one has, and each one's role."""
    holders: dict[str, list[str]] = {}
    for s, r in speakers:
        holders.setdefault(r, []).append(s)
    return {_fold(s): s for s, _ in speakers}, {w: holders[r][0] for w, r in _roles().items() if len(holders.get(r, ())) == 1}, dict(speakers)


@lru_cache(maxsize=1 << 12)
def _first_signs(speakers: tuple[tuple[str, str], ...]) -> frozenset[str]:
    """What a label can begin with: the first letter of a name or role, or an opening bracket."""
    names, by_role, _ = _cast(speakers)
    return frozenset([*"<[【［", *(w[:1] for w in names), *(w[:1] for w in by_role)])


def opening(text: str, speakers: tuple[tuple[str, str], ...]) -> tuple[int, str | None, str]:
    """How a text in plain form opens, as bits, the speaker of the roster it may name, and what stands behind the opening.

    Without a name of the roster or a role that one speaker of it has, the bits of the form are 0 and nobody is named.
    """
    rest = text.strip()
    timed = _TIME.match(rest)
    if timed:
        rest = rest[timed.end() :].lstrip()
    mark = _MARK.match(rest)
    if mark:
        rest = rest[mark.end() :]
    bits = (TIMED if timed else 0) | ((ARROW if mark.group(1)[0] == ">" else BULLET) if mark else 0)
    if rest[:1].casefold()[:1] not in _first_signs(speakers) or not _SIGN.search(rest):
        return bits, None, text
    names, by_role, roles = _cast(speakers)
    for form, pattern in enumerate(_OPENINGS):
        m = pattern.match(rest)
        if not m:
            continue
        said = _fold(m.group("name"))
        who = names.get(said) or by_role.get(said)
        if not who:
            continue
        tail = rest[m.end() :]
        bits |= 1 << form | (0 if said in names else BY_ROLE) | (0 if says_nothing(tail) else TAIL)
        if "role" in m.groupdict() and _roles().get(_fold(m.group("role"))) == roles[who]:
            bits |= AGREES
        return bits, who, tail
    return bits, None, text


class Boosted:
    """Gradient-boosted regression trees of depth two on logistic loss, small enough to be fitted on the driver."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 40, rate: float = 0.3) -> None:
        self.trees: list[tuple] = []
        self.base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        z = np.full(len(y), self.base)
        cuts = [np.unique(x[:, j])[:-1][:32] if len(y) else [] for j in range(x.shape[1])]
        for _ in range(trees):
            p = 1 / (1 + np.exp(-z))
            tree = self._grow(x, y - p, p * (1 - p) + 1e-6, cuts, 2)
            self.trees.append(tree)
            z = z + rate * self._apply(tree, x)
        self.rate = rate

    def _grow(self, x, g, h, cuts, depth):
        leaf = float(g.sum() / (h.sum() + 1.0))
        if depth == 0 or len(g) < 8:
            return leaf
        best = (g.sum() ** 2 / (h.sum() + 1.0) + 1e-6, None)
        for j, values in enumerate(cuts):
            for c in values:
                m = x[:, j] <= c
                if 0 < m.sum() < len(m):
                    gain = g[m].sum() ** 2 / (h[m].sum() + 1.0) + g[~m].sum() ** 2 / (h[~m].sum() + 1.0)
                    if gain > best[0]:
                        best = (gain, (j, c, m))
        if best[1] is None:
            return leaf
        j, c, m = best[1]
        return j, c, self._grow(x[m], g[m], h[m], cuts, depth - 1), self._grow(x[~m], g[~m], h[~m], cuts, depth - 1)

    def _apply(self, tree, x):
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        j, c, low, high = tree
        return np.where(x[:, j] <= c, self._apply(low, x), self._apply(high, x))

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for tree in self.trees:
            z = z + self.rate * self._apply(tree, x)
        return 1 / (1 + np.exp(-z))

    def odds(self, columns: list[Column]) -> Column:
        """Log odds as an expression over columns, so that Spark works them out without Python."""

        def grown(tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(self.rate * tree)
            j, c, low, high = tree
            return F.when(columns[j] <= float(c), grown(low)).otherwise(grown(high))

        out = F.lit(self.base)
        for tree in self.trees:
            out = out + grown(tree)
        return out


GAP_MS = 10_000.0


def pair_features(bits: int, gap: float | None, ended: bool, same: bool) -> list[float]:
    """Features of a pair of adjacent segments: how the later one opens, the pause between them in ms, whether the earlier
    one ends a sentence, and whether the speaker named is the one named last before."""
    return [*(float(bits >> i & 1) for i in range(12)), -1.0 if gap is None else min(max(gap, 0.0), GAP_MS), float(ended), float(same)]


def boundary_samples(pairs: list[tuple[int, float | None, bool, bool]]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of training pairs, from pairs (bits, gap, ended, same) of the tables themselves.

    A name of the roster before a colon is a sure label, and so begins a turn; a name before a comma addresses somebody,
    and a segment that names nobody goes on. Labels in the other shapes are rarer: every sure pair stands in each of them
    as well, and some of the others as an address, all with the pause and the context they have.
    """
    xs, ys = [], []
    forms = (1 << 6) - 1
    for i, (bits, *context) in enumerate(pairs):
        form = bits & forms
        if form == 1 << COLON and not bits & BY_ROLE:
            for f in (COLON, VOICE, BRACKET, DASH, ROLE):
                for role in (0, BY_ROLE) if f in (COLON, BRACKET) else (0, AGREES) if f == ROLE else (0,):
                    xs.append(pair_features(bits & ~forms | 1 << f | role, *context))
                    ys.append(1.0)
        elif form in (0, 1 << COMMA):
            xs.append(pair_features(bits, *context))
            ys.append(0.0)
            if not form and i % 4 == 0:
                xs.append(pair_features(bits | 1 << COMMA | TAIL | (BY_ROLE if i % 8 == 0 else 0), *context))
                ys.append(0.0)
    return (np.array(xs) if xs else np.zeros((0, 15))), np.array(ys)


def filler_features(tokens: list[str], i: int, n: int) -> list[float]:
    """How the ``n`` tokens from ``i`` on stand in a text: whether they are fillers elsewhere words, and what follows."""
    last = tokens[i + n - 1]
    word = _bare(" ".join(tokens[i : i + n]))
    after = tokens[i + n] if i + n < len(tokens) else ""
    return [
        float(word in _ambiguous()), float(n > 1), float(last.endswith((",", "，", "、"))), float(last.endswith(("...", "…", "……"))), float(i == 0),
        float(i > 0 and tokens[i - 1].endswith((",", "，", "、"))), float(after[:1].isupper()), float(bool(re.search(r"(.)\1\1", word))),
    ]


@lru_cache(maxsize=1)
def _ambiguous() -> frozenset[str]:
    return frozenset(x for x in FILLERS if x in "like|well|so|also|halt|este|pues|bueno|ben|那个|啊|あの|まあ|ну|типа|en fait|er".split("|"))


def _bare(word: str) -> str:
    return plain(word).casefold().strip(" ,，、.…。!！?？~-—")


def _pieces(text: str) -> list[str]:
    """Tokens, those of texts without spaces cut at their punctuation, each with the signs behind it."""
    return re.findall(r"\s*(?:(?!\.\.)[^\s，、…,])+[，、…,.!?。！？]*|\s*[，、…,.]+", text)


class Fillers:
    """Logistic regression that tells fillers from the same words in earnest, token by token."""

    def __init__(self, lines: list[str], seed: int = 7) -> None:
        rng = random.Random(seed)
        xs, ys = [], []
        for line in lines:
            tokens = line.split()
            for i, t in enumerate(tokens):
                if _bare(t) in _ambiguous():
                    xs.append(filler_features(tokens, i, 1))
                    ys.append(0.0)
            if not tokens:
                continue
            at, word = rng.randrange(0, min(3, len(tokens))), rng.choice(FILLERS).split()
            word[-1] += rng.choice([",", "，", "...", ",", "……"]) if rng.random() < 0.9 else ""
            xs.append(filler_features(tokens[:at] + word + tokens[at:], at, len(word)))
            ys.append(1.0)
        x, y = (np.array(xs), np.array(ys)) if xs else (np.zeros((1, 8)), np.ones(1))
        self.w, self.b = np.zeros(8), 0.0
        for _ in range(300):
            p = 1 / (1 + np.exp(-(x @ self.w + self.b)))
            c = np.where(y == 1, 1.0, max(1.0, y.sum()) / max(1.0, (1 - y).sum()))
            self.w -= 0.5 * ((x * ((p - y) * c)[:, None]).mean(axis=0) + 1e-3 * self.w)
            self.b -= 0.5 * ((p - y) * c).mean()

    def strip(self, text: str) -> str:
        tokens = _pieces(text)
        out, i = [], 0
        shown = [t.strip() for t in tokens]
        while i < len(tokens):
            n = next((n for n in (2, 1) if i + n <= len(tokens) and _bare(" ".join(shown[i : i + n])) in _fillers()), 0)
            sure = n and (_bare(" ".join(shown[i : i + n])) not in _ambiguous())
            if n and (sure or np.dot(filler_features(shown, i, n), self.w) + self.b > 0):
                i += n
            else:
                out.append(tokens[i])
                i += 1
        return "".join(out).strip()


@lru_cache(maxsize=1)
def _fillers() -> frozenset[str]:
    return frozenset(FILLERS)


class Model:
    """Boundary decisions and filler classification."""

    def __init__(self, pairs: list[tuple[int, float | None, bool, bool]], lines: list[str]) -> None:
        x, y = boundary_samples(pairs)
        self.boundary = Boosted(x, y)
        lines = [x for x in lines if not wordless(x) and not re.search("[:：]", x[:40])] or ["well then, here we go"]
        self.fillers = Fillers(lines)


def fit(rows: DataFrame, lines: DataFrame | None = None, sample: int = SAMPLE_CUES) -> Model:
    """The models: boundary decisions on at most 6 * ``sample`` of the pairs that ``adjacent`` gives, and, for clean text,
    filler classification on at most 2 * ``sample`` lines of (cue_id, text)."""
    pairs = bounded_sample(rows.select("_r", "_bits", "_gap", "_ended", "_same"), "_r", 3 * sample).drop("_r").collect()
    texts = bounded_sample(lines.filter("text is not null"), "cue_id", sample).select("text").collect() if lines is not None else []
    return Model(sorted({tuple(r) for r in pairs}, key=str), sorted({r[0] for r in texts}))


_READ = T.StructType([T.StructField("words", T.BooleanType()), T.StructField("bits", T.IntegerType()), T.StructField("who", T.StringType()), T.StructField("tail", T.StringType())])
_READ_PA = pa.struct([("words", pa.bool_()), ("bits", pa.int32()), ("who", pa.string()), ("tail", pa.string())])


@F.arrow_udf(_READ)
def _opening(texts: pa.Array, rosters: pa.Array) -> pa.Array:
    coded, casts = texts.dictionary_encode(), rosters.dictionary_encode()
    said = plain_many(coded.dictionary.to_pylist())
    worded = [not says_nothing(t) for t in said]
    people = [tuple(tuple(x.split("\x1e", 1)) for x in r.split("\x1f") if x) for r in casts.dictionary.to_pylist()]
    words, bits, who, tails = [], [], [], []
    for i, j in zip(coded.indices.to_pylist(), casts.indices.to_pylist()):
        ok = i is not None and worded[i]
        b, name, tail = opening(said[i], people[j]) if ok and j is not None else (0, None, None)
        words.append(ok)
        bits.append(b)
        who.append(name)
        tails.append(tail if name else None)
    return pa.StructArray.from_arrays([pa.array(words), pa.array(bits, pa.int32()), pa.array(who, pa.string()), pa.array(tails, pa.string())], fields=list(_READ_PA))


def clean_udf(spark, model: Model):
    shared = spark.sparkContext.broadcast(model)

    def clean(text: str) -> str:
        timed = _TIME.match(text)
        said = SOUND.sub(" ", re.sub(r"^\s*(?:>>+|-(?=\s))\s*", "", text[timed.end() :] if timed else text))
        return re.sub(r"\s+", " ", shared.value.fillers.strip(said)).strip()

    @F.arrow_udf(T.StringType())
    def cleaned(texts: pa.Array) -> pa.Array:
        return many_distinct(texts, lambda ts: [clean(t) for t in plain_many(ts)])

    return cleaned


KEYS = ["_id", "_part", "_track"]


def adjacent(cues: DataFrame, speakers: DataFrame, *, with_text: bool = True, block: int = BLOCK) -> DataFrame:
    """Every worded segment of the pages with a roster, with what tells whether it begins a turn: how it opens (_bits, _who),
    the pause since the segment before (_gap, ms), whether that one ends a sentence (_ended), and whether the one named
    is who was named last before (_same). Written once, so that the openings are worked out once."""
    cast = speakers.filter("id is not null and part is not null and speaker is not null").groupBy(F.col("id").alias("_id"), F.col("part").alias("_part")).agg(
        F.array_join(F.sort_array(F.collect_set(F.concat("speaker", F.lit("\x1e"), F.coalesce("role", F.lit(""))))), "\x1f").alias("_roster")
    )
    rows = cues.select(
        F.col("id").alias("_id"), F.col("part").alias("_part"), F.col("track").alias("_track"), F.col("pos").alias("_o"),
        F.col("cue_id").alias("_r"), F.col("start").alias("_s"), F.col("end").alias("_e"), F.col("text").alias("_t"), block_of("pos", block).alias("_block"),
    ).join(cast, ["_id", "_part"])
    rows = once(rows, KEYS, "_o", "_r").withColumn("_x", _opening("_t", "_roster")).filter("_x.words")
    rows = rows.select(
        *KEYS, "_block", "_o", "_r", "_s", "_e", F.col("_t").rlike(r"[.!?。！？…]\s*$").alias("_end"), F.col("_x.bits").alias("_bits"),
        F.col("_x.who").alias("_who"), *(["_t", F.col("_x.tail").alias("_tail")] if with_text else []),
    )
    rows = cut_lineage(rows)
    w = in_block(KEYS, "_o", "_r")
    ends = carried_all(rows, KEYS, "_o", "_r", {"_in": (F.struct("_e", "_end"), False), "_named": (F.col("_who"), True)})
    rows = with_carried(rows, KEYS, ends).drop("_more", "_less")
    before = F.coalesce(F.lag(F.struct("_e", "_end")).over(w), F.col("_in"))
    named = F.coalesce(F.last("_who", True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("_named"))
    rows = rows.withColumn("_before", before).withColumn("_same", F.coalesce(F.col("_who") == named, F.lit(False)))
    gap = ((F.col("_s") - F.col("_before._e")) * 1000).cast("double")
    return cut_lineage(rows.withColumn("_gap", gap).withColumn("_ended", F.coalesce("_before._end", F.lit(False))).drop("_before", "_in", "_named", "_end"))


def speaker_turns(rows: DataFrame, *, model: Model) -> DataFrame:
    """(id, part, track, first_cue_id, last_cue_id, speaker, start, end, text) of every turn; the text only if ``rows``,
    which ``adjacent`` gives, have texts.

    Boosted trees decide for every pair of adjacent segments whether the later one begins with a label; they see its
    opening, the pause and the context, and tell labels from names that address somebody. A label's name or role is
    normalised to the roster's name. Turns carry on over segments that begin none. Sequences are worked on in blocks
    of positions and stitched, so no task holds a whole long track; only the text of a single turn is gathered.

    Defined results: cues before the first label, and pages without a roster, have no turns; NULL and blank cues and
    sound marks neither belong to a turn nor end one; a role that several speakers of a page have names nobody; rows
    repeated alike count once; empty tables give no rows; other columns are not read.
    """
    ks, with_text = KEYS, "_t" in rows.columns
    w = in_block(ks, "_o", "_r")
    bit = lambda i: F.getbit("_bits", F.lit(i)).cast("double")
    gap = F.coalesce(F.least(F.greatest("_gap", F.lit(0.0)), F.lit(GAP_MS)), F.lit(-1.0))
    begins = model.boundary.odds([*map(bit, range(12)), gap, F.col("_ended").cast("double"), F.col("_same").cast("double")]) >= 0
    rows = rows.withColumn("_l", F.when(begins, F.col("_who")))
    if with_text:
        clean = clean_udf(rows.sparkSession, model)
        rows = rows.withColumn("_t", clean(F.when(F.col("_l").isNotNull(), F.col("_tail")).otherwise(F.col("_t"))))
    rows = rows.select(*ks, "_block", "_o", "_r", "_s", "_e", "_l", *(["_t"] if with_text else []))
    ends = carried(rows, ks, "_o", "_r", F.col("_l"), skip_null=True)
    rows = with_carried(rows, ks, ends)
    rows = rows.withColumn("_who", F.coalesce(F.last("_l", True).over(w), F.col("_in"))).withColumn("_n", F.row_number().over(w))
    rows = rows.withColumn("_p", F.when(F.col("_n") == 1, F.col("_in")).otherwise(F.lag("_who").over(w)))
    rows = rows.withColumn("_chain", F.sum(F.when(F.col("_who") == F.col("_p"), 0).otherwise(1)).over(w)).filter("_who is not null")
    place = F.struct("_o", "_r")
    line = F.struct(place.alias("p"), F.col("_t").alias("t")) if with_text else None
    runs = rows.groupBy(*ks, "_block", "_chain").agg(
        F.min(place).alias("_first"), F.max(place).alias("_last"), F.min("_s").alias("_s"), F.max("_e").alias("_e"), F.min("_who").alias("_who"),
        F.min("_n").alias("_n"), F.bool_or((F.col("_n") == 1) & F.coalesce(F.col("_who") == F.col("_p"), F.lit(False))).alias("_on"),
        F.bool_or(F.coalesce("_more", F.lit(False))).alias("_more"), *([F.collect_list(line).alias("_ts")] if with_text else []),
    )
    last_run = F.lead("_n").over(in_block(ks, "_n")).isNull()
    runs = runs.withColumn("_tail", F.col("_more") & last_run)
    turns = stitch(runs, ks, [
        F.max("_last").alias("_last"), F.min("_s").alias("_s"), F.max("_e").alias("_e"), F.min("_who").alias("_who"), F.min("_first").alias("_first"),
        *([F.flatten(F.collect_list("_ts")).alias("_ts")] if with_text else []),
    ], [*ks, "_first", "_last", "_s", "_e", "_who", *(["_ts"] if with_text else [])])
    text = [F.array_join(F.filter(F.sort_array("_ts").t, lambda t: t != ""), " ").alias("text")] if with_text else []
    return turns.select(
        F.col("_id").alias("id"), F.col("_part").alias("part"), F.col("_track").alias("track"), F.col("_first._r").alias("first_cue_id"),
        F.col("_last._r").alias("last_cue_id"), F.col("_who").alias("speaker"), F.col("_s").alias("start"), F.col("_e").alias("end"), *text,
    )


def _rows(spark, sf_dir: str, with_text: bool) -> tuple[DataFrame, Model]:
    cues = load(spark, sf_dir, "cues", "id", "part", "track", "pos", "cue_id", "start", "end", "text")
    rows = adjacent(cues, load(spark, sf_dir, "speakers", "id", "part", "speaker", "role"), with_text=with_text)
    return rows, fit(rows, cues.select("cue_id", "text") if with_text else None)


def p7_turns(spark, sf_dir: str) -> DataFrame:
    """Every turn with its speaker, time and clean text."""
    rows, model = _rows(spark, sf_dir, True)
    return speaker_turns(rows, model=model)


def p7_found(spark, sf_dir: str) -> DataFrame:
    """First and last cue and the speaker of every turn."""
    rows, model = _rows(spark, sf_dir, False)
    return speaker_turns(rows, model=model).select("first_cue_id", "last_cue_id", "speaker")
