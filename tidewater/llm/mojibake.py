"""Problem 10: finding text that was decoded with a wrong character encoding, and restoring it."""

from __future__ import annotations

import codecs
import re
from collections import Counter
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.sampling import bounded_sample
from tidewater.tables import load

# Encoding chains as (encoding of the bytes, encoding they were read with), innermost first.
CHAINS = [
    *([("utf-8", wrong)] for wrong in (
        "latin-1", "cp1252", "cp1250", "cp1251", "cp1253", "koi8-r", "cp866", "cp437", "cp850", "mac-roman", "gbk", "big5",
        "cp932", "euc-jp", "cp949")),
    [("utf-8", "cp1252"), ("utf-8", "cp1252")],
    [("utf-8", "latin-1"), ("utf-8", "latin-1")],
    [("utf-8", "latin-1"), ("utf-8", "cp1252")],
    [("utf-8", "cp1251"), ("utf-8", "cp1251")],
    [("gbk", "latin-1")], [("gbk", "cp1252")], [("big5", "latin-1")], [("big5", "cp1252")], [("cp932", "latin-1")],
    [("cp932", "cp1252")], [("euc-jp", "latin-1")], [("euc-jp", "cp1252")], [("cp949", "latin-1")], [("gbk", "cp1251")],
    [("gbk", "big5")], [("big5", "gbk")], [("cp932", "gbk")], [("euc-jp", "gbk")], [("gbk", "cp932")], [("euc-jp", "cp932")],
    [("cp1251", "latin-1")], [("cp1251", "cp1252")], [("cp1251", "koi8-r")], [("koi8-r", "cp1251")], [("koi8-r", "latin-1")],
    [("koi8-r", "cp1252")], [("cp866", "cp1251")], [("cp1251", "cp866")], [("cp866", "latin-1")], [("cp1251", "gbk")],
    [("cp1252", "cp1251")], [("cp1252", "cp1250")], [("cp1252", "mac-roman")], [("mac-roman", "cp1252")], [("cp1252", "cp437")],
    [("cp850", "cp1252")], [("cp437", "cp1252")], [("cp1252", "koi8-r")],
    # Read as UTF-8, these lose what is no UTF-8; the last two were read again with a double-byte encoding.
    [("gbk", "utf-8")], [("big5", "utf-8")], [("cp932", "utf-8")], [("euc-jp", "utf-8")], [("cp1252", "utf-8")], [("cp1251", "utf-8")],
    [("gbk", "utf-8"), ("utf-8", "gbk")], [("cp932", "utf-8"), ("utf-8", "cp932")],
]
# Signs that are common in clean text of the Latin script, which a sample may happen to lack.
PROPER = "àâäçéèêëîïìôöòùûüúÿœæñáíóãõåøßłśżźćńęąčšžřůěşğıőűÀÉÈÇÑÖÜÁÍÓÚ¿¡“”‘’„–—…«»€°·×"
BUCKETS = 1 << 15
SAMPLE_DOCS = 3000
SAMPLE_LINES = 12000
#: Log odds against clean text from which a line counts as garbled before it is verified, and where it can't be inverted.
ODDS, ODDS_UTF8, ODDS_LOST = 4.0, -6.0, 12.0
_LOST = "�"
#: Lines weighed at once, and bigrams: the arrays take some hundred numbers for each.
LINES, SLICE = 1 << 13, 1 << 16


codecs.register_error("tidewater-ff", lambda e: (b"\xff" * (e.end - e.start), e.end))


@lru_cache(maxsize=None)
def _table(encoding: str) -> tuple[dict[int, int], str] | None:
    """For a single-byte encoding its bytes by code point and its characters, undefined bytes standing for themselves."""
    if encoding in ("utf-8", "gbk", "big5", "cp932", "euc-jp", "cp949"):
        return None
    chars = []
    for b in range(256):
        try:
            chars.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            chars.append(chr(b))
    return {ord(c): b for b, c in reversed(list(enumerate(chars)))}, "".join(chars)


def _to_bytes(text: str, encoding: str, errors: str = "strict") -> bytes:
    """``text`` as bytes; raises UnicodeEncodeError if strict."""
    table = _table(encoding)
    if table is None:
        return text.encode(encoding, errors)
    return codecs.charmap_encode(text, "tidewater-ff" if errors == "replace" else errors, table[0])[0]


def _to_text(data: bytes, encoding: str, errors: str = "strict") -> str:
    table = _table(encoding)
    return data.decode(encoding, errors) if table is None else codecs.charmap_decode(data, errors, table[1])[0]


def garble(text: str, chain: list[tuple[str, str]]) -> str | None:
    """``text`` after the wrong decodings of the chain; None if it can't be written in the first encoding."""
    try:
        for true, wrong in chain:
            text = _to_text(_to_bytes(text, true), wrong, "replace")
    except UnicodeError:
        return None
    return text


def invert(text: str, chain: list[tuple[str, str]], strict: bool = True) -> str | None:
    """The original of a garbled text; None if ``strict`` and the text can't be the outcome of the chain."""
    errors = "strict" if strict else "replace"
    try:
        for true, wrong in reversed(chain):
            text = _to_text(_to_bytes(text, wrong, errors), true, errors)
    except UnicodeError:
        return None
    return text


def _bigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte bigrams with a byte beyond ASCII, of all texts one after the other, and where each text's begin."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    flat = np.frombuffer(b"\n".join(data) + b"\n\n", np.uint8).astype(np.uint32)
    pairs = flat[:-1] * 256 + flat[1:]
    keep = (flat[:-1] > 127) | (flat[1:] > 127)
    starts = np.cumsum([0, *(len(d) + 1 for d in data)])[:-1]
    before = np.concatenate([[0], np.cumsum(keep)])
    return ((pairs[keep] * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64) % BUCKETS, before[starts]


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of the values from each start to the next; texts without values give 0."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return np.diff(total[np.append(starts, len(values))], axis=0)


GROUPS = [re.compile("[\u0400-\u04ff]"), re.compile("[\u3040-\u30ff]"), re.compile("[\u3400-\u9fff]"), re.compile("[\uac00-\ud7af]")]


def _group(line: str) -> int:
    """Script of a line: Cyrillic, kana, other ideographs, Hangul, or anything else, which is mostly Latin."""
    return next((i for i, g in enumerate(GROUPS) if len(g.findall(line)) * 4 > len(line)), len(GROUPS))


class Model:
    """Multinomial classifier of lines over hashed byte bigrams.

    Its classes are (chain, script of the original), chain 0 being clean text, so that no class is a blend of scripts.
    The training lines are cleaned by a first classifier of their own before the final one is fitted.
    """

    def __init__(self, clean: Iterable[str], rounds: int = 2) -> None:
        lines = [x for x in dict.fromkeys(clean) if not x.isascii() and _LOST not in x]
        for last in range(rounds - 1, -1, -1):
            self._train(lines)
            if last:
                # A common clean sign must not be unlearnt: what is left out needs more signs than what is reported.
                lines = [x for x, bad in zip(lines, self.inspect(lines)) if not bad or CHAINS[bad[0]][0][0] != "utf-8" and sum(c > "\x7f" for c in x) < 3]

    def _train(self, lines: list[str]) -> None:
        groups: list[list[str]] = [[] for _ in range(len(GROUPS) + 1)]
        for x in lines:
            groups[_group(x)].append(x)
        sets, self.chain = [], []
        for g in groups:
            # Other texts hold characters of a script as well; each script's lines are enough for its statistics.
            sets.append(g + [f"{c} a{c}e {c}n {c}" for c in PROPER] * (g is groups[-1]))
            self.chain.append(0)
            some = g[:: max(1, len(g) // 1500)]
            for k, chain in enumerate(CHAINS):
                made = [y for x in some if (y := garble(x, chain)) and y != x]
                if len(made) >= 20 and len(made) * 10 >= len(some):
                    sets.append(made)
                    self.chain.append(k + 1)
        counts = np.stack([np.bincount(_bigrams(s)[0], minlength=BUCKETS) if s else np.zeros(BUCKETS) for s in sets], axis=1)
        counts = counts.astype(np.float64) + 0.02
        self.logp = np.log(counts / counts.sum(axis=0)).astype(np.float32)
        self.chain = np.array(self.chain)
        order = np.argsort(self.chain, kind="stable")  # the classes of a chain side by side, clean ones first
        self.chain, self.logp = self.chain[order], np.ascontiguousarray(self.logp[:, order])
        self.first = np.flatnonzero(np.diff(self.chain, prepend=-1))
        self.kinds = self.chain[self.first][1:]
        self.plain = np.ascontiguousarray(self.logp[:, self.chain == 0])
        #: Odds from which a chain is tried: that text is valid UTF-8 in the wrong encoding is strong evidence by itself.
        self.tried = np.array([ODDS_UTF8 if CHAINS[k - 1][0][0] == "utf-8" else 0.0 for k in self.kinds])

    def inspect(self, lines: list[str]) -> list[tuple[int, str | None] | None]:
        """For each line None if it is clean, else its chain's number and the original text if that could be verified."""
        return [found for found, _ in self.weigh(lines)]

    def weigh(self, lines: list[str]) -> list[tuple[tuple[int, str | None] | None, dict[int, tuple[float, str]]]]:
        """``inspect`` of each line, and for a line too short to tell the weak evidence: (odds, original) by chain."""
        out: list[tuple[tuple[int, str | None] | None, dict[int, tuple[float, str]]]] = [(None, {})] * len(lines)
        if not lines:
            return out
        for lo in range(0, len(lines), LINES):
            part = lines[lo : lo + LINES]
            ids, starts = _bigrams(part)
            sizes = np.diff(np.append(starts, len(ids)))
            own, odds = self._odds(ids, np.repeat(np.arange(len(part)), sizes), len(part))
            for i in np.flatnonzero((odds >= self.tried).any(axis=1) | np.array([_LOST in x for x in part])).tolist():
                if not part[i].isspace():
                    weak: dict[int, tuple[float, str]] = {}
                    out[lo + i] = self._verify(part[i], float(own[i]), odds[i], int(sizes[i]), weak), weak
        return out

    def _odds(self, ids: np.ndarray, line: np.ndarray, lines: int) -> tuple[np.ndarray, np.ndarray]:
        """Log likelihood of each line as clean text, and the log odds of every chain against that."""
        score = np.zeros((lines, len(self.chain)))
        for lo in range(0, len(ids), SLICE):
            at = line[lo : lo + SLICE]
            firsts = np.flatnonzero(np.diff(at, prepend=-1))
            score[at[firsts]] += np.add.reduceat(self.logp[ids[lo : lo + SLICE]], firsts, axis=0)
        best = np.maximum.reduceat(score, self.first, axis=1)
        return best[:, 0], best[:, 1:] - best[:, :1]

    def _fit(self, text: str) -> float:
        """Log likelihood as clean text of the script it suits best; ASCII counts as perfectly clean."""
        ids, _ = _bigrams([text])
        return float(self.plain[ids].sum(axis=0).max()) if len(ids) else 0.0

    def _verify(self, line: str, own: float, odds: np.ndarray, size: int, weak: dict[int, tuple[float, str]]) -> tuple[int, str | None] | None:
        ranked = np.argsort(-odds, kind="stable").tolist()
        for j in ranked:
            x, k = float(odds[j]), int(self.kinds[j])
            chain = CHAINS[k - 1]
            sure = chain[0][0] == "utf-8"
            if x < self.tried[j] or _LOST in line:
                continue
            back = _invert_parts(line, chain)
            if back and back != line and _LOST not in back and not _controls(back):
                gain = self._fit(back) - own
                if gain > (0 if sure else ODDS) and (sure or x >= ODDS):
                    return k - 1, back
                # An original that reads no better is no evidence of its own, but goes with a chain proven by other lines.
                if not sure:
                    weak[k - 1] = max(0.0, min(x, gain)), back
        if _LOST in line:
            return int(self.kinds[ranked[0]]) - 1 if ranked else len(CHAINS) - 3, None
        for j in ranked:
            x, k = float(odds[j]), int(self.kinds[j])
            if x > ODDS_LOST and x > 0.4 * size and _losing(CHAINS[k - 1]) and _loosely(line, CHAINS[k - 1]):
                return k - 1, None
        return None


_SIGNED = re.compile(r"[A-Za-z]*[^\x00-\x7f]+[A-Za-z]*")


def pooled(lines: list[str], found: list[tuple[int, str | None] | None], weak: list[dict[int, tuple[float, str]]]) -> list[tuple[int, str | None] | None]:
    """What was found in a document's lines, and the lines whose weak evidence for one chain is enough together.

    A chain proven by a line of its own lends its weight to the others. Evidence counts once for the same words with a
    sign beyond ASCII: a dash in every heading is one piece of evidence, not many.
    """
    total = Counter({k: ODDS for k in {f[0] for f in found if f and f[1] is not None}})
    best: dict[tuple[int, frozenset[str]], float] = {}
    for line, w in zip(lines, weak):
        for k, (x, _) in w.items():
            words = k, frozenset(_SIGNED.findall(line))
            best[words] = max(x, best.get(words, 0.0))
    for (k, _), x in best.items():
        total[k] += x
    out = list(found)
    for i, w in enumerate(weak):
        if out[i] is None and (sure := [k for k in w if total[k] >= ODDS]):
            k = max(sure, key=lambda k: (total[k], -k))
            out[i] = k, w[k][1]
    return out


def _losing(chain: list[tuple[str, str]]) -> bool:
    """Whether a chain can lose bytes without a trace: it reads bytes as an encoding in which not all are defined."""
    return any(true == "utf-8" or _table(wrong) is None for true, wrong in chain)


def _controls(text: str) -> bool:
    return any("\x80" <= c < "\xa0" for c in text)


def _loosely(line: str, chain: list[tuple[str, str]]) -> bool:
    """Whether most of a line can be inverted, as when some bytes were lost or changed on the way."""
    back = invert(line, chain, strict=False)
    return back is not None and back.count(_LOST) * 3 < len(back)


def _invert_parts(line: str, chain: list[tuple[str, str]]) -> str | None:
    """Invert a whole line, or else every part of it that the chain can have made, leaving the rest as it is."""
    whole = invert(line, chain)
    if whole is not None:
        return whole
    parts = re.split(r"([\x00-\x7f]{2,}|[ ])", line)
    done = [p if p.isascii() else invert(p, chain) for p in parts]
    if all(d is None for d, p in zip(done, parts) if not p.isascii()):
        return None
    return "".join(p if d is None else d for d, p in zip(done, parts))


def fit(documents: DataFrame, text: str = "text", key: str = "doc_id", sample: int = SAMPLE_DOCS) -> Model:
    """The classifier, trained on synthetically garbled lines of a sample of at most 2 * ``sample`` documents."""
    rows = bounded_sample(documents.select(key, text).filter(F.col(text).isNotNull()), key, sample).select(text).collect()
    lines = [x for (t,) in rows for x in re.split(r"[\r\n]", t)]
    return Model(lines[:: max(1, len(lines) // SAMPLE_LINES)])


_RESULT = T.StructType([
    T.StructField("garbled_lines", T.IntegerType()), T.StructField("lost_lines", T.IntegerType()),
    T.StructField("chain", T.StringType()), T.StructField("restored", T.StringType()),
])


def chain_name(k: int) -> str:
    return ", then ".join(f"{true} read as {wrong}" for true, wrong in CHAINS[k])


def restore_text(text: str, found: list[tuple[int, str | None] | None], pieces: list[str]) -> str:
    it = iter(found)
    return "".join(p if i % 2 else (lambda f: p if f is None or f[1] is None else f[1])(next(it)) for i, p in enumerate(pieces))


def inspect_udf(spark, model: Model):
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf(_RESULT)
    def inspect(texts: pa.Array) -> pa.Array:
        coded = texts.dictionary_encode()
        cut = [re.split(r"([\r\n]+)", t) for t in coded.dictionary.to_pylist()]
        lines = list(dict.fromkeys(x for c in cut for x in c[::2] if not x.isascii()))
        seen = dict(zip(lines, shared.value.weigh(lines)))
        rows = []
        for c in cut:
            told = [seen.get(x, (None, {})) for x in c[::2]]
            found = pooled(c[::2], [f for f, _ in told], [w for _, w in told])
            bad = [f for f in found if f]
            chains = [f[0] for f in bad]
            rows.append({
                "garbled_lines": len(bad), "lost_lines": sum(f[1] is None for f in bad),
                "chain": chain_name(max(set(chains), key=lambda k: (chains.count(k), -k))) if bad else None,
                "restored": restore_text("", found, c) if bad else None,
            })
        done = pa.array(rows, pa.struct([("garbled_lines", pa.int32()), ("lost_lines", pa.int32()), ("chain", pa.string()), ("restored", pa.string())]))
        return done.take(coded.indices)

    return inspect


def find_garbled(df: DataFrame, *, key: str, text: str, model: Model) -> DataFrame:
    """(key, garbled_lines, lost_lines, chain, restored) of the documents with a line garbled by a wrong decoding.

    A multinomial classifier on hashed byte bigrams, trained on synthetically garbled lines, predicts the exact chain of
    encodings of every line; the likeliest chains are inverted, and a chain is accepted when the line decodes strictly
    through it and then reads more like clean text. Lines that lost bytes can't be inverted: they count as garbled when
    they hold replacement characters or when the odds are overwhelming, and stay as they are in ``restored``.

    Defined results: NULL, empty and ASCII texts are clean; every line of a text of any length is read; repeated rows
    of a key give one row; an empty table gives no rows; other columns, whatever their names, are not read.
    """
    inspect = inspect_udf(df.sparkSession, model)
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).filter("_text is not null")
    found = rows.select("_key", inspect("_text").alias("x")).filter("x.garbled_lines > 0").dropDuplicates(["_key"])
    return found.select(F.col("_key").alias(key), "x.garbled_lines", "x.lost_lines", "x.chain", "x.restored")


def p10_restored(spark, sf_dir: str) -> DataFrame:
    """Garbled documents with their chain and, where possible, their original text."""
    documents = load(spark, sf_dir, "documents", "doc_id", "text")
    return find_garbled(documents, key="doc_id", text="text", model=fit(documents))


def p10_found(spark, sf_dir: str) -> DataFrame:
    return p10_restored(spark, sf_dir).select("doc_id")
