"""Character-level helpers shared by the text operators. All are plain Python, called from Arrow-batched functions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa

# Letters of equal shape, each line a Latin letter (or ideograph) and the characters drawn like it.
LOOKALIKES = """
a аɑα
b Ьƅ
c сϲ
d ԁ
e еҽ
g ɡ
h һ
i іιı
j јϳ
k κ
l ӏ
n ո
o оοօ
p рρ
q ԛ
s ѕ
u υս
v νѵ
w ԝ
x хχ
y уγү
A АΑ
B ВΒ
C СϹ
E ЕΕ
F Ϝ
G Ԍ
H НΗ
I ІΙӀ
J ЈͿ
K КΚ
M МΜϺ
N Ν
O ОΟՕ
P РΡ
Q Ԛ
S Ѕ
T ТΤ
W Ԝ
X ХΧ
Y УΥҮ
Z Ζ
ß β
夕 タ
口 ロ
工 エ
二 ニ
力 カ
卜 ト
八 ハ
三 ミ
一 ー㇐
车 ⻋
贝 ⻉
见 ⻅
长 ⻓
门 ⻔
页 ⻚
风 ⻛
飞 ⻜
食 ⻝
马 ⻢
鱼 ⻥
鸟 ⻦
麦 ⻨
黄 ⻩
龙 ⻰
西 ⻄
青 ⻘
户 ⼾戶
"""

# Code points that are drawn as nothing (default-ignorable), as inclusive ranges.
IGNORABLE = [
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F),
    (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF),
    (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
]

_SHAPES = str.maketrans({c: line[0] for line in LOOKALIKES.split("\n") if line for c in line[2:]})
_INVISIBLE = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in IGNORABLE) + "]")
_SPACE = re.compile(r"[\s ⠀]")
_CYRILLIC = re.compile("[Ѐ-ԯ]")
#: Letters that only Cyrillic has: with one of them a text's Cyrillic words are real ones.
_OWN_CYRILLIC = re.compile("[" + "".join(chr(c) for c in range(0x400, 0x530) if c not in _SHAPES) + "]")
_NO_LATIN = re.compile(r"(?<![A-Za-z])[Ѐ-ԯ]+(?![A-Za-z])")


def canonical(text: str, fold: bool = True) -> str:
    """One consistent form of ``text``: every text that reads the same has the same form.

    Compatibility composition, mapped white space, no default-ignorable characters and one character of each group of
    equal shape. With ``fold``, full case folding comes on top.
    """
    if text.isascii():
        out = _SPACE.sub(" ", text)
        return out.casefold() if fold else out
    out = _INVISIBLE.sub("", unicodedata.normalize("NFKC", _INVISIBLE.sub("", text)))
    out = _SPACE.sub(" ", out)
    if fold and _OWN_CYRILLIC.search(out):
        # Capitals look like Latin letters more often than small ones do: real Cyrillic is folded before shapes are mapped.
        out = _NO_LATIN.sub(lambda m: m.group().casefold(), out)
    # Shapes are compared without their marks, so that an accented look-alike falls on the accented letter.
    out = unicodedata.normalize("NFC", unicodedata.normalize("NFD", out).translate(_SHAPES))
    if fold:
        out = unicodedata.normalize("NFKC", out.casefold())
    return out


def plain(text: str) -> str:
    """Compatibility composition without invisible characters, white space mapped; letters keep their script."""
    return text if text.isascii() else _plain(text)


def _plain(text: str) -> str:
    return _SPACE.sub(" ", _INVISIBLE.sub("", unicodedata.normalize("NFKC", _INVISIBLE.sub("", text))))


class CharMap:
    """Applies a normaliser to many texts at once, character by character through a table filled as characters turn up.

    A text goes to the normaliser itself if it holds a character whose outcome depends on its neighbours or has several
    characters: marks, Hangul letters, half-width voice marks, ligatures and, with ``cyrillic``, Cyrillic letters.
    """

    DROP, HARD = 0xFFFFFFFF, 0xFFFFFFFE
    #: Characters worked on at once; the arrays take some twenty bytes for each.
    SLICE = 1 << 20

    def __init__(self, fn: Callable[[str], str], cyrillic: bool) -> None:
        self.fn, self.cyrillic = fn, cyrillic
        self.value, self.known = np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, bool)

    def _look_up(self, c: int) -> int:
        if 0xD800 <= c < 0xE000 or 0x1100 <= c < 0x1200 or 0xFF9E <= c <= 0xFF9F or self.cyrillic and 0x400 <= c < 0x530:
            return self.HARD
        out = self.fn(chr(c))
        if not out:
            return self.DROP
        one = len(out) == 1 and unicodedata.category(chr(c))[0] != "M" and unicodedata.category(out)[0] != "M"
        return ord(out) if one else self.HARD

    def __call__(self, texts: list[str]) -> list[str]:
        done: list[str] = []
        lo = size = 0
        for hi, t in enumerate(texts, 1):
            size += len(t)
            if size >= self.SLICE or hi == len(texts):
                done += self._some(texts[lo:hi])
                lo, size = hi, 0
        return done

    def _some(self, texts: list[str]) -> list[str]:
        raw = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        new = np.flatnonzero((np.bincount(raw, minlength=0x110000) > 0) & ~self.known)
        for c in new.tolist():
            self.value[c] = self._look_up(c)
        self.known[new] = True
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        out = self.value[raw]
        keep = out < self.HARD
        hard = np.flatnonzero(out == self.HARD)
        alone = set(np.searchsorted(ends, hard, "right").tolist())
        whole = out[keep].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        cuts = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], ends])].tolist()
        return [self.fn(t) if i in alone else whole[a:b] for i, (t, a, b) in enumerate(zip(texts, cuts, cuts[1:]))]


canonical_many = CharMap(canonical, True)
read_many = CharMap(lambda t: canonical(t, fold=False), False)
_plain_many = CharMap(_plain, False)


def plain_many(texts: list[str]) -> list[str]:
    others = iter(_plain_many([t for t in texts if not t.isascii()]))
    return [t if t.isascii() else next(others) for t in texts]


def unmix(text: str) -> str:
    """Turn look-alike letters back to the script of their word: Latin in a word with Latin letters, else untouched."""
    if text.isascii():
        return text

    def word(m: re.Match[str]) -> str:
        w = m.group()
        if not _CYRILLIC.search(w) and w.translate(_SHAPES) == w:
            return w
        mapped = w.translate(_SHAPES)
        latin = sum("a" <= c.lower() <= "z" for c in mapped)
        return mapped if latin == sum(c.isalpha() for c in mapped) else w

    return re.sub(r"[^\W\d_　-鿿가-힯]+", word, text)


_MARK = r"\[[^\[\]]*\]|\([^()]*\)|（[^（）]*）|【[^【】]*】|［[^［］]*］|\*[^*]+\*|<i>.*?</i>|[♪♫♬♩][\s♪♫♬♩～〜~]*"
SOUND_ALONE = re.compile(rf"\s*(?:(?:{_MARK})\s*)+")
SOUND = re.compile(_MARK)


def wordless(text: str | None) -> bool:
    """NULL, blank, or nothing but sound marks and punctuation."""
    return text is None or says_nothing(plain(text))


def says_nothing(text: str) -> bool:
    """``wordless`` of a text in its plain or canonical form."""
    text = text.lstrip()
    if text[:1].isalnum():
        return False
    return bool(SOUND_ALONE.fullmatch(text)) or not any(c.isalnum() for c in text)


def per_distinct(texts: pa.Array, fn: Callable[[str], object], kind: pa.DataType) -> pa.Array:
    """``fn`` of every text, called once for each distinct value of the batch; NULL stays NULL."""
    coded = texts.dictionary_encode()
    done = pa.array([fn(x) for x in coded.dictionary.to_pylist()], kind)
    return done.take(coded.indices)


def many_distinct(texts: pa.Array, fn: Callable[[list[str]], list[str | None]]) -> pa.Array:
    """``fn`` of all distinct texts of the batch at once; NULL stays NULL."""
    coded = texts.dictionary_encode()
    return pa.array(fn(coded.dictionary.to_pylist()), pa.string()).take(coded.indices)


def osa(a: str, b: str, most: int, substitution: Callable[[str, str], int] = lambda x, y: 1) -> int:
    """Edit distance with neighbour swaps as one edit, or ``most`` + 1 when it is larger."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    lo = 0
    top = min(len(a), len(b))
    while lo < top and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < top - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    # A swap may straddle the common ends by one character; keep it inside the compared part.
    lo, hi = max(0, lo - 1), max(0, hi - 1)
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    inf = most + 1
    width = len(b) + 1
    before: list[int] = []
    row = [j if j <= most else inf for j in range(width)]
    for i in range(1, len(a) + 1):
        new = [inf] * width
        if i <= most:
            new[0] = i
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            x, y = a[i - 1], b[j - 1]
            d = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (0 if x == y else substitution(x, y)))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                d = min(d, before[j - 2] + 1)
            new[j] = min(d, inf)
        if min(new) > most:
            return inf
        before, row = row, new
    return row[len(b)]
