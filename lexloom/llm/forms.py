"""Consistent and bare forms of text (visually identical text with different characters).

A compiled longest-match transducer walks over grapheme clusters and words: each
token is looked up in a memo of already transduced tokens, so that one pass over the
text settles widths, accents, blanks, invisible characters and look-alike letters.
Texts without any affected character are recognised by a table lookup per character
and pass unchanged.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import regex

# Letters of other scripts that look exactly like a Latin letter.
LOOK_ALIKES = dict(
    zip(
        "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲϹϳ" + "АВЕЅІЈКМНОРСТХҮаеорсухѕіјһԁԛԝԚԜӏ",
        "ABEZHIKMNOPTYXocCj" + "ABESIJKMHOPCTXYaeopcyxsijhdqwQWl",
    )
)
# Hyphens of the same look as "-".
HYPHENS = "\u2010\u2011\ufe63\uff0d"
# Dots of the same look as the middle dot of law names.
MIDDLE_DOTS = "\u00b7\u0387\u2022\u2027\u2219\u22c5\u30fb\uff65\u119e"
LAW_DOT = "\u318d"
# Format characters that are visible, and line ends.
VISIBLE_FORMAT = set("\u0600\u0601\u0602\u0603\u0604\u0605\u06dd\u070f\u0890\u0891\u08e2\U000110bd\U000110cd")
LINE_ENDS = set("\n\r\x85\u2028\u2029")
# Characters without a category of blank that show as one.
BLANK_LIKE = set("\t\v\f\u2800\u3164\uffa0")
INVISIBLE_MARKS = set("\u034f\u115f\u1160\u17b4\u17b5")


def _is_invisible(c: str, cat: str) -> bool:
    cp = ord(c)
    if c in INVISIBLE_MARKS or 0x180B <= cp <= 0x180F or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF:
        return True
    return cat in ("Cf", "Cc") and c not in VISIBLE_FORMAT and c not in LINE_ENDS and c not in BLANK_LIKE


def _is_blank(c: str, cat: str) -> bool:
    return c != " " and (cat == "Zs" or c in BLANK_LIKE)


KEEP, ACTIVE, DOT = 1, 2, 4


@lru_cache(maxsize=1)
def tables() -> tuple[dict[str, str], np.ndarray]:
    """Mapping of single characters, and flags of all code points; built by rule and checked for conflicts."""
    mapping: dict[str, str] = {}

    def put(key: str, value: str) -> None:
        if mapping.setdefault(key, value) != value:
            raise ValueError(f"two outputs for U+{ord(key):04X}")

    flags = np.zeros(0x110000, np.uint8)
    flags[0xAC00:0xD7A4] = KEEP
    flags[0x3400:0x4DC0] = KEEP
    flags[0x4E00:0xA000] = KEEP
    flags[0x20000:0x323B0] = KEEP
    spans = [(0, 0x3400), (0x4DC0, 0x4E00), (0xA000, 0xAC00), (0xD7A4, 0xD800), (0xF900, 0x20000), (0xE0000, 0xE0200)]
    for lo, hi in spans:
        for cp in range(lo, hi):
            c = chr(cp)
            cat = unicodedata.category(c)
            if cat[0] in "LN":
                flags[cp] |= KEEP
            if _is_invisible(c, cat):
                put(c, "")
            elif _is_blank(c, cat):
                put(c, " ")
            elif c in HYPHENS:
                put(c, "-")
            elif 0xFF01 <= cp <= 0xFF5E:
                put(c, chr(cp - 0xFEE0))
            elif 0x2E80 <= cp <= 0x2FDF and unicodedata.decomposition(c):
                put(c, unicodedata.normalize("NFKC", c))
            elif cat[0] == "M" or 0x1100 <= cp < 0x1200 or 0xA960 <= cp < 0xA980 or 0xD7B0 <= cp < 0xD800:
                flags[cp] |= ACTIVE
            elif cat != "Cn" and unicodedata.normalize("NFC", c) != c:
                flags[cp] |= ACTIVE
            if c in LOOK_ALIKES:
                flags[cp] |= ACTIVE
    flags[0x2F800:0x2FA20] |= ACTIVE | KEEP  # compatibility ideographs of the supplement
    for c in mapping:
        flags[ord(c)] |= ACTIVE
    for c in MIDDLE_DOTS:
        flags[ord(c)] |= DOT
    for value in set(mapping.values()):
        for c in value:
            if c in mapping:
                raise ValueError(f"U+{ord(c):04X} is both an output and an input")
    return mapping, flags


@lru_cache(maxsize=1)
def clusters() -> dict[str, str]:
    """Clusters of several characters that become a single one, compiled by rule and checked.

    Every composed character is there in all its partly composed forms, and with its marks in
    either order where that is the same text; Hangul syllables from two or three parts.
    """
    compose = lambda x: unicodedata.normalize("NFC", x)
    split = {c: d for c in map(chr, [*range(0xC0, 0xAC00), *range(0xF900, 0x20000), *range(0x2F800, 0x2FA20)]) if len(d := unicodedata.normalize("NFD", c)) > 1}
    composed = {c: d for c, d in split.items() if compose(c) == c}
    marks = sorted({m for d in composed.values() for m in d[1:]})
    out: dict[str, str] = {}

    def put(key: str, value: str) -> None:
        if out.setdefault(key, value) != value:
            raise ValueError(f"two outputs for {key!r}")

    for c, d in composed.items():
        put(d, c)
        for m in marks:
            for key in (c + m, d + m, d[0] + m + d[1:]):
                if len(value := compose(key)) == 1:
                    put(key, value)
    for base in {d[0] for d in composed.values()}:
        for m in marks:
            if len(value := compose(base + m)) == 1:
                put(base + m, value)
    for lead in range(19):
        for vowel in range(21):
            syllable = 0xAC00 + (lead * 21 + vowel) * 28
            put(chr(0x1100 + lead) + chr(0x1161 + vowel), chr(syllable))
            for tail in range(1, 28):
                put(chr(0x1100 + lead) + chr(0x1161 + vowel) + chr(0x11A7 + tail), chr(syllable + tail))
                put(chr(syllable) + chr(0x11A7 + tail), chr(syllable + tail))
    mapping, _ = tables()
    for key, value in out.items():
        if value in mapping or any(c in mapping for c in key) or unicodedata.normalize("NFD", key) != unicodedata.normalize("NFD", value):
            raise ValueError(f"{key!r} doesn't agree with the single characters")
    return out


class Transducer:
    """Longest-match transducer; `dots` also maps middle dots to the one of law names."""

    CLUSTER = regex.compile(r"\X")
    WORD = regex.compile(r"(?:[\p{L}--[\p{Hangul}\p{Han}\p{Hiragana}\p{Katakana}\p{Bopomofo}]]\p{M}*)+", regex.V1)

    def __init__(self, dots: bool = False, memo_size: int = 200_000):
        mapping, self.flags = tables()
        self.mask = ACTIVE | (DOT if dots else 0)
        self.single = str.maketrans(mapping | (dict.fromkeys(MIDDLE_DOTS, LAW_DOT) if dots else {}))
        self.clusters = clusters()
        self.memo: dict[str, str] = {}
        self.memo_size = memo_size

    def _cluster(self, m) -> str:
        c = m.group()
        known = self.clusters.get(c)
        return known if known is not None else unicodedata.normalize("NFC", c)

    @staticmethod
    def _word(m) -> str:
        s = m.group()
        if any(c in LOOK_ALIKES for c in s) and all(c in LOOK_ALIKES or "LATIN" in unicodedata.name(c, "") for c in s if c.isalpha()):
            s = unicodedata.normalize("NFC", "".join(LOOK_ALIKES.get(c, c) for c in s))
        return s

    def _transduce(self, s: str) -> str:
        s = self.CLUSTER.sub(self._cluster, s.translate(self.single))
        return self.WORD.sub(self._word, s)

    def _walk(self, text: str) -> str:
        """Stretches between ordinary blanks are transduced once and remembered; no cluster or word holds such a blank."""
        out, memo = [], self.memo
        for t in text.split(" "):
            o = memo.get(t)
            if o is None:
                o = t if t.isascii() and t.isprintable() else self._transduce(t)
                if len(memo) >= self.memo_size:
                    memo.clear()
                if len(t) < 64:
                    memo[t] = o
            out.append(o)
        return " ".join(out)

    def __call__(self, text: str | None) -> str | None:
        """The consistent form; null stays null, empty stays empty."""
        if not text or text.isascii() and text.isprintable():
            return text
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        if not (self.flags[codes] & self.mask).any():
            return text
        return self._walk(text)

    def many(self, texts: list) -> list:
        """Consistent forms of a batch; only texts with affected characters are walked."""
        filled = [t or "" for t in texts]
        codes = np.frombuffer("".join(filled).encode("utf-32-le", "surrogatepass"), np.uint32)
        hot = np.flatnonzero(self.flags[codes] & self.mask)
        if not len(hot):
            return texts
        ends = np.cumsum([len(t) for t in filled])
        out = list(texts)
        for i in np.unique(np.searchsorted(ends, hot, side="right")):
            out[i] = self._walk(filled[i])
        return out


@lru_cache(maxsize=2)
def transducer(dots: bool = False) -> Transducer:
    return Transducer(dots)


def consistent(text: str | None, dots: bool = False) -> str | None:
    return transducer(dots)(text)


def stretches(texts: list, chars: int = 1 << 20, rows: int = 1 << 30):
    """Ranges (from, to) of a batch with a bounded number of characters and rows; a longer text has its own."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > start and (size + n > chars or i - start >= rows):
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def bare_codes(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the bare forms of a batch, end to end, and the offsets (one more than texts)."""
    t = transducer()
    fixed = [x or "" for x in t.many(texts)]
    codes = np.frombuffer("".join(fixed).encode("utf-32-le", "surrogatepass"), np.uint32)
    keep = (t.flags[codes] & KEEP) > 0
    ends = np.concatenate([[0], np.cumsum([len(x) for x in fixed], dtype=np.int64)])
    kept = np.concatenate([[0], np.cumsum(keep, dtype=np.int64)])
    return codes[keep], kept[ends]


def bare(text: str | None) -> str:
    """The bare form: only letters and numbers of the consistent form, case kept. Null gives ''."""
    return bare_codes([text])[0].tobytes().decode("utf-32-le", "surrogatepass")
