"""Text functions as column expressions. Language settings are parameters with a Korean-law preset."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Blanks in the Unicode sense, the ideograph ranges, and box drawing.
BLANK = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
IDEOGRAPHS = "\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
BOX = "\u2500-\u257f"
ESCAPABLE = r"[\\`*_{}\[\]()#+\-.!|<>~]"
IMAGE = r"<img[^>]*>|</img>"
DATED_TAG = rf"{BLANK}*<[^<>]*\p{{Nd}}{{4}}{BLANK}*\.{BLANK}*\p{{Nd}}{{1,2}}{BLANK}*\.{BLANK}*\p{{Nd}}{{1,2}}[^<>]*>"
ARTICLE_NUMBER = rf"제{BLANK}*\p{{Nd}}+{BLANK}*조"


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Canonical composition; null stays null."""
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


def squeeze(c: Column) -> Column:
    """Blanks of any kind become one space each stretch; none at the ends."""
    return F.trim(F.regexp_replace(c, BLANK + "+", " "))


def clean(c: Column, strip_ideographs: bool = True, compose: bool = True) -> Column:
    """Plain text of Markdown law text: composed, without images, box drawing, escapes, bold marks and dated tags."""
    c = nfc(c) if compose else c
    c = F.regexp_replace(F.regexp_replace(c, IMAGE, " "), f"[{BOX}]+", " ")
    c = F.replace(F.regexp_replace(c, rf"\\({ESCAPABLE})", "$1"), F.lit("**"), F.lit(""))
    c = F.regexp_replace(c, DATED_TAG, "")
    if strip_ideographs:
        c = F.regexp_replace(c, rf"\([{IDEOGRAPHS}]+\)", "")
    return squeeze(c)


def has_formula_table(c: Column) -> Column:
    """Whether an image tag or box drawing stands in the text."""
    return c.rlike(f"{IMAGE}|[{BOX}]")


def norm(c: Column) -> Column:
    """Letters and numbers only, case kept."""
    return F.regexp_replace(c, r"[^\p{L}\p{N}]+", "")


def ngrams(c: Column, n: int = 3) -> Column:
    """Distinct n-grams of an already normalised text; a shorter text is its own only gram."""
    last = F.greatest(F.lit(1), F.char_length(c) - n + 1)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(c, i, F.lit(n))))


def script_ratio(c: Column, script: str = "가-힣") -> Column:
    """Share of the letters that are of the script; 0 without letters."""
    own = F.char_length(F.regexp_replace(c, f"[^{script}]", ""))
    letters = F.char_length(F.regexp_replace(c, r"[^\p{L}]", ""))
    return own / F.greatest(F.lit(1), letters)


def has_ideograph(c: Column) -> Column:
    return c.rlike(f"[{IDEOGRAPHS}]")


def has_article_number(c: Column) -> Column:
    return c.rlike(ARTICLE_NUMBER)


# Law names and their short forms that count as a mention; a blank may be missing.
LAW_NAMES = [
    "근로기준법", "최저임금법", "퇴직급여 보장법", "남녀고용평등", "기간제법", "파견법", "고용보험법", "산재보험법",
    "산업재해보상보험법", "임금채권보장법", "근로자참여", "보험료징수", "징수법", "시행령", "시행규칙",
]


def mentions(c: Column, names: list[str]) -> Column:
    """Whether one of the names stands in the text, with any blanks or none where a name has one."""
    return c.rlike("|".join(n.replace(" ", BLANK + "*") for n in names)) if names else F.lit(False)


def norm_law(c: Column) -> Column:
    """Law name as a join key: no blanks, composed, one kind of middle dot."""
    return F.translate(nfc(F.regexp_replace(c, BLANK, "")), "·", "ㆍ")


def sentences(c: Column) -> Column:
    """Split at blanks after a full stop, question or exclamation mark."""
    return F.split(c, rf"(?<=[.?!]){BLANK}+")


def numbered_parts(c: Column) -> Column:
    """'[1] a [2] b' -> array of (k, v), number and part; null unless the text begins with a number mark."""
    marks = F.regexp_extract_all(c, F.lit(r"\[(\p{Nd}+)\]"), F.lit(1))
    parts = F.slice(F.split(c, rf"\[\p{{Nd}}+\]{BLANK}*"), 2, 1_000_000)
    pairs = F.arrays_zip(marks.alias("k"), F.transform(parts, squeeze_ends).alias("v"))
    starts = c.rlike(rf"^{BLANK}*\[\p{{Nd}}+\]")
    return F.when(starts, pairs)


def squeeze_ends(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{BLANK}+|{BLANK}+$", "")


def article_label(no: Column, sub: Column, title: Column) -> Column:
    """제N조[의M][(title)], with the brackets of old double-bracketed titles taken off."""
    label = F.concat(F.lit("제"), no, F.lit("조"), F.when(F.length(sub) > 0, F.concat(F.lit("의"), sub)).otherwise(""))
    bare = F.when(title.rlike(r"^\(.*\)$"), F.substring(title, F.lit(2), F.length(title) - 2)).otherwise(title)
    return F.when(F.length(bare) > 0, F.concat(label, F.lit("("), bare, F.lit(")"))).otherwise(label)


def short_date(day: Column) -> Column:
    """2018-07-09 -> 2018. 7. 9."""
    d = F.try_to_date(day)
    return F.format_string("%d. %d. %d.", F.year(d), F.month(d), F.day(d))


def snippet(c: Column, n: int) -> Column:
    """The first n characters after the first line."""
    return F.substring(F.regexp_replace(c, r"^[^\n]*\n", ""), 1, n)


def escape_html(c: Column) -> Column:
    out = c
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def content_key(*cols: Column, length: int = 16) -> Column:
    """First digits of a SHA-1 over the columns; names cached results by their content."""
    return F.substring(F.sha1(F.concat(*[F.coalesce(c, F.lit("")) for c in cols])), 1, length)


def words(c: Column) -> Column:
    """Lower-case runs of letters and numbers; the analyser for retrieval where no other is given."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def count_tokens(c: Column) -> Column:
    """Default token counter: words and single other signs."""
    return F.size(F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"), F.lit(0)))


def seeded(seed: int, *cols: Column) -> Column:
    """A reproducible number for each key, for samples and shuffles: the first 8 hex digits of an MD5."""
    text = F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
