"""Splitting of oversized texts at natural boundaries by lexical cohesion.

Sentences and lines are the units. At each boundary the words of the units before and
after it are compared (cosine of the counts in blocks of `block` units); a boundary
lies in a valley of this curve as deep as the curve rises on both sides. Each piece
ends at the deepest valley of its window, the last of several; boundaries within twice
the overlap of its beginning are left out, so that more than half of a piece is new.
Without another boundary it ends at the last one of the window, else at the last word
end, else at the limit. The next piece begins at a word within the last `overlap`
characters of the piece.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.runtime import ship

BOUNDARY = re.compile(r"[.?!。？！…]+[\"'”’」』)\]]*(?=\s|$)|[^\s](?=[ \t\r]*\n)")
WORD = re.compile(r"\w+")
SPACE = re.compile(r"\s")
STRETCH = 256


def cohesion(text: str, ends: list[int], block: int = 3) -> np.ndarray:
    """Cosine of the word counts of the `block` units before and after each boundary; `ends` are the ends of the units.

    Worked through in stretches with the neighbours they need, so that memory stays bounded;
    the curve is the same as if it were made at once.
    """
    n = len(ends)
    curve = np.zeros(n)
    for lo in range(0, n, STRETCH):
        a, b = max(0, lo - block), min(n, lo + STRETCH + block)
        begin = ends[a - 1] if a else 0
        voc: dict[str, int] = {}
        rows, cols = [], []
        at = a
        for m in WORD.finditer(text, begin, ends[b - 1]):
            while m.start() >= ends[at]:
                at += 1
            rows.append(at - a)
            cols.append(voc.setdefault(m.group(), len(voc)))
        if not voc:
            continue
        counts = np.zeros((b - a + 1, len(voc)), np.float64)
        np.add.at(counts, (np.array(rows) + 1, np.array(cols)), 1)
        total = counts.cumsum(axis=0)
        i = np.arange(1, b - a + 1)
        left = total[i] - total[np.maximum(i - block, 0)]
        right = total[np.minimum(i + block, b - a)] - total[i]
        norm = np.sqrt((left * left).sum(1) * (right * right).sum(1))
        sim = np.where(norm > 0, (left * right).sum(1) / np.maximum(norm, 1e-9), 0.0)
        mine = slice(lo - a, min(n, lo + STRETCH) - a)
        curve[lo : lo + STRETCH] = sim[mine]
    return curve


def cohesion_depths(text: str, ends: list[int], block: int = 3) -> np.ndarray:
    """Depth of the cohesion valley at each boundary: how far the curve climbs from it without a fall, to both sides."""
    sim = cohesion(text, ends, block)
    left, right = sim.copy(), sim.copy()
    for k in range(1, len(sim)):
        if sim[k - 1] >= sim[k]:
            left[k] = left[k - 1]
    for k in range(len(sim) - 2, -1, -1):
        if sim[k + 1] >= sim[k]:
            right[k] = right[k + 1]
    return left + right - 2 * sim


def cut(text: str | None, limit: int = 1000, overlap: int = 120, block: int = 3) -> list[tuple[int, int]]:
    """Spans of the pieces in order. A text within the limit, empty or null, is one piece or none.

    Every span is at most `limit` long, begins before the end of the one before it, by at
    most `overlap`, and together they cover the whole text.
    """
    if not text:
        return []
    size = len(text)
    if size <= limit:
        return [(0, size)]
    overlap = max(1, min(overlap, limit // 2))
    ends = sorted({m.end() for m in BOUNDARY.finditer(text)} | {size})
    depth = cohesion_depths(text, ends, block)
    at = np.array(ends)
    spans, start, done = [], 0, 0
    while size - start > limit:
        hi = int(np.searchsorted(at, start + limit, side="right"))
        lo = int(np.searchsorted(at, max(start + 2 * overlap, done + 1)))
        if lo < hi:
            k = lo + int(np.argmax(np.round(depth[lo:hi], 6)[::-1] == np.round(depth[lo:hi], 6).max()))
            k = hi - 1 - (k - lo)
            end = ends[k]
        else:
            lo = int(np.searchsorted(at, done + 1))
            if lo < hi:
                end = ends[hi - 1]
            else:
                end = start + limit
                x = end
                while x > done and not (text[x].isspace() and not text[x - 1].isspace()):
                    x -= 1
                if x > done:
                    end = x
                else:
                    while end > done + 1 and (unicodedata.combining(text[end]) or text[end] == "‍"):
                        end -= 1
        spans.append((start, end))
        done = end
        begin = max(start + 1, end - overlap)
        if not text[begin - 1].isspace():
            m = SPACE.search(text, begin, end)
            if m:
                x = m.end()
                while x < end and text[x].isspace():
                    x += 1
                if x < end:
                    begin = x
        else:
            x = begin
            while x < end and text[x].isspace():
                x += 1
            begin = x if x < end else begin
        start = begin
    spans.append((start, size))
    return spans


def oversized(df: DataFrame, field: str, key: str, value: str, limit: int = 1000, overlap: int = 120, texts: bool = True) -> DataFrame:
    """Pieces of every value longer than `limit`: field, row_key, piece (from 1), n_pieces, start, end, text.

    Values within the limit, empty and null ones give no row; repeated rows give their
    pieces again. With texts=False the piece's text is left out. Narrow.
    """
    ship(df.sparkSession)

    def run(batches):
        for b in batches:
            keys, out = [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                spans = cut(t, limit, overlap)
                for i, (s, e) in enumerate(spans, 1):
                    keys.append(k)
                    out.append((i, len(spans), s, e, t[s:e] if texts else None))
            p, n, s, e, x = zip(*out) if out else ([],) * 5
            cols = [pa.array([field] * len(keys), pa.string()), pa.array(keys, pa.string())]
            cols += [pa.array(list(v), pa.int32()) for v in (p, n, s, e)]
            names = ["field", "row_key", "piece", "n_pieces", "start", "end"]
            if texts:
                cols.append(pa.array(list(x), pa.string()))
                names.append("text")
            yield pa.RecordBatch.from_arrays(cols, names)

    rows = df.where(F.char_length(value) > limit).select(F.col(key).cast("string").alias("row_key"), F.col(value).alias("text"))
    return rows.mapInArrow(run, "field string, row_key string, piece int, n_pieces int, start int, end int" + ", text string" * texts)
