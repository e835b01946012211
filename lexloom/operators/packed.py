"""Several values packed in one field: a quote-aware tokenizer that gives one value per row with its position."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from lexloom.runtime import ship

OPEN = {"(": ")", "（": "）", "「": "」", "『": "』", "[": "]"}
CLOSE = set(OPEN.values())
WRAPS = {"[": "]", "{": "}", "(": ")"}


@dataclass(frozen=True)
class PackedFormat:
    """delimiters: characters that end a value outside quotes and brackets.
    marker: a bracketed mark that ends a value and belongs to none.
    value: what a stretch must hold to count as a value (else it is a placeholder)."""

    delimiters: str = ",;/|、，；\n\r\t"
    marker: str = r"\[\s*\d+\s*\]"
    value: str = r"\S"
    quotes: str = "\"'"
    _c: dict = field(default_factory=dict, compare=False, repr=False)

    def compiled(self):
        if not self._c:
            special = re.escape(self.delimiters + self.quotes + "".join(OPEN) + "".join(CLOSE) + "\\")
            self._c["token"] = re.compile(rf"{self.marker}|\\.|[{special}]", re.DOTALL)
            self._c["marker"] = re.compile(self.marker)
            self._c["value"] = re.compile(self.value)
        return self._c["token"], self._c["marker"], self._c["value"]


def _unwrapped(s: str) -> str:
    """Without the brackets that enclose the whole list. The partners of all brackets are found in one pass, each kind by itself."""
    s = s.strip()
    if len(s) < 2 or WRAPS.get(s[0]) != s[-1]:
        return s
    kind = {c: k for k, v in WRAPS.items() for c in (k, v)}
    opened: dict[str, list[int]] = {k: [] for k in WRAPS}
    partner: dict[int, int] = {}
    quoted = False
    for i, c in enumerate(s):
        if c == '"' and not (quoted and s[i - 1] == "\\"):
            quoted = not quoted
        elif not quoted and c in kind:
            if c in WRAPS:
                opened[c].append(i)
            elif opened[kind[c]]:
                partner[opened[kind[c]].pop()] = i
    lo, hi = 0, len(s) - 1
    while lo < hi and WRAPS.get(s[lo]) == s[hi] and partner.get(lo, hi) >= hi:
        lo, hi = lo + 1, hi - 1
        while lo <= hi and s[lo].isspace():
            lo += 1
        while lo <= hi and s[hi].isspace():
            hi -= 1
    return s[lo : hi + 1]


def _bracket_ends(tokens: list) -> dict[int, int]:
    """Where each bracket closes that ever does.

    Brackets but square ones nest, and one is closed only by its own partner while it is the
    innermost; so one stack tells for all of them, whatever stands around. A square bracket
    counts only outside of the others, and ends at the next one that stands as deep.
    """
    end: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    square: list[tuple[int, str, int]] = []
    for i, t in tokens:
        c = t[0]
        if len(t) > 1:
            continue
        if c in "[]":
            square.append((i, c, stack[-1][1] if stack else -1))
        elif c in OPEN:
            stack.append((OPEN[c], i))
        elif stack and c == stack[-1][0]:
            end[stack.pop()[1]] = i
    nearest: dict[int, int] = {}
    for i, c, inside in reversed(square):
        if c == "]":
            nearest[inside] = i
        elif inside in nearest:
            end[i] = nearest[inside]
    return end


def _quote_ends(s: str, tokens: list, quotes: str) -> dict[int, int]:
    """Where a quote that opens a value closes, for each quote sign at which one could open.

    It closes at a later sign that is not doubled and stands outside the parentheses opened
    since, i.e. where the depth is as low as anywhere since the opening. Going backward, the
    signs that can be reached are a stack: a lower depth hides the deeper ones behind it.
    """
    marks, depth, skip = [], 0, -1
    for i, t in tokens:
        if len(t) > 1 or i < skip:
            continue
        c = t[0]
        if c in "(（":
            depth += 1
        elif c in ")）":
            depth -= 1
        elif c in quotes:
            k = i + 1
            while k < len(s) and s[k] == c:
                k += 1
            marks.append((i, c, depth, k - i))  # a run of k - i signs
            skip = k
            continue
        else:
            continue
        marks.append((i, "", depth, 0))
    end: dict[int, int] = {}
    seen: dict[str, list[tuple[int, int]]] = {q: [] for q in quotes}
    for i, c, d, run in reversed(marks):
        for stack in seen.values():
            while stack and stack[-1][1] > d:
                stack.pop()
        if not c:
            continue
        stack = seen[c]
        if run % 2 == 0:
            end[i] = i + run - 1
        else:
            if stack:
                end[i] = stack[-1][0]
            stack.append((i + run - 1, d))
    return end


def _clean(raw: str, quotes: str) -> str:
    """Blanks around, and quotes that enclose the value as a whole, taken off; doubled and escaped quotes made single."""
    s = raw.strip()
    if len(s) >= 2 and s[0] in quotes and s[-1] == s[0]:
        q = s[0]
        body = s[1:-1]
        if q not in re.sub(rf"\\.|{q}{q}|\([^()]*\)|（[^（）]*）", "", body):
            s = body.strip()
    for q in quotes:
        s = s.replace("\\" + q, q).replace(q + q, q)
    return s.strip()


def split_packed(text: str | None, fmt: PackedFormat) -> list[str]:
    """Values of one field in order.

    A finite-state machine goes from special character to special character. It knows
    whether it stands in a quoted value (a quote opens only where a value begins, and
    closes only outside parentheses), how deep it is nested, and what is escaped or
    doubled; delimiters and markers count only outside of all these. Null, empty and
    placeholder fields give no value. A quote or bracket that never closes is ordinary
    text. Which ones close is found beforehand in one pass, so that the time is in
    proportion to the length whatever the field holds.
    """
    if not text:
        return []
    s = _unwrapped(text)
    token, marker, value = fmt.compiled()
    tokens = [(m.start(), m.group()) for m in token.finditer(s)]
    bracket_end, quote_end = _bracket_ends(tokens), _quote_ends(s, tokens, fmt.quotes)
    out, start, skip, filled = [], 0, -1, 0
    for i, t in tokens:
        if i <= skip:
            continue
        c = t[0]
        if len(t) > 1 and (marker.fullmatch(t) if c != "\\" else t[1] in fmt.delimiters):
            out.append(s[start:i])
            start = filled = i + len(t)
        elif len(t) == 1 and c in fmt.delimiters:
            out.append(s[start:i])
            start = filled = i + 1
        elif c in fmt.quotes:
            # a value begins here if only blanks stand before; looked at once for each character
            while filled < i and s[filled].isspace():
                filled += 1
            if filled == i:
                skip = quote_end.get(i, -1)
        elif len(t) == 1 and c in OPEN:
            skip = bracket_end.get(i, -1)
    out.append(s[start:])
    values = (_clean(x, fmt.quotes) for x in out)
    return [v for v in values if value.search(v)]


def explode_packed(df: DataFrame, key: str, fields: list[str], fmt: PackedFormat) -> DataFrame:
    """One row per value: key, `field`, `pos` (int, from 1 without gaps), `item`.

    Narrow: no shuffle; only the key and the packed fields are read. Rows that occur
    twice give their values twice; columns of other names don't matter; an empty table
    gives an empty result.
    """
    ship(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows, names, pos, items = [], [], [], []
            for k, name in enumerate(fields, 1):
                for i, text in enumerate(b.column(k).to_pylist()):
                    values = split_packed(text, fmt)
                    n = len(values)
                    rows += [i] * n
                    names += [name] * n
                    pos += range(1, n + 1)
                    items += values
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(rows, pa.int64())), pa.array(names, pa.string()), pa.array(pos, pa.int32()), pa.array(items, pa.string())],
                [key, "field", "pos", "item"],
            )

    return df.select(key, *fields).mapInArrow(run, f"`{key}` {kind}, field string, pos int, item string")
