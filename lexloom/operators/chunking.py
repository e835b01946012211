"""Token-budgeted chunks of statutes and cases.

The token counter is any function text -> number of tokens, with `spans` text -> token
offsets for cutting; the default counts words and single signs.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.operators.structure import unit_lines
from lexloom.runtime import ship

SIGNS = re.compile(r"\w+|[^\w\s]")


class SignTokens:
    """Default counter: words and single signs."""

    def spans(self, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in SIGNS.finditer(text)]

    def __call__(self, text: str) -> int:
        return len(self.spans(text))


@dataclass(frozen=True)
class ChunkRules:
    max_tokens: int = 480
    lead_tokens: int = 120
    overlap: float = 0.12
    counter: object = field(default_factory=SignTokens)


def pack(units: list[str], budget: int, count, overlap: int = 0) -> list[str]:
    """Units joined by line ends into bodies within the budget, greedily and in order.

    Counted on the joined text, since counts need not add up. With an overlap a body begins
    with the last units of the one before, as many as stay within `overlap` tokens, unless
    the next unit would not fit behind them.
    """
    bodies: list[list[str]] = []
    for unit in units:
        if bodies and count("\n".join([*bodies[-1], unit])) <= budget:
            bodies[-1].append(unit)
            continue
        carry: list[str] = []
        if bodies and overlap:
            for back in reversed(bodies[-1]):
                if count("\n".join([back, *carry])) > overlap:
                    break
                carry = [back, *carry]
            if count("\n".join([*carry, unit])) > budget:
                carry = []
        bodies.append([*carry, unit])
    return ["\n".join(b) for b in bodies]


def windows(text: str, budget: int, counter, overlap: int = 0) -> list[str]:
    """Stretches of the text of at most `budget` tokens, cut by token offsets; each is counted again and shortened until it fits."""
    spans = counter.spans(text)
    out, at = [], 0
    while at < len(spans):
        stop = min(at + budget, len(spans))
        cut = lambda e: text[spans[at][0] : spans[e - 1][1]].strip()
        while stop > at + 1 and counter(cut(stop)) > budget:
            stop -= 1
        out.append(cut(stop))
        if stop == len(spans):
            break
        at = max(at + 1, stop - overlap)
    return out


def _fit(parts: list[str], budget: int, counter, overlap: int = 0) -> list[str]:
    return [x for p in parts for x in ([p] if counter(p) <= budget else windows(p, budget, counter, overlap))]


def statute_bodies(prefix: str, text: str, paragraphs: list[dict], rules: ChunkRules) -> list[str]:
    """Bodies of one article: whole if it fits, else by paragraphs, a large paragraph by its item lines after its lead."""
    n = rules.counter
    budget = rules.max_tokens - n(prefix + "\n")
    if n(text) <= budget:
        return [text]
    units: list[str] = []
    for head, lines in unit_lines(paragraphs):
        whole = "\n".join(([head] if head else []) + lines)
        if n(whole) <= budget:
            units.append(whole)
        elif head and n(head) <= rules.lead_tokens:
            room = budget - n(head + "\n")
            bodies = pack(_fit(lines, room, n), room, n)
            units += [b if i == 0 and b.startswith(head) else f"{head}\n{b}" for i, b in enumerate(bodies)]
        else:
            units += pack(_fit(([head] if head else []) + lines, budget, n), budget, n)
    return pack(units, budget, n)


def issues(text: str) -> dict[int, str]:
    """'[1] a [2] b' -> {1: 'a', 2: 'b'}; {} unless the text begins with a number mark."""
    parts = re.split(r"\[(\d+)\]\s*", text)
    return {int(k): v.strip() for k, v in zip(parts[1::2], parts[2::2])} if not parts[0].strip() else {}


def case_bodies(prefix: str, holding: str, summary: str, rules: ChunkRules, labels: tuple[str, str] = ("판시사항", "판결요지")) -> list[str]:
    """Bodies of one case: numbered issues with their summaries, else one unit; large units by sentences with an overlap."""
    n = rules.counter
    budget = rules.max_tokens - n(prefix + "\n")
    over = int(budget * rules.overlap)
    a, b = issues(holding), issues(summary)
    pairs = [(a[k], b[k]) for k in sorted(a)] if len(a) > 1 and a.keys() == b.keys() else [(holding, summary)]
    out: list[str] = []
    for x, y in pairs:
        unit = f"{labels[0]}: {x}\n{labels[1]}: {y}"
        out += [unit] if n(unit) <= budget else pack(_fit(re.split(r"(?<=[.?!])\s+", unit), budget, n, over), budget, n, over)
    return out


CHUNKS = "chunk_id string, doc_id string, group_id string, doc_type string, title string, source_url string, part int, n_parts int, text string, n_tokens int"


def chunk_documents(docs: DataFrame, rules: ChunkRules = ChunkRules()) -> DataFrame:
    """docs: doc_id, doc_type, title, source_url, prefix, text, holding, summary, paragraphs -> chunks.

    A case is a row with a holding or summary and without paragraphs. A null text counts as
    empty, and gives one chunk of its title. Narrow.
    """
    ship(docs.sparkSession)
    cols = ["doc_id", "doc_type", "title", "source_url", "prefix", "text", "holding", "summary", "paragraphs"]

    def run(batches):
        for p in batches:
            rows = []
            for r in p.to_dict("records"):
                tree = r["paragraphs"]
                if tree is None or not len(tree):
                    got = case_bodies(r["prefix"], r["holding"] or "", r["summary"] or "", rules) if r["holding"] or r["summary"] else _plain(r["prefix"], r["text"] or "", rules)
                else:
                    got = statute_bodies(r["prefix"], r["text"] or "", tree, rules)
                for i, body in enumerate(got):
                    t = f"{r['prefix']}\n{body}"
                    rows.append((f"{r['doc_id']}#{i}", r["doc_id"], r["doc_id"], r["doc_type"], r["title"], r["source_url"], i + 1, len(got), t, rules.counter(t)))
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in CHUNKS.split(", ")])

    return docs.select(*cols).mapInPandas(run, CHUNKS)


def _plain(prefix: str, text: str, rules: ChunkRules) -> list[str]:
    budget = rules.max_tokens - rules.counter(prefix + "\n")
    if rules.counter(text) <= budget:
        return [text]
    return pack(_fit(text.split("\n"), budget, rules.counter), budget, rules.counter)


def over_budget(chunks: DataFrame, max_tokens: int) -> DataFrame:
    """Chunks that break the budget; must be empty."""
    return chunks.where(F.col("n_tokens") > max_tokens).select("chunk_id", "n_tokens")
