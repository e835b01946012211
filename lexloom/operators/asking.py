"""Generation of questions for passages and judging of (question, passage) pairs, in batches through a provider chain.

A batch is one request: its items are numbered, and answers come back by number. An answer
must fit its schema and be checked before it counts; a batch without a good answer is asked
again item by item (`providers.run_batches`). What was answered is appended to a log, so that a
later run goes on with the rest.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame

from lexloom.operators.providers import Chain, json_schema, run_batches

VERDICTS = ("yes", "partial", "no")


def _list_of(**fields: str) -> dict:
    kinds = {k: {"type": "ARRAY", "items": {"type": "STRING"}} if v == "LIST" else {"type": v} for k, v in fields.items()}
    return {"type": "OBJECT", "properties": {"results": {"type": "ARRAY", "items": {"type": "OBJECT", "properties": kinds, "required": list(fields)}}}, "required": ["results"]}


QUESTIONS, JUDGMENTS = _list_of(id="INTEGER", questions="LIST"), _list_of(id="INTEGER", verdict="STRING", reason="STRING")


def numbered(items: list[dict], fields: list[str]) -> str:
    """The items of a request, each under its number."""
    return "\n\n".join(f"## {i}\n" + "\n".join(f"{k}: {item[k]}" for k in fields) for i, item in enumerate(items))


def check_questions(answer: dict) -> None:
    if not all(isinstance(q, str) for r in answer["results"] for q in r["questions"]):
        raise ValueError("questions must be texts")


def check_verdicts(answer: dict) -> None:
    bad = {r["verdict"] for r in answer["results"]} - set(VERDICTS)
    if bad:
        raise ValueError(f"no such verdicts: {sorted(map(str, bad))}")


def _by_number(answer: dict, size: int) -> dict[int, dict]:
    """Results by number; what is no number of the batch is left out, and of several the first counts."""
    out: dict[int, dict] = {}
    for r in answer["results"]:
        number = str(r.get("id", "")).strip()
        if number.isdecimal() and int(number) < size:
            out.setdefault(int(number), {k: v for k, v in r.items() if k != "id"})
    return out


def asker(chain: Chain, system: str, fields: list[str], schema: dict, check: Callable[[dict], None]) -> Callable:
    """(items, seed) -> answers by number with the model that gave them, or None."""
    closed = json_schema(schema)

    def ask(items: list[dict], seed: int):
        got = chain.ask(system, numbered(items, fields), closed, seed, check)
        if got is None:
            return None
        answer, _, version, used = got
        return {i: r | {"model": version, "seed": used} for i, r in _by_number(answer, len(items)).items()}

    return ask


def generate(passages: DataFrame, chain: Chain, commit: Callable[[list[dict]], None], most: int = 2, size: int = 10, limit: int = 100, seed: int = 42) -> tuple[int, list]:
    """Questions for passages (`chunk_id`, `text`): rows `qid`, `question`, `chunk_id`, `model`, `seed` through `commit`, a batch at a time.

    Questions are composed and trimmed, empty ones left out, and at most `most` of a passage kept.
    """
    ask = asker(chain, "Write questions that the passage answers.", ["text"], QUESTIONS, check_questions)

    def rows(batch: list[dict]) -> None:
        out = []
        for r in batch:
            texts = [unicodedata.normalize("NFC", q).strip() for q in r["questions"]]
            out += [{"qid": f"{r['chunk_id']}|q{k}", "question": q, "chunk_id": r["chunk_id"], "model": r["model"], "seed": r["seed"]} for k, q in enumerate([q for q in texts if q][:most])]
        commit(out)

    return run_batches(passages.select("chunk_id", "text"), size, ask, rows, limit, seed)


def judge(pairs: DataFrame, chain: Chain, commit: Callable[[list[dict]], None], size: int = 10, limit: int = 100, seed: int = 42) -> tuple[int, list]:
    """Verdicts on pairs (`qid`, `question`, `text`): rows `qid`, `verdict`, `reason`, `model`, `seed` through `commit`, a batch at a time."""
    ask = asker(chain, "Does the passage answer the question?", ["question", "text"], JUDGMENTS, check_verdicts)
    keep = ("qid", "verdict", "reason", "model", "seed")
    return run_batches(pairs.select("qid", "question", "text"), size, ask, lambda batch: commit([{k: r[k] for k in keep} for r in batch]), limit, seed)
