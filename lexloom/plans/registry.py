"""All queries and their SQL, but for those of the subpackage llm."""

from __future__ import annotations

from lexloom.plans import corpus, lawfiles, packed, pairs, retrieval, storage, streams

MODULES = (retrieval, pairs, corpus, lawfiles, storage, streams)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()} | packed.QUERIES


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in m.SQL.items()}
