"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from lexloom.llm.oracle import SQL
from lexloom.llm.queries import QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
