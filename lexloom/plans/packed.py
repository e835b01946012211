"""Problem 1: cited articles packed in one field of case documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexloom.operators.packed import PackedFormat, explode_packed
from lexloom.runtime import table

CITATIONS = PackedFormat(value=r"제\s*\d+\s*조|^(?:law|decree|rule|precedent):\S+$")
FIELDS = ["참조조문", "referenced_articles"]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """One row per cited article: doc_id, field, pos, item."""
    return explode_packed(table(spark, d, "documents"), "doc_id", FIELDS, CITATIONS)


QUERIES = {"p1_found": p1_found}
