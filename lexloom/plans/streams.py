"""Queries that run as streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.runtime import shared_dir, table
from lexloom.streaming import resume

QUERIES: dict = {}
SQL: dict[str, str] = {
    "stream_resume_dedup": "select event_id, event_type, cast(round(value * 100) as bigint) as cents from events",
}


def stream_resume_dedup(s: SparkSession, d: str) -> DataFrame:
    """All events through a resumable stream, twice; the second run finds nothing new, and the log holds each event once."""
    base = f"{shared_dir(s)}/stream-{uuid.uuid4().hex[:12]}"
    schema = table(s, d, "events").schema
    # the folder is read with a pattern, as the source is one file of many tables in it
    for _ in range(2):
        resume.stream_once(
            s, f"{d}/event[s].parquet", schema, "event_id", "ts", f"{base}/log", f"{base}/checkpoint",
            lambda x: x.select("event_id", "ts", "event_type", F.round(F.col("value") * 100).cast("bigint").alias("cents")), "36500 days",
        )
    return resume.latest(s.read.parquet(f"{base}/log"), "event_id", "ts").select("event_id", "event_type", "cents")


QUERIES["stream_resume_dedup"] = stream_resume_dedup
