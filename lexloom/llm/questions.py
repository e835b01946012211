"""Readings of the question, chunk and split tables that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.runtime import path_bytes, table

TRAIN, HELD_OUT = 2, 1


def split_name(c: Column) -> Column:
    """train, val or test of any usual spelling; null if null or unknown."""
    s = F.lower(F.regexp_replace(c, r"[^\p{L}]", ""))
    return (
        F.when(s.isin("train", "training", "trn"), "train")
        .when(s.isin("val", "valid", "validation", "dev", "development", "eval"), "val")
        .when(s.isin("test", "testing", "tst"), "test")
    )


def document_of(qid: Column, chunk_id: Column, group_id: Column) -> Column:
    """The document key of a question: from its id, else its chunk's id, else the group as it is written."""
    from_qid = F.regexp_extract(qid, r"^(.+)#\d+\|q\d+$", 1)
    from_chunk = F.regexp_extract(F.trim(chunk_id), r"^(.+)#\d+$", 1)
    return F.coalesce(F.nullif(from_qid, F.lit("")), F.nullif(from_chunk, F.lit("")), F.nullif(F.trim(F.lower(group_id)), F.lit("")))


def group_splits(spark: SparkSession, sf_dir: str, limit: int = 16 << 20) -> DataFrame:
    """group_id, side (bits: held out, train) and split; broadcast only if its file is under the limit."""
    path = f"{sf_dir}/splits.parquet"
    s = table(spark, sf_dir, "splits").select("group_id", split_name(F.col("split")).alias("split")).where("group_id is not null and split is not null")
    side = F.when(F.col("split") == "train", TRAIN).otherwise(HELD_OUT)
    s = s.groupBy("group_id").agg(F.bit_or(side).alias("side"), F.min("split").alias("split"))
    return F.broadcast(s) if path_bytes(spark, path) <= limit else s
