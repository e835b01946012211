"""Version selection: the version in force at a snapshot, and the latest version of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_force(versions: DataFrame, key: str, committed: Column, effective: Column, snapshot: str, tie: Column) -> DataFrame:
    """The newest committed version of each key that is in force at the snapshot, with the number of newer ones skipped.

    Order is that of commits, not of effective dates: the first version in force, from the
    newest commit backward, is taken. Keys without any have `pin_failed` and a null version.
    Aggregates before each shuffle; no list of a key's versions is gathered.
    """
    ok = F.coalesce(effective <= F.lit(snapshot).cast("date"), F.lit(False))
    v = versions.select(key, F.struct(committed.alias("c"), tie.alias("t")).alias("o"), ok.alias("ok"))
    best = v.groupBy(key).agg(F.max(F.when(F.col("ok"), F.col("o"))).alias("best"))
    later = v.where("not ok").join(best, key).where("best is null or o > best").groupBy(key).agg(F.count("*").alias("n"))
    x = best.join(later, key, "left")
    return x.select(key, F.col("best.t").alias("version"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_skipped"), F.col("best").isNull().alias("pin_failed"))


def latest_in_force(versions: DataFrame, key: str, effective: Column, snapshot: str, tie: Column) -> DataFrame:
    """The version of the latest effective date that is in force at the snapshot; keys without any have a null version."""
    ok = F.coalesce(effective <= F.lit(snapshot).cast("date"), F.lit(False))
    return versions.groupBy(key).agg(F.max(F.when(ok, F.struct(effective.alias("e"), tie.alias("t")))).alias("b")).select(key, F.col("b.t").alias("version"))


def latest_per_key(df: DataFrame, keys: list[str], newest_first: list[Column]) -> DataFrame:
    """All rows with `is_latest`: the first by the given order in each key, the others for the record of exclusions."""
    w = Window.partitionBy(*keys).orderBy(*newest_first)
    return df.withColumn("is_latest", F.row_number().over(w) == 1)
