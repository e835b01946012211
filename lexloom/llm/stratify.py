"""Splits that keep related records together: grouped iterative stratification.

Records that share an entity form a component (`components`). Each component has a
vector of label counts. The label with the fewest outstanding records is dealt out
first: its components, largest first, go to the split that needs most of that label,
then to the one that needs most records.

Placing is sequential by nature, so it is divided: components of at least `giant` of
all records (at most 1 / giant of them) and, if there are several shards, those with a
label of fewer than FEW components a shard (at most FEW x shards for each such label) are
placed first, in one run over the whole need; the others are dealt at random into shards
of at most `shard_size` components, each with its share of what is still needed, and placed
shard by shard in parallel. The error against the proportions is up to about one small
component per shard and label; the shards round alike, so that the errors of a label add up
to about 1 / FEW of it.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.runtime import materialize, ship

#: Components a shard of a label below which all of them are placed in the first run.
FEW = 100


def place(counts: np.ndarray, order_key: list, need: np.ndarray, need_all: np.ndarray) -> np.ndarray:
    """Iterative stratification. counts: components x labels; need: splits x labels (changed); returns the split of each."""
    n, m = counts.shape
    split = np.full(n, -1)
    weight = counts.sum(axis=1)
    left = counts.sum(axis=0).astype(float)
    tie = np.array(order_key)
    while (split < 0).any():
        open_ = split < 0
        live = np.where(left > 0)[0]
        if not len(live):
            live_label, todo = -1, np.where(open_)[0]
        else:
            live_label = live[np.lexsort((live, left[live]))[0]]
            todo = np.where(open_ & (counts[:, live_label] > 0))[0]
        by = counts[todo, live_label] if live_label >= 0 else weight[todo]
        for i in todo[np.lexsort((tie[todo], -weight[todo], -by))]:
            first = need[:, live_label] if live_label >= 0 else need_all
            s = max(range(len(need_all)), key=lambda j: (round(first[j], 9), round(need_all[j], 9), -j))
            split[i] = s
            need[s] -= counts[i]
            need_all[s] -= weight[i]
            left -= counts[i]
    return split


def grouped_split(
    components: DataFrame,
    labels: list,
    proportions: dict[str, float],
    giant: float = 1e-3,
    shard_size: int = 20_000,
) -> DataFrame:
    """components: `component` string, `counts` array<bigint> by `labels` -> `component`, `split`.

    Every component gets exactly one split, the same in every run. An empty table gives an
    empty result. The number of labels must be small (it is the size of an array).
    """
    spark = components.sparkSession
    ship(spark)
    names, shares = list(proportions), np.array(list(proportions.values()), float)
    shares = shares / shares.sum()
    m = len(labels)
    comp = materialize(components.withColumn("weight", F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x)), "components")
    sums = comp.agg(F.count("*").alias("n"), F.sum("weight").alias("w"), *[F.sum(F.col("counts")[k]).alias(f"l{k}") for k in range(m)], *[F.count_if(F.col("counts")[k] > 0).alias(f"n{k}") for k in range(m)]).first()
    if not sums["n"]:
        return comp.select("component", F.lit(None).cast("string").alias("split"))
    total = np.array([sums[f"l{k}"] or 0 for k in range(m)], float)
    need, need_all = np.outer(shares, total), shares * float(sums["w"] or 0)
    least = max(1, math.ceil(giant * (sums["w"] or 0)))
    first = F.col("weight") >= least
    shards = max(1, math.ceil((sums["n"] - comp.where(first).count()) / shard_size))
    if shards > 1:
        for k in range(m):
            if 0 < sums[f"n{k}"] < FEW * shards:
                first = first | (F.col("counts")[k] > 0)
    big = comp.where(first).orderBy("component").toArrow()
    bc = np.array(big["counts"].to_pylist(), np.int64).reshape(-1, m)
    names_big = big["component"].to_pylist()
    chosen = place(bc, [zlib.crc32(x.encode()) for x in names_big], need, need_all) if len(names_big) else np.empty(0, int)
    need_s, need_all_s = np.maximum(need, 0) / shards, np.maximum(need_all, 0) / shards

    def run(tab: pa.Table) -> pa.Table:
        ids = tab["component"].to_pylist()
        counts = np.array(tab["counts"].to_pylist(), np.int64).reshape(-1, m)
        at = place(counts, [zlib.crc32(x.encode()) for x in ids], need_s.copy(), need_all_s.copy())
        return pa.table({"component": ids, "split": [names[i] for i in at]})

    small = (
        comp.where(~first)
        .select("component", "counts", F.pmod(F.xxhash64("component"), F.lit(shards)).alias("shard"))
        .groupBy("shard")
        .applyInArrow(run, "component string, split string")
    )
    giants = spark.createDataFrame([(c, names[i]) for c, i in zip(names_big, chosen)], "component string, split string")
    return small.unionByName(giants)
