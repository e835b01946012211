import random

import numpy as np

from lexloom.llm.stratify import grouped_split, place

P = {"train": 0.8, "val": 0.1, "test": 0.1}


def test_place_meets_rare_labels():
    counts = np.array([[5, 0]] * 80 + [[0, 2]] * 10)
    need = np.outer([0.8, 0.1, 0.1], counts.sum(0))
    got = place(counts, list(range(90)), need, np.array([0.8, 0.1, 0.1]) * counts.sum())
    assert [np.bincount(got[80:], minlength=3).tolist(), np.bincount(got[:80], minlength=3).tolist()] == [[8, 1, 1], [64, 8, 8]]


def test_grouped_split(spark):
    r = random.Random(2)
    rows = [(f"c{i}", [r.randint(0, 4), r.randint(0, 1)]) for i in range(3000)] + [("giant", [2500, 10]), ("none", [0, 0])]
    df = spark.createDataFrame(rows, "component string, counts array<bigint>")
    out = grouped_split(df, ["a", "b"], P, shard_size=500).collect()
    assert len(out) == len(rows) and len({x["component"] for x in out}) == len(rows)
    w = dict(rows)
    total = sum(sum(v) for v in w.values())
    share = {s: sum(sum(w[x["component"]]) for x in out if x["split"] == s) / total for s in P}
    assert all(abs(share[s] - P[s]) < 0.01 for s in P), share
    assert {x["component"]: x["split"] for x in out}["giant"] == "train"
    again = grouped_split(df.repartition(3), ["a", "b"], P, shard_size=500).collect()
    assert {tuple(x) for x in again} == {tuple(x) for x in out}
    assert grouped_split(df.limit(0), ["a", "b"], P).count() == 0
