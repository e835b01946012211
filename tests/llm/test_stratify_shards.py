from collections import Counter

from lexloom.llm.stratify import grouped_split

P = {"train": 0.8, "val": 0.1, "test": 0.1}


def test_rare_label_over_many_shards(spark):
    """About 3 components a shard: each shard by itself would send all of them to train."""
    rows = [(f"c{i}", [1, 0] if i >= 90 else [0, 1]) for i in range(6000)]
    df = spark.createDataFrame(rows, "component string, counts array<bigint>")
    out = {x["component"]: x["split"] for x in grouped_split(df, ["a", "b"], P, shard_size=200).collect()}
    assert len(out) == len(rows)
    assert Counter(out[f"c{i}"] for i in range(90)) == {"train": 72, "val": 9, "test": 9}
