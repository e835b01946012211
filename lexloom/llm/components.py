"""Connected components of a link table by alternating minimum propagation and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.runtime import materialize, spread_join


def components(links: DataFrame) -> DataFrame:
    """links: `a`, `b` (any comparable type, nulls ignored) -> `node`, `component` (its least node).

    Each round every node takes the least label of itself and its neighbours, hooks that
    label onto its old label, and jumps to the label's label, so that long chains shorten
    by a factor in each round. Every round is written to the shared folder; the loop ends
    when no label changes. Minima are partial before each shuffle, and where the links take
    up the labels, those of a node of very high degree are spread over many tasks.
    """
    e = links.where("a is not null and b is not null and a <> b").select("a", "b")
    e = materialize(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    # each node with its number of links, which tells where labels have to be spread
    own = F.least("node", "m").alias("component")
    lab = materialize(e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"), F.count("*").alias("n")).select("node", own, "n"), "labels")
    none = F.lit(None).cast("bigint").alias("n")
    while e.limit(1).count():
        far = lab.select(F.col("node").alias("b"), "component", "n")
        far._lexloom_path = lab._lexloom_path
        near = spread_join(e, far, ["b"], "n").select(F.col("a").alias("node"), "component", none)
        least = [F.min("component").alias("component"), F.max("n").alias("n")]
        new = near.unionByName(lab).groupBy("node").agg(*least)
        # hooking: the old label learns the new one
        hook = lab.select("node", F.col("component").alias("old")).join(new, "node").select(F.col("old").alias("node"), "component", none)
        new = new.unionByName(hook).groupBy("node").agg(*least)
        # jumping
        up = new.select(F.col("node").alias("component"), F.col("component").alias("up"))
        new = new.join(up, "component", "left").select("node", F.coalesce(F.least("component", "up"), "component").alias("component"), "n")
        new = materialize(new, "labels")
        changed = new.join(lab.select("node", F.col("component").alias("before")), "node").where("component <> before").limit(1).count()
        lab = new
        if not changed:
            break
    return lab.select("node", "component")
