"""Size checks and the join that spreads hot keys."""

import time

from pyspark.sql import functions as F

from lexloom import runtime as R


def test_memory_size_counts_what_compression_hides(spark):
    df = R.materialize(spark.range(1000).selectExpr("id", "repeat('a', 1000) as t", "array(id, id) as l"), "test")
    assert R.path_bytes(spark, df._lexloom_path) < 40_000 and R.memory_bytes(df) > 1_000_000
    assert not R.fits(df, 100_000) and R.fits(df)
    assert R.memory_bytes(df.limit(0)) == 0


def test_spread_join(spark, monkeypatch):
    left = spark.range(3000).selectExpr("if(id < 2000, 0, id % 50) as k", "id as v", "'x' as n2")
    right = R.materialize(left.groupBy("k").count().withColumnRenamed("count", "n").where("k <> 7"), "test")
    monkeypatch.setattr(R, "fits", lambda df, limit=0: False)
    got = R.spread_join(left, right, ["k"], "n", 100)
    assert set(got.columns) == {"k", "v", "n2", "n"}
    assert sorted(map(tuple, got.select("k", "v", "n").collect())) == sorted(map(tuple, left.join(right, "k").select("k", "v", "n").collect()))
    assert R.spread_join(left, right, ["k"], "n", 10_000).count() == got.count()


def test_what_a_stage_shuffled_is_deleted(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    kept = spark.conf.get(R.SHUFFLE_CLEANUP)
    before = files.getAllFiles().size()
    df = R.materialize(spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count(), "test")
    until = time.time() + 20
    while files.getAllFiles().size() > before and time.time() < until:
        time.sleep(0.1)
    assert files.getAllFiles().size() <= before and df.count() == 100 and spark.conf.get(R.SHUFFLE_CLEANUP) == kept
