"""What a search gives to the final window grows with its tasks, not with the slabs or batches of the corpus."""

from lexloom.operators import bm25
from lexloom.operators.ranking import dense_scores


def test_search_gives_the_best_of_a_task(spark, monkeypatch):
    n, k = 4096, 1
    docs = spark.range(0, n, 1, 1).selectExpr("id as doc_id", "array_repeat('a', cast(1 + id % 7 as int)) as terms")
    asks = spark.range(0, n, 1, 1).selectExpr("id as q", "array('a') as terms")
    seen = []
    top_k = bm25.top_k
    monkeypatch.setattr(bm25, "top_k", lambda scored, *a: seen.append(scored) or top_k(scored, *a))
    got = bm25.search(docs, asks, "doc_id", "q", k)
    assert seen[0].count() <= n * k * seen[0].rdd.getNumPartitions() < 4 * n
    # a word of every document counts against it, so the least count is best; ties by id
    assert got.selectExpr("count(*) as n", "count_if(rank = 1 and doc_id = 0) as best").first() == (n, n)


def test_vectors_give_the_best_of_a_task(spark):
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    kept = spark.conf.get(batch)
    spark.conf.set(batch, "10")
    try:
        docs = spark.range(0, 200, 1, 1).selectExpr("id as doc_id", "array(1d / (id + 1)) as vector")
        asks = spark.range(0, 3, 1, 1).selectExpr("id as query_id", "array(1d) as vector")
        assert dense_scores(asks, docs, 5).count() == 3 * 5  # not 5 of each batch
    finally:
        spark.conf.set(batch, kept)
