import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.operators import bm25
from lexloom.operators import ranking as R


def plain_bm25(docs, query, k1=1.5, b=0.75, eps=0.25):
    toks = {k: v.lower().split() for k, v in docs.items()}
    n, avg = len(docs), sum(map(len, toks.values())) / len(docs)
    df = Counter(t for v in toks.values() for t in set(v))
    idf = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {t: x if x >= 0 else eps * mean for t, x in idf.items()}
    out = {}
    for k, v in toks.items():
        tf = Counter(v)
        s = sum(idf.get(t, 0) * tf[t] * (k1 + 1) / (tf[t] + k1 * (1 - b + b * len(v) / avg)) for t in query.lower().split() if tf[t])
        if any(t in tf for t in query.lower().split()):
            out[k] = s
    return out


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(5)
    voc = [f"w{i}" for i in range(30)]
    return {i: " ".join(r.choice(voc) for _ in range(r.randint(1, 20))) for i in range(40)}


def test_bm25(spark, corpus):
    docs = spark.createDataFrame([*corpus.items(), (99, None)], "doc_id long, text string")
    qs = {1: "w1 w2 w2 w3", 2: "w4 w29", 3: "nothing here"}
    q = spark.createDataFrame([*qs.items(), (4, None)], "q long, text string")
    s = bm25.scores(bm25.tokens(docs, "doc_id", "text"), bm25.tokens(q, "q", "text"), "doc_id", "q")
    got = {(r["q"], r["doc_id"]): r["score"] for r in s.collect()}
    want = {(k, d): v for k, t in qs.items() for d, v in plain_bm25({**corpus, 99: ""}, t).items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    top = bm25.top_k(s, "q", "doc_id", 3).where("q = 1").orderBy("rank").collect()
    fast = bm25.search(bm25.tokens(docs, "doc_id", "text"), bm25.tokens(q, "q", "text"), "doc_id", "q", 3)
    slow = bm25.top_k(s, "q", "doc_id", 3)
    assert sorted(map(tuple, fast.collect())) == sorted(map(tuple, slow.collect())) and fast.columns == slow.columns
    best = sorted(((-round(v, 6), d) for (k, d), v in want.items() if k == 1))[:3]
    assert [(r["doc_id"], r["score"]) for r in top] == [(d, -v) for v, d in best]


def test_group_rank_counts_zero_scores(spark, corpus):
    docs = spark.createDataFrame([(k, f"g{k % 7}") for k in corpus], "doc_id long, g string")
    full = spark.createDataFrame(list(corpus.items()), "doc_id long, text string")
    qs = [(1, "w1 w2", "g3"), (2, "zzz", "g5"), (3, "w9", "absent"), (4, "w4", "g0")]
    q = spark.createDataFrame(qs, "q long, text string, g string")
    s = bm25.scores(bm25.tokens(full, "doc_id", "text"), bm25.tokens(q, "q", "text"), "doc_id", "q")
    got = {r["q"]: r["rank"] for r in bm25.group_rank(s, docs, q.select("q", "g"), "q", "doc_id", "g").collect()}
    c2 = bm25.tokens(full, "doc_id", "text").join(docs, "doc_id")
    fast = bm25.source_rank(c2, bm25.tokens(q, "q", "text").join(q.select("q", "g"), "q"), "doc_id", "q", "g")
    assert {r["q"]: r["rank"] for r in fast.collect()} == got
    for k, text, g in qs:
        sc = plain_bm25(corpus, text)
        order = sorted(corpus, key=lambda d: (-round(sc.get(d, 0.0), 6), d))
        want = next((i for i, d in enumerate(order, 1) if f"g{d % 7}" == g), None)
        assert got[k] == want, k


def vectors(spark, n=60, dim=8):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(n, dim))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    return m, spark.createDataFrame([(i, [float(x) for x in v], i % 5) for i, v in enumerate(m)], "doc_id long, vector array<float>, label int")


def test_dense(spark):
    m, c = vectors(spark)
    m = m.astype(np.float32).astype(np.float64)
    q = c.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    s = np.round(m @ m.T, 6)
    for r in R.dense_top_k(q, c, 4).collect():
        order = np.lexsort((np.arange(len(m)), -s[r["query_id"]]))
        assert order[r["rank"] - 1] == r["doc_id"]
    got = {r["query_id"]: r["rank"] for r in R.dense_group_rank(q, c).collect()}
    for i in (0, 20, 40):
        order = [d for d in np.lexsort((np.arange(len(m)), -s[i])) if d != i]
        assert got[i] == 1 + next(k for k, d in enumerate(order) if d % 5 == i % 5)
    assert R.dense_top_k(q.limit(0), c, 4).count() == 0
    one = c.limit(2).select("doc_id", R.dot(F.col("vector"), F.col("vector")).alias("d")).collect()
    assert all(abs(r["d"] - 1) < 1e-5 for r in one)


def test_rrf_metrics_bootstrap(spark):
    a = spark.createDataFrame([(1, "x", 0), (1, "y", 1)], "q long, d string, position long")
    b = spark.createDataFrame([(1, "y", 0), (1, "x", 1)], "q long, d string, position long")
    f = {r["d"]: r["score"] for r in R.reciprocal_rank_fusion([a, b, b], "q", "d").collect()}
    assert abs(f["y"] - (1 / 62 + 2 / 61)) < 1e-12
    ranks = spark.createDataFrame([(i, r) for i, r in enumerate([1, 2, 5, 10, 11, None])], "query_id long, rank long")
    m = R.metrics(ranks).first()
    assert abs(m["recall_10"] - 4 / 6) < 1e-12 and abs(m["mrr_10"] - (1 + 0.5 + 0.2 + 0.1) / 6) < 1e-12
    assert abs(m["ndcg_10"] - sum(1 / math.log2(r + 1) for r in (1, 2, 5, 10)) / 6) < 1e-12
    for r in R.bootstrap(ranks, 200).collect():
        assert r["lo"] <= r["value"] <= r["hi"]
    assert R.bootstrap(ranks.limit(0)).count() == 0
