"""Dense scores, rank fusion, ranking metrics and their bootstrap intervals."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.positions import positions
from lexloom.functions.text import seeded
from lexloom.operators.best import OUT_ROWS, TOP_CELLS, Best, Rough, dots, few, matrix
from lexloom.runtime import ship

#: Bytes of query vectors held by a task at a time.
QUERY_BYTES = 32 << 20


def dot(a, b):
    """Dot product of two array columns, in double; the cosine of unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def dense_scores(queries: DataFrame, corpus: DataFrame, k: int | None = None, digits: int = 6) -> DataFrame:
    """query_id, doc_id, score by dot product: of all documents, or of some that hold the best k of all.

    The corpus streams by in batches past blocks of queries of a bounded size, as matrix
    products. The queries come to the driver in blocks of QUERY_BYTES, never all at once.
    With k, a task holds the best k scores of each query so far and gives only documents that
    reach them. Rows without an id or a vector are left out.
    """
    spark = corpus.sparkSession
    ship(spark)
    queries, corpus = queries.where("vector is not null and query_id is not null"), corpus.where("vector is not null and doc_id is not null")
    first = queries.agg(F.max(F.size("vector")).alias("d"), F.count("*").alias("n")).first()
    schema = "query_id bigint, doc_id bigint, score double"
    out = spark.createDataFrame([], schema)
    blocks = max(1, -(-first["n"] * (first["d"] or 0) * 8 // QUERY_BYTES), -(-first["n"] * (k or 0) // TOP_CELLS))
    for part in range(blocks if first["n"] else 0):
        q = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == part) if blocks > 1 else queries
        got = q.select("query_id", "vector").toArrow()
        if not len(got):
            continue
        bc = spark.sparkContext.broadcast((got["query_id"].to_numpy(), matrix(got["vector"])))

        def full(batches, bc=bc):
            qid, mat = bc.value
            for b in batches:
                step = max(1, OUT_ROWS // len(qid))
                for lo in range(0, b.num_rows, step):
                    ids, vec = b.column(0)[lo : lo + step].to_numpy(), matrix(b.column(1)[lo : lo + step])
                    s = np.round(mat @ vec.T, digits)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, len(ids))), pa.array(np.tile(ids, len(qid))), pa.array(s.ravel())], ["query_id", "doc_id", "score"])

        def top(batches, bc=bc):
            qid, mat = bc.value
            rough, best, near = Rough(mat), Best(len(qid), k), 1.1 * 10.0**-digits
            for b in batches:
                if not b.num_rows:
                    continue
                ids, vec = b.column(0).to_numpy(), matrix(b.column(1))
                order = np.argsort(ids, kind="stable")
                ids, rows, docs, vals, held = ids[order], [], [], [], 0
                for x, y, v, s, slack in rough.products(vec[order]):
                    for i, row in enumerate(s):
                        q, e = x + i, 2 * slack[i] + near
                        at = np.flatnonzero(row >= float(best.least[q] - e)) if best.least[q] > -np.inf else np.arange(len(row))
                        if len(at) > 2 * k:  # only those that can be among the best of this tile
                            some = row[at]
                            at = at[some >= float(np.partition(some, len(at) - k)[len(at) - k] - e)]
                        at, score = best.add(q, at, np.round(dots(mat[np.full(len(at), q)], v[at]), digits))
                        rows.append(np.full(len(at), q))
                        docs.append(y + at)
                        vals.append(score)
                        held += len(at)
                        if held >= OUT_ROWS:
                            yield pa.RecordBatch.from_arrays([pa.array(qid[np.concatenate(rows)]), pa.array(ids[np.concatenate(docs)]), pa.array(np.concatenate(vals))], ["query_id", "doc_id", "score"])
                            rows, docs, vals, held = [], [], [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(qid[np.concatenate(rows)]), pa.array(ids[np.concatenate(docs)]), pa.array(np.concatenate(vals))], ["query_id", "doc_id", "score"])

        x = few(corpus.select("doc_id", "vector")).mapInArrow(top, schema) if k else corpus.select("doc_id", "vector").mapInArrow(full, schema)
        out = out.unionByName(x)
    return out


def dense_top_k(queries: DataFrame, corpus: DataFrame, k: int, digits: int = 6, keep=None) -> DataFrame:
    """Best k of the corpus for each query by dot product, ties by id. queries: `query_id`, `vector`; corpus: `doc_id`, `vector`.

    A task sends few more than its own best k of each query to the final window.
    """
    out = dense_scores(queries, corpus, k, digits)
    if keep is not None:
        out = out.where(keep)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return out.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def dense_group_rank(queries: DataFrame, corpus: DataFrame, digits: int = 6) -> DataFrame:
    """1-based rank of the first document of each query's own group, the query itself left out; null if it has none.

    queries: `query_id`, `vector`, `label`; corpus: `doc_id`, `vector`, `label`. Two passes over
    the corpus by blocks: the best own document, then how many documents beat it. Only one
    row per query and block is shuffled, never a ranking.
    """
    spark = corpus.sparkSession
    corpus = corpus.where("vector is not null and doc_id is not null")
    got = queries.select("query_id", "vector", "label").where("vector is not null and query_id is not null")
    n = got.count()
    if not n:
        return spark.createDataFrame([], "query_id bigint, rank bigint")
    width = got.select(F.max(F.size("vector"))).first()[0]
    blocks = max(1, -(-n * width * 8 // QUERY_BYTES))
    out = None
    for part in range(blocks):
        q = (got.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == part) if blocks > 1 else got).toArrow()
        qid, mat = q["query_id"].to_numpy(), np.array(q["vector"].to_pylist(), np.float64)
        held = spark.sparkContext.broadcast((qid, mat, q["label"].to_numpy()))

        def scored(b, qid, mat):
            ids = b.column(0).to_numpy()
            s = np.round(mat @ np.array(b.column(1).to_pylist(), np.float64).T, digits)
            s[qid[:, None] == ids[None, :]] = -np.inf
            return ids, s

        def best(batches, held=held):
            qid, mat, label = held.value
            for b in batches:
                if b.num_rows:
                    ids, s = scored(b, qid, mat)
                    s[label[:, None] != b.column(2).to_numpy()[None, :]] = -np.inf
                    order = np.argsort(ids, kind="stable")
                    at = order[np.argmax(s[:, order], axis=1)]
                    top = s[np.arange(len(qid)), at]
                    ok = top > -np.inf
                    yield pa.RecordBatch.from_arrays([pa.array(qid[ok]), pa.array(-top[ok]), pa.array(ids[at][ok])], ["query_id", "neg", "doc_id"])

        own = corpus.select("doc_id", "vector", "label").mapInArrow(best, "query_id bigint, neg double, doc_id bigint")
        own = {r["query_id"]: r["b"] for r in own.groupBy("query_id").agg(F.min(F.struct("neg", "doc_id")).alias("b")).toArrow().to_pylist()}
        top = np.array([-own[i]["neg"] if i in own else np.nan for i in qid.tolist()])
        doc = np.array([own[i]["doc_id"] if i in own else -1 for i in qid.tolist()])
        held2 = spark.sparkContext.broadcast((qid, mat, top, doc))

        def ahead(batches, held2=held2):
            qid, mat, top, doc = held2.value
            for b in batches:
                if b.num_rows:
                    ids, s = scored(b, qid, mat)
                    beat = (s > top[:, None]) | ((s == top[:, None]) & (ids[None, :] < doc[:, None]))
                    yield pa.RecordBatch.from_arrays([pa.array(qid), pa.array(beat.sum(axis=1))], ["query_id", "n"])

        c = corpus.select("doc_id", "vector").mapInArrow(ahead, "query_id bigint, n bigint").groupBy("query_id").agg(F.sum("n").alias("n"))
        lost = F.array(*[F.lit(int(i)) for i in qid[np.isnan(top)]]).cast("array<bigint>")
        c = c.select("query_id", F.when(~F.array_contains(lost, F.col("query_id")), F.col("n") + 1).alias("rank"))
        out = c if out is None else out.unionByName(c)
    return out


def ranked(scored: DataFrame, query: str, doc: str, score: str = "score") -> DataFrame:
    """0-based position of each document in its query's list, ties by id. Lists are numbered by ranges, so that none is sorted in one task."""
    x = scored.select(query, doc, score).withColumn("_neg", -F.col(score))
    return positions(x, [query], ["_neg", doc]).drop("_neg")


def reciprocal_rank_fusion(lists: list[DataFrame], query: str, doc: str, k: int = 60) -> DataFrame:
    """query, doc, `score`: sum of 1 / (k + position + 1) over the lists (query, doc, position)."""
    u = None
    for x in lists:
        p = x.select(query, doc, (F.lit(1.0) / (k + F.col("position") + 1)).alias("part"))
        u = p if u is None else u.unionByName(p)
    return u.groupBy(query, doc).agg(F.sum("part").alias("score"))


def metrics(ranks: DataFrame, by: list[str] | None = None, ks: tuple = (1, 5, 10), depth: int = 10) -> DataFrame:
    """recall@k, mrr and ndcg of `rank` (1-based, null is a miss), one relevant group per query."""
    r = F.col("rank")
    aggs = [F.avg(F.coalesce((r <= k).cast("double"), F.lit(0.0))).alias(f"recall_{k}") for k in ks]
    aggs.append(F.avg(F.when(r <= depth, 1 / r).otherwise(0.0)).alias(f"mrr_{depth}"))
    aggs.append(F.avg(F.when(r <= depth, 1 / F.log2(r + 1)).otherwise(0.0)).alias(f"ndcg_{depth}"))
    aggs.append(F.count("*").alias("n_queries"))
    return (ranks.groupBy(*by) if by else ranks.groupBy()).agg(*aggs)


def ir_metrics(ranks: DataFrame, ks: tuple = (1, 3, 5, 10), depth: int = 10, map_depth: int = 100) -> DataFrame:
    """accuracy, precision and recall at each k, mrr, ndcg and map, with one relevant document per query."""
    r = F.col("rank")
    aggs = []
    for k in ks:
        hit = F.coalesce((r <= k).cast("double"), F.lit(0.0))
        aggs += [F.avg(hit).alias(f"accuracy_{k}"), (F.avg(hit) / k).alias(f"precision_{k}"), F.avg(hit).alias(f"recall_{k}")]
    aggs.append(F.avg(F.when(r <= depth, 1 / r).otherwise(0.0)).alias(f"mrr_{depth}"))
    aggs.append(F.avg(F.when(r <= depth, 1 / F.log2(r + 1)).otherwise(0.0)).alias(f"ndcg_{depth}"))
    aggs.append(F.avg(F.when(r <= map_depth, 1 / r).otherwise(0.0)).alias(f"map_{map_depth}"))
    return ranks.agg(*aggs)


def bootstrap(ranks: DataFrame, draws: int = 1000, seed: int = 42, k: int = 10) -> DataFrame:
    """Point estimate and 2.5 / 97.5 percent bounds of recall@k and mrr@k by resampling queries.

    ranks: `query_id`, `rank`. Draw and position give the index of the resampled query by a
    hash, so the result is the same on any cluster; one distributed aggregation over draws
    x queries, joined to the ranks by position.
    """
    n = ranks.count()
    spark = ranks.sparkSession
    if not n:
        return spark.createDataFrame([], "metric string, value double, lo double, hi double")
    at = positions(ranks.select("query_id", "rank"), [], ["query_id"], "pos").select(F.col("pos").cast("bigint"), "rank")
    hit = F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))
    mrr = F.when(F.col("rank") <= k, 1 / F.col("rank")).otherwise(0.0)
    at = at.select("pos", hit.alias("hit"), mrr.alias("mrr"))
    grid = spark.range(draws * n).select((F.col("id") / F.lit(n)).cast("bigint").alias("draw"), (F.col("id") % n).alias("slot"))
    pick = grid.select("draw", (seeded(seed, F.col("draw"), F.col("slot")) % n).alias("pos"))
    per = pick.join(at, "pos").groupBy("draw").agg(F.avg("hit").alias("hit"), F.avg("mrr").alias("mrr"))
    low, high = F.lit(0.025), F.lit(0.975)
    ci = per.agg(*[F.percentile(c, p).alias(f"{c}_{x}") for c in ("hit", "mrr") for x, p in (("lo", low), ("hi", high))])
    point = at.agg(F.avg("hit").alias("hit"), F.avg("mrr").alias("mrr"))
    both = point.crossJoin(ci)  # one row each
    rows = F.array(*[F.struct(F.lit(f"{name}_{k}").alias("metric"), F.col(c).alias("value"), F.col(f"{c}_lo").alias("lo"), F.col(f"{c}_hi").alias("hi")) for name, c in (("recall", "hit"), ("mrr", "mrr"))])
    return both.select(F.inline(rows))
