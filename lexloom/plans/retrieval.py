"""Queries on retrieval: BM25, dense search, fusion, metrics and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.text import words
from lexloom.operators import bm25
from lexloom.operators import ranking as R
from lexloom.operators import vectors as V
from lexloom.plans.pairs import candidates, questions
from lexloom.runtime import materialize, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
K = 10


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


WORDS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"


def bm25_sql(corpus: str, queries: str) -> str:
    """CTEs up to sc(qk, dk, score). corpus: rows dk, text; queries: rows qk, text."""
    return f"""co as (select dk, coalesce({WORDS.format('text')}, []) as t from ({corpus})),
    qu as (select qk, unnest({WORDS.format('text')}) as w from ({queries})),
    st as (select count(*) as n, avg(len(t)) as al from co),
    po as (select dk, len, w, count(*) as tf from (select dk, len(t) as len, unnest(t) as w from co) group by all),
    df as (select w, count(*) as df from po group by w),
    ri as (select w, ln(n - df + 0.5) - ln(df + 0.5) as r from df, st),
    id as (select w, case when r < 0 then 0.25 * (select avg(r) from ri) else r end as idf from ri),
    qt as (select qk, w, count(*) as qf from qu group by all),
    sc as (select qk, dk, round(sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / al))), 6) as score from qt join id using (w) join po using (w), st group by qk, dk)"""


DOCS_BENCH = bm25_sql("select doc_id as dk, text from documents", "select item_id as qk, text from benchmark")


@query(f"with {DOCS_BENCH} select qk as item_id, r as rank, dk as doc_id, score from (select *, row_number() over (partition by qk order by score desc, dk) as r from sc) where r <= {K}")
def bm25_topk(s: SparkSession, d: str) -> DataFrame:
    """Flagship: the ten best documents for each held-out passage."""
    corpus = bm25.tokens(table(s, d, "documents"), "doc_id", "text")
    queries = bm25.tokens(table(s, d, "benchmark"), "item_id", "text")
    return bm25.search(corpus, queries, "doc_id", "item_id", K)


TEST_Q = """select qid as qk, regexp_extract(qid, '^(.+)#\\d+\\|q\\d+$', 1) as g, arg_max(question, ingested_at) as text from queries_raw
    where regexp_replace(lower(split), '[^a-z]', '', 'g') = 'test' group by qid"""
Q_CHUNKS = bm25_sql("select chunk_id as dk, any_value(text) as text from chunks group by chunk_id", TEST_Q)
RANKS = f"""{Q_CHUNKS}, tq as ({TEST_Q}), ch as (select distinct chunk_id as dk, group_id as g from chunks),
    al as (select tq.qk, tq.g as tg, ch.dk, ch.g, coalesce(score, 0) as score from tq cross join ch left join sc on sc.qk = tq.qk and sc.dk = ch.dk),
    rk as (select qk, tg, g, row_number() over (partition by qk order by score desc, dk) as r from al),
    ranks as (select qk as qid, min(case when g = tg then r end) as rank from rk group by qk)"""


def source_ranks(s, d, q: DataFrame) -> DataFrame:
    """`qid` and the rank of its source document (any of its chunks) among all chunks. q: qid, group_id, question."""
    c = table(s, d, "chunks").groupBy("chunk_id").agg(F.any_value("text").alias("text"), F.any_value("group_id").alias("group_id"))
    terms = lambda t: F.coalesce(words(F.col(t)), F.array().cast("array<string>")).alias("terms")
    c = materialize(c.select("chunk_id", "group_id", terms("text")), "chunk-terms")
    return bm25.source_rank(c, q.select("qid", "group_id", terms("question")), "chunk_id", "qid", "group_id")


def test_ranks(s, d) -> DataFrame:
    return source_ranks(s, d, questions(s, d).where("split = 'test'").select("qid", "group_id", "question"))


@query(f"with {RANKS} select qid, rank from ranks")
def bm25_group_rank(s, d):
    """Rank of the source document among all chunks for each test question."""
    return test_ranks(s, d)


M = lambda r: ", ".join([f"round(avg(case when {r} <= {k} then 1.0 else 0 end), 6) as recall_{k}" for k in (1, 5, 10)]) + f", round(avg(case when {r} <= 10 then 1 / {r} else 0 end), 6) as mrr_10, round(avg(case when {r} <= 10 then 1 / log2({r} + 1) else 0 end), 6) as ndcg_10, count(*) as n_queries"


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(f"with {RANKS} select {M('rank')} from ranks")
def retrieval_metrics(s, d):
    return rounded(R.metrics(test_ranks(s, d)))


HASHED = """vw as (select k, w.place as j, count(*) as n from (select k, {{'place': ('0x' || substr(md5(unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'))), 1, 4))::int % 64}} as w from ({rows})) group by all),
    vl as (select k, sqrt(sum(n * n)) as len from vw group by k), {name} as (select vw.k, j, n / len as x from vw join vl using (k))"""


def hashed_sql(rows: str, name: str) -> str:
    """CTE name(k, j, x) with the places of the default encoder's vectors. rows: k, text."""
    return HASHED.format(rows=rows, name=name).replace("vw", f"{name}_w").replace("vl", f"{name}_l")


BOTH_RANKS = f"""{RANKS}, {hashed_sql("select qk as k, 'query: ' || text as text from tq", "qv")}, {hashed_sql("select dk as k, 'passage: ' || text as text from co0", "cv")},
    vs as (select qv.k as qk, cv.k as dk, round(sum(qv.x * cv.x), 6) as score from qv join cv using (j) group by all),
    va as (select tq.qk, tq.g as tg, ch.dk, ch.g, coalesce(score, 0) as score from tq cross join ch left join vs on vs.qk = tq.qk and vs.dk = ch.dk),
    vr as (select qk as qid, min(case when g = tg then r end) as dense from (select qk, tg, g, row_number() over (partition by qk order by score desc, dk) as r from va) group by qk)"""
BOTH_RANKS = "co0 as (select chunk_id as dk, any_value(text) as text from chunks group by chunk_id), " + BOTH_RANKS


def dense_source_ranks(s, d, q: DataFrame) -> DataFrame:
    """As source_ranks, by the vectors of the default encoder with its prefixes."""
    c = table(s, d, "chunks").groupBy(F.col("chunk_id").alias("doc_id")).agg(F.any_value("group_id").alias("label"), F.any_value("text").alias("text"))
    c = materialize(V.encode(c, "text", "passage: "), "chunk-vectors")
    q = materialize(V.encode(q.select(F.col("qid").alias("query_id"), F.col("group_id").alias("label"), "question"), "question", "query: "), "question-vectors")
    return V.source_ranks(q, c).select(F.col("query_id").alias("qid"), F.col("rank").alias("dense"))


def both_ranks(s, d, q: DataFrame) -> DataFrame:
    """`qid`, `bm25`, `dense`, and whether the better of the two is among the first 20 (`passed`)."""
    r = source_ranks(s, d, q).select("qid", F.col("rank").alias("bm25")).join(dense_source_ranks(s, d, q), "qid")
    return r.withColumn("passed", F.coalesce(F.least("bm25", "dense") <= 20, F.lit(False)))


@query(f"with {BOTH_RANKS} select ranks.qid, rank as bm25, dense, coalesce(least(rank, dense) <= 20, false) as passed from ranks join vr on vr.qid = ranks.qid")
def test_source_ranks(s, d):
    """Rank of the source document of each test question by BM25 and by vectors, and the round-trip flag; recorded, not enforced."""
    return both_ranks(s, d, questions(s, d).where("split = 'test'").select("qid", "group_id", "question"))


FLAGS = ", ".join(f"round(avg(case when {c} <= {k} then 1.0 else 0 end), 4) as {c}_recall_{k}" for c in ("bm25", "dense") for k in (1, 20))


def round_trip_shares(r: DataFrame) -> DataFrame:
    share = lambda c: F.round(F.avg(F.coalesce(c.cast("double"), F.lit(0.0))), 4)
    return r.agg(share(F.col("passed")).alias("pass_rate"), *[share(F.col(c) <= k).alias(f"{c}_recall_{k}") for c in ("bm25", "dense") for k in (1, 20)], F.count("*").alias("n_questions"))


@query(
    f"""with {BOTH_RANKS}, b as (select rank as bm25, dense from ranks join vr on vr.qid = ranks.qid)
    select round(avg(case when least(bm25, dense) <= 20 then 1.0 else 0 end), 4) as pass_rate, {FLAGS}, count(*) as n_questions from b"""
)
def round_trip(s, d):
    """Share of test questions whose source is among the first 20 by either system, and the recalls of both."""
    return round_trip_shares(test_source_ranks(s, d))


@query()
def candidate_ranks(s, d):
    """Ranks of the source document, and the round-trip flag, for each candidate question of every split."""
    q = candidates(s, d)
    return both_ranks(s, d, q).join(q.select("qid", "split"), "qid")


@query()
def candidate_round_trip(s, d):
    """round_trip over all candidate questions of every split."""
    return round_trip_shares(candidate_ranks(s, d))


# hybrid


DEPTH = 100
TITLES = "select doc_id as qk, title as text from documents where doc_id % 50 = 0 and title is not null"
HYBRID = f"""{bm25_sql("select doc_id as dk, text from documents", TITLES)},
    {hashed_sql(f"select qk as k, 'query: ' || text as text from ({TITLES})", "qv")}, {hashed_sql("select doc_id as k, 'passage: ' || coalesce(text, '') as text from documents", "cv")},
    vs as (select qv.k as qk, cv.k as dk, round(sum(qv.x * cv.x), 6) as score from qv join cv using (j) group by all),
    va as (select q.qk, documents.doc_id as dk, coalesce(vs.score, 0) as score from ({TITLES}) q cross join documents left join vs on vs.qk = q.qk and vs.dk = documents.doc_id),
    li as (select *, row_number() over (partition by qk order by score desc, dk) as r from sc union all select *, row_number() over (partition by qk order by score desc, dk) as r from va),
    fu as (select qk, dk, round(sum(1.0 / (60 + r)), 6) as score from li where r <= {DEPTH} group by all),
    fr as (select *, row_number() over (partition by qk order by score desc, dk) as r from fu)"""


def hybrid_lists(s, d) -> DataFrame:
    """Fused lists: the first DEPTH documents by BM25 and by vectors for the title of every document whose id is divisible by 50, fused by reciprocal rank."""
    docs = table(s, d, "documents")
    titles = docs.where("doc_id % 50 = 0 and title is not null").select(F.col("doc_id").alias("query_id"), "title")
    words_ = bm25.search(bm25.tokens(docs, "doc_id", "text"), bm25.tokens(titles, "query_id", "title"), "doc_id", "query_id", DEPTH)
    vec = materialize(V.encode(docs.select("doc_id", "text"), "text", "passage: "), "document-vectors")
    dense = R.dense_top_k(V.encode(titles, "title", "query: "), vec, DEPTH)
    lists = [x.select("query_id", "doc_id", (F.col("rank") - 1).alias("position")) for x in (words_, dense)]
    return R.reciprocal_rank_fusion(lists, "query_id", "doc_id")


@query(f"with {HYBRID} select qk as query_id, r as rank, dk as doc_id, score from fr where r <= {K}")
def hybrid_topk(s, d):
    """The ten best documents by fusion of BM25 and vectors."""
    return bm25.top_k(hybrid_lists(s, d), "query_id", "doc_id", K)


@query(
    f"""with {HYBRID}, own as (select q.doc_id as qk, d.doc_id as dk from documents q join documents d on q.doc_key = d.doc_key where q.doc_id % 50 = 0 and q.title is not null),
    rk as (select own.qk, min(r) as rank from own left join fr using (qk, dk) group by own.qk) select {M('rank')} from rk"""
)
def hybrid_metrics(s, d):
    """Metrics of the fusion: the rank of the query's own article or case, under whichever id; a miss beyond the lists."""
    docs = table(s, d, "documents").select("doc_id", "doc_key", "title")
    q = docs.where("doc_id % 50 = 0 and title is not null").select(F.col("doc_id").alias("query_id"), "doc_key")
    own = q.join(docs.select("doc_id", "doc_key"), "doc_key").select("query_id", "doc_id")
    f = bm25.top_k(hybrid_lists(s, d), "query_id", "doc_id", 2 * DEPTH)
    ranks = own.join(f, ["query_id", "doc_id"], "left").groupBy("query_id").agg(F.min("rank").alias("rank"))
    return rounded(R.metrics(ranks))


# dense


DOT = "list_inner_product(cast(a.{v} as double[]), cast(b.{v} as double[]))"


def dense_sql(v: str = "embedding", half: bool = False) -> str:
    cut = "embedding[1:32]" if half else "embedding"
    return f"""ev as (select vec_id, label, cast({cut} as double[]) as e from embeddings),
    ds as (select a.vec_id as q, b.vec_id as dd, a.label as ql, b.label as dl, round(list_inner_product(a.e, b.e), 6) as score from ev a, ev b where a.vec_id % 50 = 0 and a.vec_id <> b.vec_id)"""


def vectors(s, d, half: bool = False) -> tuple[DataFrame, DataFrame]:
    """Queries (every id divisible by 50) and the whole corpus; `half` is a second encoder, of the first 32 places."""
    e = table(s, d, "embeddings")
    v = F.slice("embedding", 1, 32) if half else F.col("embedding")
    c = e.select(F.col("vec_id").alias("doc_id"), v.alias("vector"), "label")
    return c.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "vector", "label"), c


def dense_lists(s, d, k: int, half: bool = False) -> DataFrame:
    q, c = vectors(s, d, half)
    return R.dense_top_k(q, c, k + 1, keep=F.col("query_id") != F.col("doc_id")).where(F.col("rank") <= k)


@query(f"with {dense_sql()} select q as query_id, r as rank, dd as doc_id, score from (select *, row_number() over (partition by q order by score desc, dd) as r from ds) where r <= {K}")
def dense_topk(s, d):
    """The ten nearest vectors of every query vector, itself left out."""
    return dense_lists(s, d, K)


def dense_scores(s, d, half: bool = False) -> DataFrame:
    """Full lists: every document for every query but itself, by blocks."""
    return R.dense_scores(*vectors(s, d, half)).where("query_id <> doc_id")


def dense_ranks(s, d, half: bool = False) -> DataFrame:
    """Rank of the first document of the query's own group (label)."""
    return R.dense_group_rank(*vectors(s, d, half))


DENSE_RANKS = lambda half=False: f"{dense_sql(half=half)}, rk as (select *, row_number() over (partition by q order by score desc, dd) as r from ds), ranks as (select q as query_id, min(case when ql = dl then r end) as rank from rk group by q)"


@query(f"with {DENSE_RANKS()} select query_id, rank from ranks")
def dense_group_rank(s, d):
    return dense_ranks(s, d)


@query(
    "with " + DENSE_RANKS() + ", i as (select * from ranks) select "
    + ", ".join(f"round(avg(case when rank <= {k} then 1.0 else 0 end), 6) as accuracy_{k}, round(avg(case when rank <= {k} then 1.0 else 0 end) / {k}, 6) as precision_{k}, round(avg(case when rank <= {k} then 1.0 else 0 end), 6) as recall_{k}" for k in (1, 3, 5, 10))
    + ", round(avg(case when rank <= 10 then 1 / rank else 0 end), 6) as mrr_10, round(avg(case when rank <= 10 then 1 / log2(rank + 1) else 0 end), 6) as ndcg_10, round(avg(case when rank <= 100 then 1 / rank else 0 end), 6) as map_100 from i"
)
def val_ir_metrics(s, d):
    return rounded(R.ir_metrics(dense_ranks(s, d)))


def boot_sql(half: bool = False) -> str:
    return f"""with {DENSE_RANKS(half)}, atr as (select row_number() over (order by query_id) - 1 as pos, case when rank <= 10 then 1.0 else 0 end::double as hit, case when rank <= 10 then 1 / rank else 0 end::double as mrr from ranks),
    nn as (select count(*) as n from atr),
    pk as (select dr, ('0x' || substr(md5('42|' || dr || '|' || sl), 1, 8))::bigint % n as pos from range(1000) a(dr), nn, lateral (select unnest(range(n)) as sl) b),
    pe as (select dr, avg(hit) as hit, avg(mrr) as mrr from pk join atr using (pos) group by dr)
    select 'recall_10' as metric, round((select avg(hit) from atr), 6) as value, round(quantile_cont(hit, 0.025), 6) as lo, round(quantile_cont(hit, 0.975), 6) as hi from pe
    union all select 'mrr_10', round((select avg(mrr) from atr), 6), round(quantile_cont(mrr, 0.025), 6), round(quantile_cont(mrr, 0.975), 6) from pe"""


@query(boot_sql())
def bootstrap_ci(s, d):
    return rounded(R.bootstrap(materialize(dense_ranks(s, d), "ranks")))


@query(f"select 'dense_full' as system, * from ({boot_sql()}) union all select 'dense_half', * from ({boot_sql(True)})")
def metric_bars(s, d):
    """Bars of a chart of systems: each metric with its bounds."""
    out = None
    for name, half in (("dense_full", False), ("dense_half", True)):
        x = rounded(R.bootstrap(materialize(dense_ranks(s, d, half), "ranks"))).select(F.lit(name).alias("system"), "*")
        out = x if out is None else out.unionByName(x)
    return out


FUSED = f"""{dense_sql()}, d2 as (select a.vec_id as q, b.vec_id as dd, round(list_inner_product(cast(a.embedding[1:32] as double[]), cast(b.embedding[1:32] as double[])), 6) as score from embeddings a, embeddings b where a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
    l1 as (select q, dd, row_number() over (partition by q order by score desc, dd) - 1 as p from ds), l2 as (select q, dd, row_number() over (partition by q order by score desc, dd) - 1 as p from d2),
    fu as (select q, dd, round(sum(1.0 / (60 + p + 1)), 6) as score from (select * from l1 union all select * from l2) group by q, dd)"""


def fused(s, d) -> DataFrame:
    lists = [R.ranked(dense_scores(s, d, half), "query_id", "doc_id") for half in (False, True)]
    return R.reciprocal_rank_fusion(lists, "query_id", "doc_id")


@query(f"with {FUSED} select q as query_id, r as rank, dd as doc_id, score from (select *, row_number() over (partition by q order by score desc, dd) as r from fu) where r <= {K}")
def rrf_fusion(s, d):
    """Fusion of two full rankings, every document in each."""
    return bm25.top_k(fused(s, d), "query_id", "doc_id", K)


SYSTEMS = f"""with {DENSE_RANKS()}, h as (select a.vec_id as q, b.vec_id as dd, a.label as ql, b.label as dl, round(list_inner_product(cast(a.embedding[1:32] as double[]), cast(b.embedding[1:32] as double[])), 6) as score from embeddings a, embeddings b where a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
    hr as (select *, row_number() over (partition by q order by score desc, dd) as r from h), ranks2 as (select q as query_id, min(case when ql = dl then r end) as rank from hr group by q),
    m as (select 'dense_full' as system, {M('rank')} from ranks union all select 'dense_half', {M('rank')} from ranks2)"""


@query(f"{SYSTEMS} select * from m")
def system_metrics(s, d):
    out = None
    for name, half in (("dense_full", False), ("dense_half", True)):
        x = rounded(R.metrics(dense_ranks(s, d, half))).select(F.lit(name).alias("system"), "*")
        out = x if out is None else out.unionByName(x)
    return out


@query(f"{SYSTEMS} select arg_max(system, recall_10 - case when system = 'dense_half' then 1e-9 else 0 end) as system from m")
def best_system(s, d):
    """The system of the best recall@10; the first on a tie."""
    m = system_metrics(s, d)
    return m.agg(F.max_by("system", F.struct("recall_10", -F.ascii(F.substring("system", 7, 1)))).alias("system"))


COMPARE = f"""with {FUSED}, a as (select q, dd from l1 where p = 0), b as (select q, dd from l2 where p = 0), e as (select vec_id, label from embeddings)"""


@query(
    f"""{COMPARE} select a.q as query_id, a.dd as base_top, b.dd as other_top, ea.label = eq.label as base_correct, eb.label = eq.label as other_correct, a.dd <> b.dd as differs
    from a join b on a.q = b.q join e ea on ea.vec_id = a.dd join e eb on eb.vec_id = b.dd join e eq on eq.vec_id = a.q"""
)
def demo_compare(s, d):
    """First hits of two systems side by side, and whether each is of the query's group."""
    lab = table(s, d, "embeddings").select("vec_id", "label")
    q = lab.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own"))
    out = q
    for name, half in (("base", False), ("other", True)):
        t = dense_lists(s, d, 1, half).select("query_id", F.col("doc_id").alias(f"{name}_top"))
        t = t.join(lab.select(F.col("vec_id").alias(f"{name}_top"), F.col("label").alias(f"{name}_label")), f"{name}_top")
        out = out.join(t, "query_id")
    return out.select("query_id", "base_top", "other_top", (F.col("base_label") == F.col("own")).alias("base_correct"), (F.col("other_label") == F.col("own")).alias("other_correct"), (F.col("base_top") != F.col("other_top")).alias("differs"))


@query(
    f"""{COMPARE}, x as (select a.dd <> b.dd as differs, ea.label = eq.label as bc, eb.label = eq.label as oc from a join b on a.q = b.q join e ea on ea.vec_id = a.dd join e eb on eb.vec_id = b.dd join e eq on eq.vec_id = a.q)
    select count(*) as n, count(case when differs then 1 end) as n_differ, count(case when bc then 1 end) as base_hits, count(case when oc then 1 end) as other_hits from x"""
)
def demo_counts(s, d):
    x = demo_compare(s, d)
    return x.agg(F.count("*").alias("n"), F.count_if("differs").alias("n_differ"), F.count_if("base_correct").alias("base_hits"), F.count_if("other_correct").alias("other_hits"))


@query(
    f"""{COMPARE} select a.q as query_id, a.dd as base_top, b.dd as other_top from a join b on a.q = b.q join e ea on ea.vec_id = a.dd join e eb on eb.vec_id = b.dd join e eq on eq.vec_id = a.q
    where a.dd <> b.dd and (ea.label = eq.label) <> (eb.label = eq.label)"""
)
def top1_differs(s, d):
    """Queries whose first hits differ and where only one of them is right."""
    return demo_compare(s, d).where("differs and base_correct <> other_correct").select("query_id", "base_top", "other_top")
