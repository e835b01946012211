"""Ranks and round trip over all candidate questions, against a greedy scan and DuckDB."""

import os
from collections import Counter, defaultdict

import duckdb
import pytest

from lexloom.plans import pairs, registry
from lexloom.plans.retrieval import bm25_sql


@pytest.fixture(scope="module")
def expected(data):
    """qid -> (split, rank)."""
    c = duckdb.connect()
    for f in os.listdir(data):
        c.execute(f"create view {f[:-8]} as select * from '{data}/{f}'")
    rows = c.execute(f"with {pairs.Q} select qid, group_id, question, split from qs where {pairs.DROP} is null").fetchall()
    near = defaultdict(set)
    for a, b in c.execute(f"with {pairs.GRAMS} select a, b from ed").fetchall():
        near[a].add(b)
        near[b].add(a)
    kept = {}
    for qid, group, text, split in sorted(rows, key=lambda r: (pairs.PRIORITY.get(r[3], 3), r[0])):
        if not near[qid] & kept.keys():
            kept[qid] = (group, text, split)
    assert 0 < len(kept) < len(rows)
    c.execute("create table kept (qk varchar, g varchar, text varchar)")
    c.executemany("insert into kept values (?, ?, ?)", [(k, g, t) for k, (g, t, _) in kept.items()])
    ranks = c.execute(
        f"""with {bm25_sql("select chunk_id as dk, any_value(text) as text from chunks group by chunk_id", "select qk, text from kept")},
        ch as (select distinct chunk_id as dk, group_id as g from chunks),
        rk as (select k.qk, k.g = ch.g as own, row_number() over (partition by k.qk order by coalesce(score, 0) desc, ch.dk) as r
            from kept k cross join ch left join sc on sc.qk = k.qk and sc.dk = ch.dk)
        select qk, min(case when own then r end) from rk group by qk"""
    ).fetchall()
    return {k: (kept[k][2], r) for k, r in ranks}


def test_candidate_ranks(spark, data, expected):
    got = {r["qid"]: (r["split"], r["bm25"]) for r in registry.queries()["candidate_ranks"](spark, data).collect()}
    assert got == expected
    n = Counter(s for s, _ in got.values())
    assert n["train"] > n["test"] > 0 and n["val"] > 0


def test_candidate_round_trip(spark, data, expected):
    rows = registry.queries()["candidate_ranks"](spark, data).collect()
    share = lambda of: round(sum(of) / len(of), 4)
    got = registry.queries()["candidate_round_trip"](spark, data).first().asDict()
    for name, ranks in (("bm25", [r for _, r in expected.values()]), ("dense", [r["dense"] for r in rows])):
        for k in (1, 20):
            assert got.pop(f"{name}_recall_{k}") == share([r is not None and r <= k for r in ranks])
    best = [min((x for x in (r["bm25"], r["dense"]) if x is not None), default=None) for r in rows]
    assert got == {"pass_rate": share([r is not None and r <= 20 for r in best]), "n_questions": len(expected)}


def test_questions_without_split_come_last(spark, tmp_path):
    d = str(tmp_path)
    text = "퇴직금은 언제까지 지급해야 하나요"
    rows = [("g#0|q1", text, None), ("g#0|q2", text, "Train"), ("g#0|q3", "연차휴가를 쓰지 못하면 수당을 받나요", None), ("g#0|q4", "짧다", "test")]
    q = spark.createDataFrame(rows, "qid string, question string, split string")
    q.selectExpr("*", "'g#0' as chunk_id", "'law' as doc_type", "timestamp'2024-01-01' as ingested_at").write.parquet(f"{d}/queries_raw.parquet")
    assert {(r["qid"], r["split"]) for r in pairs.candidates(spark, d).collect()} == {("g#0|q2", "train"), ("g#0|q3", None)}
