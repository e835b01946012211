"""Every query of the core on small data, and against DuckDB where it has SQL."""

import os

import duckdb
import pytest

from lexloom.plans import registry

Q, SQL = registry.queries(), registry.oracle_sql()


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for f in os.listdir(data):
        c.execute(f"create view {f[:-8]} as select * from '{data}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(Q))
def test_query(spark, data, duck, name):
    df = Q[name](spark, data)
    got = [tuple(r) for r in df.collect()]
    assert len(set(df.columns)) == len(df.columns)
    if name in SQL:
        cur = duck.execute(SQL[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == sorted(df.columns)
        assert rows(df.columns, got) == rows(names, cur.fetchall())


def test_empty_tables(spark, data, tmp_path):
    for f in os.listdir(data):
        spark.read.parquet(f"{data}/{f}").limit(0).write.parquet(str(tmp_path / f))
    for name in ("p1_found", "bm25_topk", "norm_text", "rule_cascade", "jaccard_pairs", "in_force_version", "length_stats", "leakage_audit", "dense_topk"):
        n = Q[name](spark, str(tmp_path)).count()
        assert n == (5 if name == "leakage_audit" else 0), name
