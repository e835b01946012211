"""The pN_ queries on small data, and against DuckDB where there is SQL."""

import duckdb
import pytest

from lexloom.llm.registry import oracle_sql, queries

COLUMNS = {
    "p2_found": "qid_a qid_b", "p3_found": "field row_key", "p4_found": "field row_key", "p5_found": "field key_a key_b", "p6_found": "group_id",
    "p7_ids": "doc_id ids", "p8_found": "doc_id item_id", "p9_found": "doc_id shared_chars",
}


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, data, name):
    df = queries()[name](spark, data)
    got = [tuple(r) for r in df.collect()]
    if name in COLUMNS:
        assert df.columns == COLUMNS[name].split()
        assert name == "p7_ids" or len(got) == len(set(got))
    if name in oracle_sql():
        c = duckdb.connect()
        for t in ("documents", "chunks", "queries_raw", "benchmark", "splits"):
            c.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
        cur = c.execute(oracle_sql()[name])
        names = [x[0] for x in cur.description]
        assert sorted(got) == sorted(tuple(r[names.index(k)] for k in df.columns) for r in cur.fetchall())
