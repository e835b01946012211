from lexloom.operators import pairs


def test_one_document_owns_the_pool(spark):
    rows = [(f"q{i}", f"c{i}", "big") for i in range(3000)] + [("x", "cx", "small")]
    q = spark.createDataFrame(rows, "qid string, chunk_id string, group_id string")
    group = {c: g for _, c, g in rows}
    got = pairs.wrong_pairs(q, 10).collect()
    assert len({r["qid"] for r in got}) == 10
    assert all(group[r["chunk_id"]] != group[r["wrong_chunk_id"]] for r in got)
