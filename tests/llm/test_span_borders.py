from lexloom.llm import contamination as C


def test_span_over_piece_borders_is_one_row(spark):
    # the document is cut into pieces of at most 100 characters; the item runs over several borders
    run = "".join(chr(0xAC00 + i) for i in range(300))
    docs = spark.createDataFrame([(1, "가나" * 30 + run + "다라" * 30), (1, "가나" * 30 + run + "다라" * 30), (2, run[:50])], "doc_id long, text string")
    items = spark.createDataFrame([(7, run)], "item_id long, text string")
    got = sorted(map(tuple, C.leaked_spans(docs, items, shard_chars=100).collect()))
    assert got == [(1, 7, 60, 360), (1, 7, 60, 360), (2, 7, 0, 50)]


def test_no_index_is_larger_than_a_shard(monkeypatch):
    import numpy as np

    pieces = list(C.cut_pieces(0, np.arange(10_000, dtype=np.uint32), 40, 1000))
    assert max(len(p[2]) for p in pieces) <= 1000
    starts = [s + k for _, s, c in pieces for k in range(len(c) - 39)]
    assert starts == list(range(10_000 - 39))
    assert list(C.cut_pieces(0, np.arange(39, dtype=np.uint32), 40, 1000)) == []


def test_span_over_a_piece_border_is_one_row(spark):
    item = "".join(chr(0xAC00 + i) for i in range(60))
    text = "가나다" * 10 + item + "라마바" * 20
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    it = spark.createDataFrame([(7, item)], "item_id bigint, text string")
    got = [tuple(r) for r in C.leaked_spans(df, it, min_chars=20, shard_chars=50).collect()]
    assert got == [(1, 7, 30, 90)]
