from hypothesis import given, settings
from hypothesis import strategies as st

from lexloom.operators import chunking as K

N = K.SignTokens()
words = st.lists(st.text("가나다 .", min_size=1, max_size=30), max_size=12)


@settings(max_examples=60, deadline=None)
@given(words, st.integers(5, 40))
def test_pack_keeps_order_and_budget(units, budget):
    units = [u for u in units if N(u) <= budget]
    out = K.pack(units, budget, N)
    assert "\n".join(out) == "\n".join(units)
    assert all(N(b) <= budget for b in out)
    assert all(N(b) <= budget for b in K.pack(units, budget, N, 4))


@settings(max_examples=60, deadline=None)
@given(st.text("가나 .?", max_size=300), st.integers(2, 20), st.integers(0, 1))
def test_windows_fit_and_cover(text, budget, overlap):
    out = K.windows(text, budget, N, overlap)
    assert all(N(w) <= budget for w in out)
    assert sum(map(N, out)) >= N(text)


def test_overlap_carries_last_units():
    assert K.pack(["a b", "c d", "e f"], 4, N, 2) == ["a b\nc d", "c d\ne f"]


def test_case_pairs_numbered_issues():
    r = K.ChunkRules(max_tokens=40)
    assert K.case_bodies("[p]", "[1] 가 [2] 나", "[2] 라 [1] 다", r) == ["판시사항: 가\n판결요지: 다", "판시사항: 나\n판결요지: 라"]
    assert len(K.case_bodies("[p]", "[1] 가 [2] 나", "[1] 다", r)) == 1
    assert K.issues("가 [1] 나") == {} and K.issues("[1] 가 [2] 나") == {1: "가", 2: "나"}


def test_statute_repeats_lead():
    tree = [{"no": "①", "text": "머리 문장", "deleted": False, "items": [{"no": str(i), "text": "하나 둘 셋 넷", "deleted": False, "subitems": []} for i in range(6)]}]
    text = "x " * 100
    out = K.statute_bodies("[p]", text, tree, K.ChunkRules(max_tokens=24))
    assert len(out) > 1 and all(b.startswith("① 머리 문장\n") for b in out)


def test_chunk_documents(spark):
    schema = (
        "doc_id string, doc_type string, title string, source_url string, prefix string, text string, holding string, summary string, "
        "paragraphs array<struct<no:string,text:string,deleted:boolean,items:array<struct<no:string,text:string,deleted:boolean,subitems:array<struct<no:string,text:string,deleted:boolean>>>>>>"
    )
    rows = [("law:1:1", "law", "t", "u", "[t]", "짧다", None, None, None), ("precedent:1", "precedent", "t", "u", "[t]", None, "가. " * 900, "나", None), ("law:1:2", "law", "t", "u", "[t]", None, None, None, None)]
    out = K.chunk_documents(spark.createDataFrame(rows, schema))
    assert K.over_budget(out, 480).count() == 0
    got = {r["chunk_id"]: r for r in out.collect()}
    assert got["law:1:1#0"]["text"] == "[t]\n짧다" and got["precedent:1#1"]["part"] == 2 and got["law:1:2#0"]["n_parts"] == 1
    assert K.chunk_documents(spark.createDataFrame([], schema)).count() == 0
