import random

from pyspark.sql import functions as F

from lexloom.functions import text as X
from lexloom.operators import audit, dedup
from lexloom.runtime import materialize


def grams(s):
    s = "".join(c for c in s if c.isalnum())
    return {s[i : i + 3] for i in range(max(1, len(s) - 2))}


def jac(a, b):
    return len(a & b) / len(a | b)


def rows(n=120, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        if out and r.random() < 0.5:
            s = list(r.choice(out)[1])
            for _ in range(r.randint(0, 2)):
                s[r.randrange(len(s))] = r.choice("가나다라마")
            out.append((f"q{i:03d}", "".join(s)))
        else:
            out.append((f"q{i:03d}", "".join(r.choice("가나다라마바사아") for _ in range(r.randint(1, 40)))))
    return out


def test_jaccard_against_brute_force(spark):
    data = rows()
    df = spark.createDataFrame([*data, ("n1", None)], "qid string, question string").where("question is not null")
    least, copies = {}, {}
    for k, x in data:
        n = "".join(c for c in x if c.isalnum())
        least.setdefault(n, k)
        copies[least[n]] = copies.get(least[n], 0) + 1
    names = set(least.values())
    want = {(a, b, copies[a], copies[b]) for a, x in data for b, y in data if a < b and {a, b} <= names and jac(grams(x), grams(y)) >= 0.8}
    for hot in (4096, 3):
        sets = materialize(dedup.class_grams(dedup.text_classes(df, "qid", "question").select("cls", "t").distinct()), "test")
        assert dedup.jaccard_pairs(sets, "cls", 0.8, hot=hot).count() == len(want)
    got = {(r["a"], r["b"], r["copies_a"], r["copies_b"]) for r in dedup.similar_texts(df, "qid", "question", 0.8).collect()}
    assert got == want and want


def test_greedy_scan(spark):
    data = rows(150, 3)
    prio = {k: i % 3 for i, (k, _) in enumerate(data)}
    df = spark.createDataFrame(data, "qid string, question string")
    nodes = spark.createDataFrame([*prio.items(), ("null", 0)], "qid string, priority int").join(df, "qid", "left")
    got = {r["qid"]: r["duplicate_of"] for r in dedup.greedy_dedup(nodes, "qid", "question", 0.7).collect()}
    assert got.pop("null") is None
    kept, want, text = [], {}, dict(data)
    for k in sorted(text, key=lambda k: (prio[k], k)):
        hit = next((x for x in kept if jac(grams(text[k]), grams(text[x])) >= 0.7), None)
        want[k] = hit
        if hit is None:
            kept.append(k)
    assert got == want and any(want.values())


def test_chain_keeps_both_ends(spark):
    nodes = spark.createDataFrame([("a", 0), ("b", 0), ("c", 0), ("d", 0)], "k string, priority int")
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "a string, b string")
    assert {r["k"]: r["duplicate_of"] for r in dedup.greedy_keep(nodes, edges, "k").collect()} == {"a": None, "b": "a", "c": None, "d": None}


def test_long_chain_is_settled(spark):
    n = 25
    nodes = spark.createDataFrame([(f"k{i:03d}", 0) for i in range(n)], "k string, priority int")
    edges = spark.createDataFrame([(f"k{i:03d}", f"k{i + 1:03d}") for i in range(n - 1)], "a string, b string")
    got = {r["k"]: r["duplicate_of"] for r in dedup.greedy_keep(nodes, edges, "k").collect()}
    assert got == {f"k{i:03d}": f"k{i - 1:03d}" if i % 2 else None for i in range(n)}


def test_ngram_edges(spark):
    df = spark.createDataFrame([("ab",), ("",), ("abcd",), ("a b-c",)], "s string")
    assert [sorted(r[0]) for r in df.select(X.ngrams(X.norm(F.col("s")))).collect()] == [["ab"], [""], ["abc", "bcd"], ["abc"]]


def test_audit(spark):
    q = spark.createDataFrame(
        [("q1", "가나다라마바사아", "c1", "g1", "train"), ("q2", "가나다라마바사아", "c2", "g2", "test"), ("q3", "전혀다른질문입니다", "c3", "g1", "test")],
        "qid string, question string, chunk_id string, group_id string, split string",
    )
    c = spark.createDataFrame([("c1", "t"), ("c2", "t"), ("c3", "u")], "chunk_id string, text string")
    s = spark.createDataFrame([("g1", "train"), ("g2", "test")], "group_id string, split string")
    rep = {r["check_name"]: r["n_found"] for r in audit.report(q, c, s).collect()}
    assert rep == {"group_overlap": 1, "chunk_overlap": 0, "identical_text": 1, "near_duplicate_questions": 1, "split_mislabel": 1}
    assert audit.verdict(audit.report(q, c, s)).first()["verdict"] == "FAIL"
