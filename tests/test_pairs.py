import pytest
from pyspark.sql import functions as F

from lexloom.functions import text as X
from lexloom.operators import pairs, versions
from lexloom.streaming import resume


def test_rules(spark):
    q = ["짧다", "일곱글자다요오", "여덟글자입니다요오", "only english words here", "한글에 人이 섞인 질문입니다", "제 3 조가 궁금한 질문입니다", None]
    df = spark.createDataFrame([(x,) for x in q], "q string").select(pairs.rule_cascade(F.col("q")))
    assert [r[0] for r in df.collect()] == ["too_short", "too_short", None, "not_korean", "chinese_chars", "article_number", "too_short"]


def test_clean(spark):
    s = "소정(所定)의 **굵은** \\[1\\] <개정 2018.3.20> <img src=x>─┌ 글　자 가"
    df = spark.createDataFrame([(s,), (None,), ("",)], "s string").select(X.clean(F.col("s")))
    assert [r[0] for r in df.collect()] == ["소정의 굵은 [1] 글 자 가", None, ""]


def test_finalize_guards_yaml_booleans(spark):
    df = spark.createDataFrame([("q", "judged", "yes")], "qid string, judge_status string, verdict string")
    assert pairs.finalize(df, ["yes"]).count() == 1
    for bad in ([True], [], ["maybe"]):
        with pytest.raises(ValueError):
            pairs.finalize(df, bad)


def test_last_verdict_wins(spark):
    q = spark.createDataFrame([("a", "train"), ("b", "train"), ("c", "test")], "qid string, split string")
    j = spark.createDataFrame([("a", "no", None, "m", 1), ("a", "yes", None, "m", 2), ("c", "no", None, "m", 1)], "qid string, verdict string, reason string, judge_model string, created_at int")
    got = {r["qid"]: (r["verdict"], r["judge_status"]) for r in pairs.judged(q, j).collect()}
    assert got == {"a": ("yes", "judged"), "b": (None, "unjudged"), "c": ("no", "not_applicable")}


def test_wrong_pairs(spark):
    q = spark.createDataFrame([(f"q{i}", f"c{i}", f"g{i % 3}") for i in range(30)], "qid string, chunk_id string, group_id string")
    got = pairs.wrong_pairs(q, 10).collect()
    assert len(got) == 10 and all(int(r["chunk_id"][1:]) % 3 != int(r["wrong_chunk_id"][1:]) % 3 for r in got)


def test_stratified_groups(spark):
    g = spark.createDataFrame([(f"g{i}", "a" if i < 45 else "b", i % 20 == 0) for i in range(100)], "group_id string, stratum string, forced boolean")
    got = pairs.stratified_groups(g).collect()
    assert len(got) == 100 and len({r["group_id"] for r in got}) == 100
    n = {(s, x): sum(r["stratum"] == s and r["split"] == x for r in got) for s in "ab" for x in ("train", "val", "test")}
    assert n["a", "test"] == n["a", "val"] == 4 and n["b", "test"] == 5
    assert all(r["split"] == "train" for r in got if int(r["group_id"][1:]) % 20 == 0)


def test_versions(spark):
    rows = [("k", 1, "2010-01-01", "old"), ("k", 2, "2012-01-01", "in force"), ("k", 3, "2030-01-01", "future"), ("k", 4, None, "odd"), ("x", 1, "2040-01-01", "none")]
    df = spark.createDataFrame(rows, "key string, t int, e string, v string")
    got = {r["key"]: (r["version"], r["n_skipped"], r["pin_failed"]) for r in versions.in_force(df, "key", F.col("t"), F.to_date("e"), "2020-01-01", F.col("v")).collect()}
    assert got == {"k": ("in force", 2, False), "x": (None, 1, True)}


def test_stream_resumes(spark, tmp_path):
    src, log, cp = str(tmp_path / "in"), str(tmp_path / "log"), str(tmp_path / "cp")
    schema = "k string, ts timestamp, v int"
    put = lambda rows: spark.createDataFrame(rows, "k string, t string, v int").select("k", F.to_timestamp("t").alias("ts"), "v").coalesce(1).write.mode("append").parquet(src)
    put([("a", "2024-01-01 00:00:00", 1), ("b", "2024-01-01 00:01:00", 2), ("a", "2024-01-01 00:02:00", 3)])
    resume.stream_once(spark, src, schema, "k", "ts", log, cp)
    put([("b", "2024-01-01 00:03:00", 4), ("c", "2024-01-01 00:04:00", 5)])
    resume.stream_once(spark, src, schema, "k", "ts", log, cp)
    got = spark.read.parquet(log)
    assert sorted(r["k"] for r in got.collect()) == ["a", "b", "c"]
    assert resume.latest(got, "k", "ts").count() == 3
    assert resume.todo(spark.createDataFrame([("a",), ("z",)], "k string"), got, "k").collect()[0]["k"] == "z"
    seen = []
    resume.stream_batches(spark, src, schema, lambda df, i: seen.append(df.count()), str(tmp_path / "cp2"))
    assert sum(seen) == 5
