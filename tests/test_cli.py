"""Steps of the command line on small tables."""

import pytest

from lexloom import cli
from lexloom.operators import asking, pairs, providers


def test_collect_and_parse(spark, tmp_path):
    laws = tmp_path / "in" / "가법"
    laws.mkdir(parents=True)
    (laws / "법률.md").write_text("---\n제목: 가법\n법령ID: '1'\n---\n##### 제1조 (목적)\n**①** 하나\n", encoding="utf-8")
    assert cli.main(["collect", "--data", str(tmp_path / "in"), "--out", str(tmp_path / "out")]) == 0
    assert "| 가법 | 1 |" in (tmp_path / "out" / "SOURCES.md").read_text() or "1 |" in (tmp_path / "out" / "SOURCES.md").read_text()
    assert cli.main(["parse", "--data", str(tmp_path / "in"), "--out", str(tmp_path / "out")]) == 0
    r = spark.read.parquet(str(tmp_path / "out" / "documents.parquet")).collect()
    assert [(x["doc_id"], x["text"]) for x in r] == [("law:1:1", "① 하나")]


def test_generate_judge_and_samples(spark, data, tmp_path):
    out = str(tmp_path)
    for step, name in (("generate", "generated"), ("judge", "judged")):
        assert cli.main([step, "--data", data, "--out", out, "--limit", "5"]) == 0
        assert spark.read.parquet(f"{out}/{name}").count() <= 10
    assert cli.main(["samples", "--data", data, "--out", out, "--limit", "3"]) == 0
    assert (tmp_path / "samples.md").read_text(encoding="utf-8").count("\n## ") == 3


def test_finalize_is_refused_while_incomplete(spark, data, tmp_path):
    with pytest.raises(pairs.Incomplete):
        cli.main(["finalize", "--data", data, "--out", str(tmp_path)])
    assert cli.main(["finalize", "--data", data, "--out", str(tmp_path), "--finalize"]) == 0


@pytest.mark.parametrize("model", ["bm25", "dense"])
def test_evaluate(spark, data, tmp_path, model):
    assert cli.main(["evaluate", "--data", data, "--out", str(tmp_path), "--model", model]) == 0
    assert spark.read.parquet(f"{tmp_path}/metrics.parquet").first()["system"] == model


def test_answers_are_checked():
    with pytest.raises(ValueError):
        asking.check_verdicts({"results": [{"id": 0, "verdict": "perhaps"}]})
    with pytest.raises(KeyError):
        asking.check_questions({"results": [{"id": 0}]})
    assert asking._by_number({"results": [{"id": "1", "v": 1}, {"id": 1, "v": 2}, {"id": "x"}, {"id": 9}]}, 2) == {1: {"v": 1}}
    assert providers.json_schema(asking.JUDGMENTS)["additionalProperties"] is False
