"""Data set shapes, registrations, replays and publishing."""

import gzip
import json

import pytest

from arborspark.operators import gates
from arborspark.sources import datasets


def paper(k, unanswerable):
    answers = [{"answer": {"unanswerable": u, "free_form_answer": "", "extractive_spans": [], "yes_no": None, "evidence": ["para", "FLOAT SELECTED: Table 1"]}} for u in unanswerable]
    return {"title": f"T{k}", "abstract": "a", "full_text": [{"section_name": "S", "paragraphs": ["para", "two"]}], "qas": [{"question_id": f"q{k}", "question": "why", "answers": answers}]}


def test_papers(spark, tmp_path):
    data = {"p1": paper(1, [True, True]), "p2": paper(2, [True, False]), "p3": paper(3, [False]), "p4": paper(4, [])}
    (tmp_path / "papers.json").write_text(json.dumps(data))
    rows = datasets.papers(spark, str(tmp_path / "papers.json"))
    kinds = {r["question_id"]: (r["kind"], r["n_answers"]) for r in datasets.questions(rows).collect()}
    assert kinds == {"q1": ("unanswerable", 2), "q2": ("mixed", 2), "q3": ("answerable", 1), "q4": ("answerable", 0)}
    got = datasets.evidence(rows).collect()
    assert len(got) == 10 and sum(r["is_float"] for r in got) == 5


def test_articles_and_contexts(spark, tmp_path):
    row = {"article_id": "a", "title": "t", "article": "text more", "questions": [{"question_unique_id": "u1", "question": "q", "options": ["x", "y"], "gold_label": 1, "difficult": 1}]}
    (tmp_path / "a.jsonl").write_text(json.dumps(row, ensure_ascii=False) + "\n" + json.dumps({**row, "questions": []}, ensure_ascii=False) + "\n")
    got = datasets.articles(spark, str(tmp_path / "a.jsonl")).collect()
    assert [(r["question_id"], r["label"], r["hard"]) for r in got] == [("u1", 1, True)]
    (tmp_path / "b.jsonl").write_text(json.dumps(row) + "\n" + json.dumps({**row, "article": "other"}) + "\n")
    with pytest.raises(ValueError, match="different texts"):
        datasets.articles(spark, str(tmp_path / "b.jsonl"))
    (tmp_path / "c.json").write_text(json.dumps([{"_id": str(k), "context": "same" if k < 2 else "else", "question": "q", "domain": "d", "difficulty": "easy", "length": "short"} for k in range(3)]))
    assert len({r["cluster"] for r in datasets.contexts(spark, str(tmp_path / "c.json")).collect()}) == 2


def test_gates_open_once(spark, tmp_path):
    items = spark.range(4).selectExpr("cast(id as string) as id")
    scores = spark.createDataFrame([(str(k), m, float(v + k)) for k in range(4) for m, v in (("a", 1), ("b", 2), ("base", 0))], "id string, method string, score double")
    gate = gates.Gate(str(tmp_path / "gate"))
    with pytest.raises(ValueError):
        gate.open(items)
    with pytest.raises(ValueError):
        gate.register({"a": {"x": 1}, "b": {"x": 1}}, {"base": {}}, items)
    gate.register({"a": {"x": 1}, "b": {"x": 2}}, {"base": {}}, items)
    gate.register({"a": {"x": 1}, "b": {"x": 2}}, {"base": {}}, items)
    with pytest.raises((ValueError, FileExistsError)):
        gate.register({"a": {"x": 3}}, {"base": {}}, items)
    with pytest.raises(ValueError, match="items"):
        gate.open(items.limit(2))
    gate.open(items)
    with pytest.raises(ValueError, match="every"):
        gate.freeze(scores.where("method <> 'base'"))
    assert gate.freeze(scores)["winner"] == "b" and gate.verify(scores)
    assert not gate.verify(scores.selectExpr("id", "method", "score + 1 as score"))


def test_replay_finds_differences(spark):
    a = spark.createDataFrame([("x", 1.0, None), ("y", 2.0, 3.0), ("z", 1.0, 1.0)], "id string, p double, q double")
    b = spark.createDataFrame([("x", 1.0 + 1e-14, None), ("y", 2.1, 3.0)], "id string, p double, q double")
    got = {(r["id"], r["value"]) for r in gates.replay(a, b, ["id"], ["p", "q"]).collect()}
    assert got == {("y", "p"), ("z", "p"), ("z", "q")}


def test_publishing_checks_coverage(spark, tmp_path):
    runs = {"one": spark.createDataFrame([("1", "m0", 0.5), ("2", "m0", 0.5)], "id string, method string, score double"), "two": spark.createDataFrame([("1", "m1", 0.5), ("2", "m1", 0.1), ("1", "debug", 0.0)], "id string, method string, score double")}
    files = gates.published(runs, {"m0": "Base", "m1": "New"}, str(tmp_path / "out")).collect()
    rows = [json.loads(line) for f in (tmp_path / "out").glob("*.json.gz") for line in gzip.open(f, "rt")]
    assert {(r["id"], r["method"]) for r in rows} == {(i, m) for i in "12" for m in ("Base", "New")} and all(len(f["sha256"]) == 64 for f in files)
    with pytest.raises(ValueError):
        gates.published({"one": runs["one"].limit(1), "two": runs["two"]}, {"m0": "Base", "m1": "New"}, str(tmp_path / "no"))


def test_equal_requests_are_asked_once(spark):
    df = spark.createDataFrame([("1", "q", "c", "m0"), ("1", "q", "c", "m1"), ("2", "q", "c", "m0"), ("1", "q", "d", "m2")], "id string, question string, context string, method string")
    asked, uses = gates.shared_predictions(df, ["id", "question", "context"])
    assert asked.count() == 3 and uses.count() == 4 and uses.select("request_key").distinct().count() == 3
