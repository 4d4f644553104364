"""Round trips of sources, sinks, settings and the incremental index."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from arborspark.operators import parse, segment, tree
from arborspark.plans.config import Config, Segmentation
from arborspark.sources import tables
from arborspark.streaming.incremental import index_new_documents


def test_whole_texts_keep_line_ends(spark, tmp_path):
    (tmp_path / "a.md").write_bytes("# A\r\nß\r\n".encode())
    assert tables.whole_texts(spark, f"file://{tmp_path}/a.md").first()["text"] == "# A\r\nß\r\n"
    assert len(tables.checksums(spark, f"file://{tmp_path}/a.md").first()["sha256"]) == 64


def test_json_lines_are_cut_at_newlines_only(spark, tmp_path):
    with gzip.open(tmp_path / "x.jsonl.gz", "wt", encoding="utf-8") as f:
        f.writelines(json.dumps({"id": k, "t": "a b"}, ensure_ascii=False) + "\n" for k in range(3))
    got = tables.json_lines(spark, f"file://{tmp_path}/x.jsonl.gz", "id int, t string").collect()
    assert [(r["id"], r["t"]) for r in got] == [(k, "a b") for k in range(3)]


def test_index_round_trip_and_check(spark, tmp_path):
    docs = spark.createDataFrame([(1, "One. Two.\nThree other words.")], "doc_id long, text string")
    units = parse.line_units(docs)
    cuts = segment.anchor_drop(units)
    nodes = tree.build(units, segment.groups(units, cuts), parse.sentences(units, ["doc_id", "paragraph"]))
    path = f"file://{tmp_path}/index"
    tables.write_index({"units": units, "nodes": nodes, "decisions": cuts}, path)
    back = tables.read_index(spark, path, tree.violations)
    assert sorted(map(tuple, back["nodes"].collect()), key=repr) == sorted(map(tuple, nodes.collect()), key=repr)
    bad = nodes.withColumn("end", F.when(F.col("kind") == "sentence", 999).otherwise(F.col("end")))
    tables.write_index({"units": units, "nodes": bad, "decisions": cuts}, path + "2")
    with pytest.raises(ValueError, match="not sound"):
        tables.read_index(spark, path + "2", tree.violations)


def test_vectors_are_made_once(spark, tmp_path):
    seen = []

    def embed(missing):
        seen.append(missing.count())
        return missing.select("key", F.array(F.length("text").cast("double")).alias("embedding"))

    texts = spark.createDataFrame([("a",), ("bb",), ("a",)], "t string")
    for _ in range(2):
        got = tables.with_vectors(texts, "t", embed, f"file://{tmp_path}/cache", "m", 1).collect()
        assert sorted((r["t"], r["embedding"][0]) for r in got) == [("a", 1.0), ("a", 1.0), ("bb", 2.0)]
    assert seen == [2, 0]


def test_answer_kinds(spark):
    rows = spark.createDataFrame([(1, True), (1, False), (2, True), (3, False)], "question_id long, unanswerable boolean")
    assert {tuple(r) for r in tables.answerability(rows).collect()} == {(1, "mixed"), (2, "unanswerable"), (3, "answerable")}


def test_settings_are_strict(tmp_path):
    c = Config(Segmentation(prior=0.9))
    c.save(f"{tmp_path}/c.json")
    assert Config.load(f"{tmp_path}/c.json") == c
    with pytest.raises(FileExistsError):
        Config().save(f"{tmp_path}/c.json")
    with pytest.raises(ValueError):
        Config.from_dict({"segmentation": {"nope": 1}})
    with pytest.raises(ValueError):
        Segmentation(prior=1.0)


def test_incremental_index_reads_each_file_once(spark, tmp_path):
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    for k in range(2):
        spark.createDataFrame([(k, f"Text {k}. More.")], "doc_id long, text string").write.mode("append").parquet(source)
        index_new_documents(spark, source, "doc_id long, text string", out, f"{tmp_path}/state").awaitTermination(60)
    assert spark.read.parquet(f"{out}/units").count() == 2
    assert spark.read.parquet(f"{out}/sentences").count() == 4
