"""Searches keep the postings of their passages where they are: only the best of each question leave a task."""

import math

import pytest
from pyspark.sql import functions as F

from arborspark.operators import lexical, parse


def brute(passages, questions, limit, k1=1.2, b=0.75):
    words = {k: t.split() for k, t in passages}
    mean, out = sum(map(len, words.values())) / len(words), []
    df = {t: sum(t in w for w in words.values()) for _, q in questions for t in q.split()}
    for name, q in questions:
        found = []
        for k, w in words.items():
            tfs = [(t, w.count(t)) for t in sorted(set(q.split())) if t in w]
            if tfs:
                found.append((-round(sum(math.log(1 + (len(words) - df[t] + 0.5) / (df[t] + 0.5)) * n * (k1 + 1) / (n + k1 * (1 - b + b * len(w) / mean)) for t, n in tfs), 6), k))
        out += [(name, k, -s, i + 1) for i, (s, k) in enumerate(sorted(found)[:limit])]
    return sorted(out)


@pytest.mark.parametrize("block", [1, 2048])
@pytest.mark.parametrize("tile", [16, 1 << 21])
def test_no_postings_are_written(spark, monkeypatch, block, tile):
    monkeypatch.setattr(lexical, "BLOCK", block, raising=False)
    monkeypatch.setattr(lexical, "TILE", tile, raising=False)
    rows, inner = [], lexical.written
    monkeypatch.setattr(lexical, "written", lambda df: rows.append(df.count()) or inner(df))
    passages = [(f"p{i % 89}-{i}", " ".join(["common"] * (1 + i % 3) + [f"w{i % 7}", f"w{i % 11}", f"x{i}"])) for i in range(700)]
    questions = [("a", "common w3"), ("b", "w5 w9 common common"), ("c", "nowhere"), ("d", "x17 w1"), ("e", "")]
    df = spark.createDataFrame(passages, "k string, text string").repartition(3)
    got = lexical.bm25(df, ["k"], "text", spark.createDataFrame(questions, "id string, text string"), "id", "text", 5)
    assert sorted((r["question"], r["k"], r["score"], r["rank"]) for r in got.collect()) == brute(passages, questions, 5)
    assert sum(rows) <= 5 * len(questions)  # one row for each passage, and one for each asked word in it


def test_units_and_hits_shuffle_no_text(spark):
    docs = spark.createDataFrame([(1, "one\n\n  \ntwo ß\n"), (2, None), (3, "")], "doc_id bigint, text string")
    units = parse.line_units(docs)
    assert sorted(tuple(r) for r in units.collect()) == [(1, 0, 0, 3, "one"), (1, 1, 8, 13, "two ß")]
    assert "Exchange" not in units._jdf.queryExecution().executedPlan().toString()
    hits = units.select("doc_id", "paragraph", F.lit("q").alias("question"))
    found = lexical.with_passages(hits, units, ["doc_id", "paragraph"])
    assert found.count() == 2 and "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
