"""Scripted cases: block reading, probability rules, boundary decisions, packing, unions, wins."""

import math

import pytest
from pyspark.sql import functions as F

from arborspark.functions import probability as P
from arborspark.operators import fusion, metrics, pack, parse, search, segment, select, splits, tree


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_probability_rules(spark):
    assert one(spark, P.posterior_same(F.lit(0.5), 0.7)) == pytest.approx(0.7)
    assert one(spark, P.adjust_probability(F.lit(0.2), 0.8, 0.2)) == pytest.approx(0.8)
    assert one(spark, P.adjust_probability(F.lit(0.3), 0.5, 0.5)) == pytest.approx(0.3)
    assert one(spark, P.adjust_probability(F.lit(1.0), 0.9)) == 1.0
    near = P.separation(F.lit(0.40), F.lit(0.30), F.lit(0.50), 0.5)
    assert one(spark, near["score"]) == pytest.approx(0.20) and one(spark, near["accept_split"])
    far = P.separation(F.lit(0.75), F.lit(0.25), F.lit(0.50), 0.5)
    assert one(spark, far["score"]) == 1.0
    assert one(spark, P.separation(F.lit(0.4), F.lit(0.3), F.lit(0.01), 0.5)["status"]) == "insufficient_parent_reference"
    assert not math.isnan(one(spark, P.posterior_same(F.lit(0.0))))


def test_blocks_of_markdown():
    text = "# A #\r\nsome text\r\nmore\r\n\r\n~~~\n# code\n~~~\nTitle\n---\n  last para  \n```\nopen"
    blocks = parse.BlockReader().read(text)
    assert [(b[0], b[3], b[4], b[5]) for b in blocks] == [("heading", "A", 1, False), ("paragraph", "", 0, False), ("paragraph", "", 0, True), ("heading", "Title", 2, False), ("paragraph", "", 0, False), ("paragraph", "", 0, True)]
    assert text[blocks[1][1] : blocks[1][2]] == "some text\r\nmore"
    assert text[blocks[4][1] : blocks[4][2]] == "last para" and text[blocks[5][1] : blocks[5][2]] == "```\nopen"
    assert parse.BlockReader().read("") == []


def test_sentence_offsets_are_code_points(spark):
    text = "Wow! 😀 ok。 \"Yes.\" tail"
    units = spark.createDataFrame([(1, 0, 10, text), (2, 0, 0, "   ")], "doc_id long, paragraph long, start long, text string")
    got = parse.sentences(units, ["doc_id", "paragraph"]).orderBy("start").collect()
    assert [text[r["start"] - 10 : r["end"] - 10] for r in got] == ["Wow!", "😀 ok。", '"Yes."', "tail"]


def test_outside_in_order(spark):
    for n, want in ((5, [0, 4, 1, 3, 2]), (4, [0, 3, 1, 2])):
        rows = spark.range(n).select(F.lit(1).alias("g"), "id")
        assert [r["id"] for r in segment.outside_in(rows, ["g"], "id").orderBy("visit").collect()] == want


def test_budget_misses_the_middle(spark):
    rows = spark.createDataFrame([(1, i, s) for i, s in enumerate([0.1, 0.2, 0.9, 0.2, 0.3])], "g int, i long, score double")
    assert segment.representatives(rows, ["g"], "i").first()["i"] == 2
    assert segment.representatives(rows, ["g"], "i", budget=2).first()["i"] == 4
    assert segment.representatives(rows, ["g"], "i", stop=0.3).first()["visited"] == 2


def test_single_unit_documents_have_no_decisions(spark):
    units = spark.createDataFrame([(1, 0, "only one"), (2, 0, "a b c"), (2, 1, "x y z"), (2, 2, "x y z")], "doc_id long, paragraph long, text string")
    got = segment.anchor_drop(units, 0.7).orderBy("paragraph").collect()
    assert [(r["doc_id"], r["paragraph"], r["cut"], r["anchor"]) for r in got] == [(2, 1, True, 0), (2, 2, False, 1)]
    topics = segment.groups(units, segment.anchor_drop(units, 0.7)).collect()
    assert {(r["doc_id"], r["paragraph"], r["topic"]) for r in topics} == {(1, 0, 0), (2, 0, 0), (2, 1, 1), (2, 2, 1)}


def test_packing_passes_over_what_does_not_fit(spark):
    items = spark.createDataFrame([("q", "a", 1, 5), ("q", "b", 2, 9), ("q", "c", 3, 4), ("q", "a", 4, 5)], "q string, item string, rank long, cost long")
    got = {r["item"]: r["taken"] for r in pack.packed(items, "q", "item", "rank", "cost", 10).collect()}
    assert got == {"a": True, "b": False, "c": True}
    assert [r["item"] for r in pack.first_that_fit(items.where("rank < 4"), "q", "rank", "cost", 10).collect()] == ["a"]


def test_span_union_joins_touching_spans(spark):
    spans = spark.createDataFrame([(1, 0, 5), (1, 5, 7), (1, 9, 12), (1, 3, 4), (2, 0, 1)], "d int, start long, end long")
    assert {tuple(r) for r in fusion.span_union(spans, ["d"]).collect()} == {(1, 0, 7), (1, 9, 12), (2, 0, 1)}


def test_pairs_must_agree_both_ways(spark):
    cards = spark.createDataFrame([("q", "a", 1, 0.9), ("q", "b", 2, 0.1), ("q", "c", 3, 0.9)], "q string, item string, rank long, s double")
    got = select.pairwise_wins(cards, "q", "item", "rank", lambda a, b: F.lit(0.5) + (a["s"] - b["s"]) / 2, threshold=0.6).orderBy("rank").collect()
    assert [(r["item"], r["wins"]) for r in got] == [("a", 1.5), ("c", 1.5), ("b", 0.0)]


def test_greedy_coverage_prefers_new_needs():
    assert select.greedy_coverage("", [[0.9, 0.0], [0.8, 0.0], [0.0, 0.5]], [0.9, 0.8, 0.5], [1, 1, 1], 2) == [0, 2]
    assert select.greedy_coverage("", [], [], [], 5) == []


def test_metrics_take_the_best_reference(spark):
    predicted = spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], "q string, item string, place long")
    refs = spark.createDataFrame([("q", 0, "a"), ("q", 0, "c"), ("q", 1, "b")], "q string, ref int, item string")
    row = metrics.paragraph_metrics(predicted, refs, "q", "item", "place").first()
    assert (row["precision"], row["recall"], row["complete"]) == (0.5, 1.0, 1.0)


def test_duplicate_groups_are_transitive(spark):
    rows = spark.createDataFrame([(1, "x", "p"), (2, "x", "q"), (3, "y", "q"), (4, "z", None), (5, None, None)], "id long, a string, b string")
    assert {tuple(r) for r in splits.duplicate_groups(rows, "id", ["a", "b"]).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 5)}


def test_tree_violations_are_found(spark):
    nodes = spark.createDataFrame([("d", "root", None, "document", 0, 10, 0), ("d", "p0", "root", "paragraph", 0, 12, 1), ("d", "p1", "root", "paragraph", 5, 8, 1), ("d", "p2", "gone", "paragraph", 5, 8, 1)], "doc_id string, node_id string, parent_id string, kind string, start long, end long, depth long")
    got = {r["rule"]: r["n"] for r in tree.violations(nodes).collect()}
    assert got == {"repeated_id": 0, "missing_parent": 1, "outside_parent": 1, "overlap": 1}


def test_resumed_search_opens_deferred_nodes(spark):
    rows = [("d", "b0", "root", "section", 0, 1, 0.9), ("d", "b1", "root", "section", 5, 1, 0.8), ("d", "p0", "b0", "paragraph", 0, 2, 0.5), ("d", "p1", "b1", "paragraph", 5, 2, 0.6)]
    nodes = spark.createDataFrame(rows, "doc_id string, node_id string, parent_id string, kind string, start long, depth long, score double")
    got = [r["node_id"] for r in search.resumed(nodes, width=1, accept=0.1, budget=10).orderBy("step").collect()]
    assert got == ["p0", "p1"]
    assert [r["node_id"] for r in search.resumed(nodes, 1, 0.1, 3).collect()] == ["p0"]
