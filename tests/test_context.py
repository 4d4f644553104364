"""Scripted cases: heading paths, budgets over unions of spans, promotion."""

import pytest
from pyspark.sql import functions as F

from arborspark.operators import context


def test_only_neighbouring_headings_share_a_path(spark):
    rows = [(1, 0, "A"), (1, 1, "A ::: B"), (1, 2, "A ::: B"), (1, 3, "C"), (1, 4, "A ::: B"), (1, 5, None), (1, 6, "A ::: D"), (1, 7, "X :::  ::: Y")]
    got = context.heading_tree(spark.createDataFrame(rows, "d long, o long, t string"), "d", "o", "t").orderBy("first", "depth").collect()
    assert [(r["title"], r["depth"], r["parent_id"], r["implicit"], r["first"], r["last"]) for r in got] == [
        ("A", 0, "root", False, 0, 2),
        ("B", 1, "h0.0", False, 1, 1),
        ("B", 1, "h0.0", False, 2, 2),
        ("C", 0, "root", False, 3, 3),
        ("A", 0, "root", True, 4, 4),
        ("B", 1, "h4.0", False, 4, 4),
        ("A", 0, "root", True, 6, 6),
        ("D", 1, "h6.0", False, 6, 6),
        ("X :::  ::: Y", 0, "root", False, 7, 7),
    ]


def test_the_union_of_spans_is_priced(spark):
    spans = spark.createDataFrame([(1, 1, 0, 7), (1, 2, 4, 11), (1, 3, 0, 19), (1, 4, 16, 19), (2, 1, 0, 3)], "doc_id long, rank long, start long, end long")
    texts = spark.createDataFrame([(1, "one two three four five"), (2, None)], "doc_id long, text string")
    got = context.fit_spans(spans, texts, 4).orderBy("doc_id", "rank").collect()
    # "one two", then " two thr" within it, then all four words, then a span that lies inside
    assert [(r["taken"], r["used"]) for r in got] == [(True, 2), (True, 3), (True, 4), (True, 4), (True, 0)]
    tight = context.fit_spans(spans, texts, 3).where("doc_id = 1").orderBy("rank").collect()
    assert [r["taken"] for r in tight] == [True, True, False, False]
    assert context.fit_spans(spans.limit(0), texts, 3).count() == 0


def test_only_a_sure_challenger_is_promoted(spark):
    # x stays first; b surely beats a, c does not; after that a is the first one left
    cards = spark.createDataFrame([("q", "x", 1, 0.0), ("q", "a", 2, 0.0), ("q", "b", 3, 0.85), ("q", "c", 4, 0.79), ("r", "only", 1, 0.9)], "q string, i string, p long, v double")
    better = lambda a, b: F.when(a["v"] >= b["v"], a["v"]).otherwise(1 - b["v"])
    got = context.promoted(cards, "q", "i", "p", better, k=3).orderBy("q", "rank").collect()
    assert [(r["i"], r["selected"]) for r in got] == [("x", True), ("b", True), ("a", True), ("c", False), ("only", True)]
    whole = context.promoted(cards, "q", "i", "p", better, k=1).where("q = 'q'").orderBy("rank").collect()
    assert [r["i"] for r in whole] == ["x", "a", "b", "c"]
    with pytest.raises(ValueError):
        context.promoted(cards, "q", "i", "p", better, threshold=0.5)
