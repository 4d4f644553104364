"""Packets, rendered packing, chunks, model callbacks, resampling and the engine."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborspark.__main__ import parser
from arborspark.engine import Engine, Navigator, Policy
from arborspark.functions import arrays
from arborspark.operators import checks, chunks, metrics, models, packet


def test_running_values_and_scans(spark):
    r = random.Random(1)
    rows = [([r.randint(-9, 9) for _ in range(n)],) for n in (0, 1, 2, 3, 10, 99, 1000)]
    df = spark.createDataFrame(rows, "v array<int>")
    kind = "struct<x:int,total:int>"
    step = lambda at, x: ((at + x).cast("int"), F.struct(x.alias("x"), (at + x).cast("int").alias("total")))
    got = df.select("v", arrays.running(F.col("v"), lambda a, b: F.greatest(a, b), -100).alias("m"), arrays.scan(F.col("v"), F.lit(0), step, kind).alias("s")).collect()
    for g in got:
        assert g["m"] == [max(g["v"][: k + 1]) for k in range(len(g["v"]))]
        assert [tuple(x) for x in g["s"]] == [(x, sum(g["v"][: k + 1])) for k, x in enumerate(g["v"])]


UNITS = [(1, 0, 0, "A", "the following models:"), (1, 1, 0, "A", "first one"), (1, 2, 0, "A", "and the second"), (1, 3, 0, "A", "third " * 20), (1, 4, 1, "B", "which stands alone"), (1, 5, 1, "B", "ends,"), (1, 6, 1, "B", "after all")]


@pytest.fixture(scope="module")
def units(spark):
    return spark.createDataFrame(UNITS, "doc_id int, paragraph long, section int, heading string, text string")


def test_links_share_an_allowance(units):
    got = {(r["target"], r["context"]): (r["role"], r["omitted"]) for r in packet.links(units, allowance=30).collect()}
    assert got[1, 0] == ("active_source_introduction", False) and (1, 1) not in got
    assert got[2, 0][0] == "active_source_introduction" and got[2, 1] == ("preceding_source_paragraph", False)
    assert got[1, 2] == ("dependent_source_continuation", False) and got[2, 3] == ("following_source_paragraph", False)
    assert not any(t == 0 and c < 0 for t, c in got) and (4, 3) not in got
    assert got[5, 6][0] == "dependent_source_continuation" and got[0, 1][0] == "dependent_source_continuation"
    tight = {(r["target"], r["context"]): r["omitted"] for r in packet.links(units, allowance=21).collect()}
    assert tight[2, 0] is False and tight[2, 1] is True


def test_packets_grow_by_two_hops(spark, units):
    ranked = spark.createDataFrame([("q", 1, 1, 1)], "question string, doc_id int, paragraph long, rank long")
    found = packet.links(units)
    bare = {r["paragraph"]: r["is_target"] for r in packet.packet(ranked, found, "question", base=1).collect()}
    assert bare == {1: True, 0: False, 2: False}
    wide = {r["paragraph"]: (r["is_target"], r["hop"]) for r in packet.packet(ranked, found, "question", base=1, expand=True, most=3).collect()}
    assert wide[0] == (True, 1) and wide[2] == (True, 1) and wide[3] == (False, None)
    with pytest.raises(ValueError):
        packet.packet(ranked, found, "question", base=5, most=2)


count = lambda text: len(text.split())  # noqa: E731  a lambda goes to workers by value


def test_parents_take_over_where_they_are_covered():
    part = lambda k: {"item": f"p{k}", "start": 10 * k, "end": 10 * k + 9, "heading": "h", "text": f"w{k} x y"}
    top = {"item": "b", "start": 0, "end": 39, "heading": "h", "text": "all of the four parts"}
    held, grown = packet.merged("t", [part(0), part(1), part(3)], [top], count, 40)
    assert grown == ["b"] and held == [top]
    held, grown = packet.merged("t", [part(0), part(1)], [top], count, 14)
    assert grown == [] and len(held) == 2
    assert packet.merged("t", [part(0)], [top], count, 40)[1] == []
    with pytest.raises(ValueError):
        packet.merged("t", [part(0), {**part(0), "start": 5, "end": 12}], [], count, 40)
    assert packet.render("T", [(5, "b", "two"), (1, "a", "one")]) == "Title: T\n[1] a\none\n\n[2] b\ntwo"


def test_merged_contexts_of_tables(spark):
    ranked = spark.createDataFrame([("q", 1, f"p{k}", k + 1, 10 * k, 10 * k + 9, "h", f"w{k} x y") for k in (0, 1, 2)], "question string, doc_id int, item string, rank long, start long, end long, heading string, text string")
    parents = spark.createDataFrame([(1, "b", 0, 29, "h", "whole block text"), (1, "far", 100, 120, "h", "not held"), (2, "b", 0, 29, "h", "other")], "doc_id int, item string, start long, end long, heading string, text string")
    titles = spark.createDataFrame([(1, "T")], "doc_id int, title string")
    row = packet.merged_contexts(ranked, parents, titles, "question", 50, count).first()
    assert row["merged"] == ["b"] and row["context"] == "Title: T\n[1] h\nwhole block text" and row["used"] == count(row["context"])


def test_coverage_prefers_new_needs(spark):
    cards = [("a", 0, "h", "one two", 0.9, 0.9, 0.0), ("b", 10, "h", "one two", 0.8, 0.8, 0.0), ("c", 20, "h", "one two", 0.5, 0.0, 0.5)]
    df = spark.createDataFrame([("q", *c) for c in cards], "question string, item string, start long, heading string, text string, relevance double, n0 double, n1 double")
    titles = spark.createDataFrame([("q", "T")], "question string, title string")
    got = [r["item"] for r in packet.covered(df, titles, "question", ["n0", "n1"], 10, count).orderBy("place").collect()]
    assert got == ["a", "c"]
    assert packet.coverage("t", [], count, 5) == []


def test_cards_show_each_span_once(spark):
    nodes = [("root", None, "document", "Doc", 0, 40, None), ("h1", "root", "heading", "Head", 0, 40, None), ("s1", "h1", "section", "x", 8, 40, None), ("p1", "s1", "paragraph", "Paragraph 1", 8, 20, "One. Two."), ("p2", "s1", "paragraph", "Paragraph 2", 22, 40, "Three.")]
    df = spark.createDataFrame([(1, *n) for n in nodes], "doc_id int, node_id string, parent_id string, kind string, title string, start long, end long, text string")
    centrals = spark.createDataFrame([(1, "s1", 8, 12, "One."), (1, "p1", 8, 12, "One."), (1, "p2", 22, 28, "Three.")], "doc_id int, node_id string, start long, end long, text string")
    got = {r["node_id"]: r for r in packet.cards(df, centrals).collect()}
    assert [x["text"] for x in got["s1"]["excerpts"]] == ["One.", "Three."] and got["s1"]["heading_path"] == ["Head"]
    assert got["p1"]["excerpts"][0]["role"] == "full_source" and got["root"]["child_headings"] == ["Head"]
    assert got["p1"]["routing_text"] == "Head\nOne." and got["root"]["navigation_text"].endswith("\nHead")


def test_spans_split_at_token_ends(spark):
    text = "a bb  ccc dddd 😀 e\n"
    df = spark.createDataFrame([(1, 100, text), (2, 0, ""), (3, 0, "one")], "doc_id int, start long, text string")
    got = chunks.split_spans(df, ["doc_id"], most=2).orderBy("doc_id", "part").collect()
    own = [r for r in got if r["doc_id"] == 1]
    assert "".join(r["text"] for r in own) == text and all(r["cost"] <= 2 for r in own)
    assert all(text[r["start"] - 100 : r["end"] - 100] == r["text"] for r in own)
    assert [r["text"] for r in got if r["doc_id"] != 1] == ["one"]


def test_chunkings_side_by_side(spark):
    u = spark.createDataFrame([(1, k, 10 * k, 10 * k + 9, f"w{k} x y") for k in range(6)], "doc_id int, paragraph long, start long, end long, text string")
    one = u.selectExpr("doc_id", "paragraph", "0L as grp")
    two = u.selectExpr("doc_id", "paragraph", "paragraph div 2 as grp")
    got = {}
    for r in chunks.side_by_side(u, {"one": one, "two": two}, 7).collect():
        got.setdefault(r["chunking"], set()).add((r["start"], r["end"], r["cost"]))
    assert got["two"] == {(0, 19, 6), (20, 39, 6), (40, 59, 6)} == got["one"]


def test_callbacks_are_asked_once_for_equal_inputs(spark, tmp_path):
    seen = str(tmp_path / "seen")

    def answer(model, inputs):
        with open(seen, "a") as f:
            f.write("".join(f"{i['left']}|{i['right']}\n" for i in inputs))
        return [float(i["left"] == i["right"]) for i in inputs]

    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("a", "a"), (None, "b")], "l string, r string")
    got = sorted((r["l"] or "", r["r"], r["score"]) for r in models.pair_scores(df, "l", "r", answer).collect())
    assert got == [("", "b", 0.0), ("a", "a", 1.0), ("a", "a", 1.0), ("a", "b", 0.0)]
    assert len(open(seen).read().split("\n")) - 1 == 3
    with pytest.raises(Exception, match="not a score"):
        models.pair_scores(df, "l", "r", lambda m, xs: [2.0] * len(xs)).collect()
    with pytest.raises(Exception, match="answers"):
        models.pair_scores(df, "l", "r", lambda m, xs: []).collect()
    vec = models.embedded(df, "r", lambda m, xs: [[3.0, 4.0]] * len(xs), 2).first()["vector"]
    assert vec == pytest.approx([0.6, 0.8])
    assert models.reranked(df, "l", "r", models.yes(lambda t: 0.5)).first()["relevance"] == 0.5


def test_resampling_equals_numpy(spark):
    r = random.Random(4)
    rows = [("d", c, r.random(), r.random()) for c in range(20) for _ in range(r.randint(1, 5))]
    df = spark.createDataFrame(rows, "dataset string, cluster int, a double, b double")
    got = {x["value"]: x for x in metrics.resampled(df, ["dataset"], "cluster", ["a", "b"], draws=500).collect()}
    n = np.array([sum(x[1] == c for x in rows) for c in range(20)])
    rng = np.random.default_rng(7)
    w = np.array([rng.multinomial(20, np.full(20, 1 / 20)) for _ in range(500)])
    for k, name in ((2, "a"), (3, "b")):
        s = np.array([sum(x[k] for x in rows if x[1] == c) for c in range(20)])
        boot = (w @ s) / (w @ n)
        assert got[name]["mean"] == pytest.approx(s.sum() / n.sum()) and got[name]["clusters"] == 20
        assert (got[name]["low"], got[name]["high"]) == pytest.approx(tuple(np.quantile(boot, [0.025, 0.975])))
    both = spark.createDataFrame([("d", x[1], k, m, v) for k, x in enumerate(rows) for m, v in (("x", x[2]), ("y", x[3]))], "dataset string, cluster int, id int, method string, score double")
    row = metrics.paired(both, ["dataset"], "cluster", "id", "method", "score", "x", draws=200).first()
    assert row["other"] == "y" and row["mean"] == pytest.approx(np.mean([x[2] - x[3] for x in rows])) and row["low"] < row["mean"] < row["high"]


def test_requests_and_needs(spark):
    needs = spark.createDataFrame([("q", 0, "a"), ("q", 1, "b"), ("q", 2, "a"), ("z", 0, " "), ("z", 1, "X"), ("z", 2, "x ")], "k string, place int, need string")
    asks = spark.createDataFrame([("q", "b"), ("z", "why")], "k string, question string")
    got = [(r["k"], r["request"]) for r in checks.requests(needs, asks, "k", "need", "question").orderBy("k", "place").collect()]
    assert got == [("q", "a"), ("q", "b"), ("z", " "), ("z", "X"), ("z", "x "), ("z", "why")]
    assert {(r["k"], r["rule"]) for r in checks.need_issues(needs, "k", "need").collect()} == {("q", "repeated"), ("z", "blank"), ("z", "repeated")}


DOCS = [(1, "# Cats\n\nCats sleep all day. They like warm places.\n\n## Food\n\nCats eat fish and meat.\n\nMilk is not good for cats.\n"), (2, "# Boats\n\nBoats float on water.\n\n## Sails\n\nA sail moves a boat by wind.\n")]


def test_the_engine_from_text_to_evidence(spark):
    docs = spark.createDataFrame(DOCS, "doc_id int, text string")
    engine = Engine(Policy(output=2))
    units, nodes = engine.build(docs)
    asked = spark.createDataFrame([("q", "what do cats eat")], "question string, text string")
    hits = engine.find(docs, nodes, asked).orderBy("rank").collect()
    title = {(n["doc_id"], n["node_id"]): n["title"] for n in nodes.collect()}
    assert title[hits[0]["doc_id"], hits[0]["node_id"]] == "Cats eat fish and meat."
    got = engine.retrieve(units, nodes, "what do cats eat", ["fish and meat"])
    best = got["selected"].where("doc_id = 1").orderBy("rank").collect()
    assert len(best) == 2 and best[0]["text"] == "Cats eat fish and meat."
    with pytest.raises(ValueError):
        engine.retrieve(units, nodes, " ")

    def choose(state):
        h = state["history"]
        if not h:
            return {"action": "find", "need": "fish"}
        hit = h[0]["hits"][0]
        if len(h) == 1:
            return {"action": "read", **{k: hit[k] for k in ("doc_id", "node_id")}}
        if len(h) == 2:
            return {"action": "up", **{k: hit[k] for k in ("doc_id", "node_id")}}
        return {"action": "finish", "nodes": [(r["doc_id"], r["node_id"]) for r in state["read"]]}

    done = Navigator(engine, docs, nodes).run("what do cats eat", choose)
    assert done["status"] == "finished" and [e["text"] for e in done["evidence"]] == ["Cats eat fish and meat."] and len(done["history"]) == 3
    with pytest.raises(ValueError):
        Navigator(engine, docs, nodes).run("q", lambda s: {"action": "read", "doc_id": 1, "node_id": "root"})
    assert re.match("n0", done["evidence"][0]["node_id"])
    assert parser().parse_args(["find", "/x", "why", "--need", "a"]).need == ["a"]
