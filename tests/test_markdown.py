"""Markdown blocks, contents, hints and trees: windows against plain Python, and scripted cases."""

import random

import pytest
from pyspark.sql import functions as F

from arborspark.functions import text as T
from arborspark.operators import markdown, parse, segment

LINES = ["# A", "## B ##", "#### C", "#", "#nope", "text one.", "  more text", "", " ", "---", "===", "- - -", "```", "~~~~", "~~~", "``` ", "    # code?", "Title", "##   ", "\ttab", "é 😀", "line\r", "\r"]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(11)
    return ["\n".join(r.choice(LINES) for _ in range(r.randint(0, 14))) for _ in range(400)] + ["", "\n", "one", "# A #\r\nsome text\r\nmore\r\n\r\n~~~\n# code\n~~~\nTitle\n---\n  last para  \n```\nopen"]


def test_windows_equal_the_plain_reader(spark, texts):
    docs = spark.createDataFrame([*enumerate(texts), (9999, None)], "doc_id long, text string")
    got = {}
    for r in markdown.blocks(docs).orderBy("doc_id", "block").collect():
        got.setdefault(r["doc_id"], []).append((r["kind"], r["start"], r["end"], r["title"], r["level"], r["verbatim"]))
    for k, text in enumerate(texts):
        assert got.get(k, []) == parse.BlockReader().read(text), repr(text)
    assert 9999 not in got and markdown.blocks(docs.limit(0)).count() == 0


def test_block_texts_are_source_slices(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = markdown.with_text(markdown.blocks(docs), docs).collect()
    assert found and all(r["text"] == texts[r["doc_id"]][r["start"] : r["end"]] for r in found)
    assert all(r["text"] == r["text"].strip(" \t\n\x0b\x0c\r") for r in found if r["kind"] == "paragraph" and not r["verbatim"])


def plain_tree(heads):
    stack, out = [], {}
    for start, level in heads:
        while stack and stack[-1][1] >= level:
            out[stack.pop()[0]][1] = start
        out[start] = [stack[-1][0] if stack else None, None]
        stack.append((start, level))
    return {k: tuple(v) for k, v in out.items()}


def test_heading_nest_as_on_a_stack(spark):
    r = random.Random(5)
    rows = [(d, 10 * k, r.randint(1, 6)) for d in range(60) for k in range(r.randint(1, 12))]
    got = {}
    for x in markdown.heading_parents(spark.createDataFrame(rows, "doc_id long, start long, level long")).collect():
        got.setdefault(x["doc_id"], {})[x["start"]] = (x["parent"], x["until"])
    for d in got:
        assert got[d] == plain_tree([(s, lv) for e, s, lv in rows if e == d])


def test_slugs_pass_over_taken_ones(spark):
    titles = ["A", "A", "a-1", "A", "A 1", "B", "Ａ", "A-1-1", "A-1"]
    df = spark.createDataFrame([(1, k, t) for k, t in enumerate(titles)], "doc_id long, start long, title string")
    got = [r["slug"] for r in markdown.anchors(df).orderBy("start").collect()]
    assert got[:4] == ["a", "a-1", "a-1-1", "a-2"] and got[5] == "b" and got[6] == "a-3"
    assert T is not None


GUIDE = "# Top\n\n## Contents\n\n- [One](#one)\n- [Space](#two%20words)\n- [Self](#contents)\nTwo words ... 3\nDup .. 4\n\n## One\n\nFirst. Second!\n\n### Two words\n\n```\ncode. here\n```\n\n## Dup\n\nx\n\n## Dup\n\nlast one.\n"


@pytest.fixture(scope="module")
def guide(spark):
    docs = spark.createDataFrame([(1, GUIDE), (2, "no heading here. At all."), (3, "")], "doc_id long, text string")
    return docs, markdown.with_text(markdown.blocks(docs), docs)


def test_contents_lead_to_headings(guide):
    docs, found = guide
    entries = markdown.contents(found)
    assert [GUIDE[r["start"] : r["end"]] for r in entries.orderBy("start").collect()] == GUIDE.split("\n")[4:9]
    got = {GUIDE[r["start"] : r["start"] + 6]: (r["status"], r["target"] and GUIDE[r["target"] :].split("\n")[0]) for r in markdown.resolved(entries, found.where("kind = 'heading'")).collect()}
    assert got["- [One"] == ("resolved", "## One") and got["- [Spa"][0] == "unresolved" and got["- [Sel"][0] == "unresolved"
    assert got["Two wo"] == ("resolved", "### Two words") and got["Dup .."][0] == "ambiguous"
    assert {r["anchor"] for r in entries.collect()} == {"one", "two words", "contents", None}


def test_the_tree_holds_every_block_once(guide):
    docs, found = guide
    nodes = markdown.index(docs, lambda u: segment.groups(u, segment.anchor_drop(u, 0.95)), found).collect()
    by = {(n["doc_id"], n["node_id"]): n for n in nodes}
    assert len(by) == len(nodes)
    for n in nodes:
        if n["node_id"] != "root":
            up = by[n["doc_id"], n["parent_id"]]
            assert up["start"] <= n["start"] <= n["end"] <= up["end"]
    one = [n for n in nodes if n["doc_id"] == 1]
    kinds = [n["kind"] for n in sorted(one, key=lambda n: n["node_id"] if n["node_id"] != "root" else "")]
    assert kinds[:9] == ["document", "heading", "heading", "toc", *["toc_entry"] * 5]
    assert [n["title"] for n in one if n["kind"] == "sentence"].count("```\ncode. here\n```") == 1
    parent = {n["title"]: by[1, n["parent_id"]]["title"] for n in one if n["kind"] == "heading" and n["parent_id"] != "root"}
    assert parent["Two words"] == "One" and parent["One"] == "Top"
    assert [n["kind"] for n in nodes if n["doc_id"] == 2] and {n["kind"] for n in nodes if n["doc_id"] == 3} == {"document"}


def test_units_carry_their_heading_path(guide):
    docs, found = guide
    got = [(r["heading"], GUIDE[r["start"] : r["end"]]) for r in markdown.units(found).where("doc_id = 1").orderBy("paragraph").collect()]
    assert got[1] == ("Top ::: One", "First. Second!") and got[2][0] == "Top ::: One ::: Two words" and got[-1] == ("Top ::: Dup", "last one.")


def test_hints_become_headings(spark):
    text = "one\nHint\ntwo\n\n# Own\n\n```\nHint\n```\n"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = markdown.with_text(markdown.blocks(docs), docs)
    rows = [(1, 4, 8, "Hint", 2), (1, 14, 19, "own", 1), (1, 14, 20, "other", 1), (1, 25, 29, "Hint", 2), (1, 0, 0, "x", 1)]
    hints = spark.createDataFrame(rows, "doc_id long, start long, end long, title string, level long")
    bad = {(r["start"], r["issue"]) for r in markdown.hinted(found, hints).collect()}
    assert (25, "not_source_text") in bad and (0, "span_or_level") in bad and not any(s == 4 for s, _ in bad)
    got = [(r["kind"], r["title"], r["text"]) for r in markdown.with_hints(found, hints.where("start = 4")).orderBy("block").collect()]
    assert got[:3] == [("paragraph", "", "one"), ("heading", "Hint", "Hint"), ("paragraph", "", "two")] and got[3][:2] == ("heading", "Own")


def test_compatibility_form(spark):
    df = spark.createDataFrame([("Ｆｕｌｌ ①",), ("plain",), (None,)], "t string")
    assert [r[0] for r in df.select(T.normal_title(T.nfkc(F.col("t")))).collect()] == ["full 1", "plain", None]
