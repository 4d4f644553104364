"""Blocks of Markdown are found in one pass, and once for a query."""

from arborspark.operators import markdown
from arborspark.plans import registry, structure

SF = "/root/testdata/sf0.001"


def test_lines_are_made_once(spark):
    plan = markdown.blocks(structure._guides(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate ") == 1 and "RepartitionByExpression" in plan, "lines are laid out once, after documents are dealt"


def test_scopes_share_their_blocks(spark, monkeypatch):
    calls, blocks = [], markdown.blocks
    monkeypatch.setattr(markdown, "blocks", lambda *a: calls.append(a) or blocks(*a))
    registry.QUERIES["guide_scopes"](spark, SF)
    assert len(calls) == 1
