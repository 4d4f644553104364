"""What lies below headings: a plain reader in one pass against plans over nodes, and nothing of the texts in the driver."""

import random
import re

from pyspark.sql import functions as F

from arborspark.operators import markdown, scopes, segment
from arborspark.plans import structure
from tests.test_markdown import GUIDE, LINES

SF = "/root/testdata/sf0.001"
MORE = ["## Contents", "- [A](#a)", "* [B](#b)", "Title .... ix", "A .. 3", "[x](#a-1)", "1. [Nope](#%zz)", "- [One](#%61)", "said: one! two? three", "Ａ ② ß", "# Ａ", "# A-1", "## Table of  contents", "e.g. 'so.' And"]


def by_plans(docs, found):
    nodes = markdown.index(docs, lambda u: segment.groups(u, segment.anchor_drop(u, 0.95)), found)
    asked = nodes.where("kind in ('toc_entry', 'heading')").select("doc_id", F.col("node_id").alias("asked"))
    targets = markdown.resolved(markdown.contents(found), found.where("kind = 'heading'"))
    inside = markdown.scope(nodes, targets, asked)
    return inside.groupBy("doc_id", "asked").agg(F.count(F.lit(1)).alias("n_nodes"), F.max("node_id").alias("last_node"))


def test_the_plain_reader_equals_the_plans(spark):
    r = random.Random(3)
    texts = ["\n".join(r.choice(LINES + 2 * MORE) for _ in range(r.randint(0, 24))) for _ in range(500)]
    texts += [GUIDE, "", "\n", "## Contents\nA .. 1\n\nB .. 2\n\n# A\n# B\n# B\n", "## Contents\n[Self](#contents)\n# A\n# a-1\n# A\n[A](#a)\n"]
    docs = spark.createDataFrame([*enumerate(texts), (9999, None)], "doc_id long, text string")
    got = scopes.scopes(docs, markdown.blocks(docs), scopes.TreeReader(0.95))
    want = by_plans(docs, markdown.with_text(markdown.blocks(docs), docs))
    assert got.dtypes == want.dtypes
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_no_text_goes_through_the_driver(spark):
    plan = structure.guide_scopes(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan, "texts are not broadcast"
    assert "Scan ExistingRDD" not in plan, "and no table is written down on the way"
    assert len(re.findall("Exchange hashpartitioning", plan)) <= 2


def test_texts_are_folded_after_they_are_dealt(spark):
    docs = spark.createDataFrame([(1, "# A\n~~~\n")], "doc_id long, text string")
    plan = markdown.blocks(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" in plan and "zip_with" not in plan[plan.index("RepartitionByExpression") :]
