"""The content tree as an adjacency table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def build(units: DataFrame, topics: DataFrame, sentences: DataFrame) -> DataFrame:
    """``doc_id, node_id, parent_id, kind, start, end, depth``: document, topic blocks, paragraphs, sentences."""
    u = units.select("doc_id", "paragraph", "start", "end").join(topics, ["doc_id", "paragraph"])
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    node = lambda rows, name, parent, kind, depth: rows.select("doc_id", name.alias("node_id"), parent.alias("parent_id"), F.lit(kind).alias("kind"), "start", "end", F.lit(depth).cast("bigint").alias("depth"))
    whole = units.groupBy("doc_id").agg(F.lit(0).cast("bigint").alias("start"), F.max("end").alias("end"))
    blocks = u.groupBy("doc_id", "topic").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    parts = [
        node(whole, F.lit("root"), F.lit(None).cast("string"), "document", 0),
        node(blocks, text("b", F.col("topic")), F.lit("root"), "section", 1),
        node(u, text("p", F.col("paragraph")), text("b", F.col("topic")), "paragraph", 2),
        node(sentences, text("p", F.col("paragraph"), "s", F.col("sentence")), text("p", F.col("paragraph")), "sentence", 3),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def paths(nodes: DataFrame, depth: int = 4) -> DataFrame:
    """``doc_id, node_id, path``: ids from the root down, joined by ``/``.

    A tree of a deeper document is followed until no node has a parent left, which a look at
    each further level tells; ``depth`` levels are taken without looking.
    """
    above = nodes.select("doc_id", F.col("node_id").alias("up"), F.col("parent_id").alias("next"))
    step = lambda rows: rows.join(above, ["doc_id", "up"], "left").select("doc_id", "node_id", F.when(F.col("up").isNull(), F.col("path")).otherwise(F.concat_ws("/", "up", "path")).alias("path"), F.col("next").alias("up"))
    rows = nodes.select("doc_id", "node_id", F.col("node_id").alias("path"), F.col("parent_id").alias("up"))
    for level in range(256):
        if level >= depth and rows.where("up is not null").isEmpty():
            return rows.select("doc_id", "node_id", "path")
        rows = step(rows)
    raise ValueError("a node is its own ancestor, or deeper than 256 levels")


def children(nodes: DataFrame) -> DataFrame:
    """``doc_id, node_id, n_children, first_child``."""
    return nodes.where("parent_id is not null").groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.count(F.lit(1)).alias("n_children"), F.min_by("node_id", F.struct("start", "node_id")).alias("first_child"))


def citations(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """``doc_id, node_id, first_line, last_line, sha`` of what each node reads; ``docs`` has ``doc_id, text``.

    A document's text meets the list of its nodes once, and only lines and digests leave.
    """
    spans = nodes.groupBy("doc_id").agg(F.collect_list(F.struct("node_id", "start", "end")).alias("xs"))
    breaks = lambda c: (F.length(c) - F.length(F.translate(c, "\n", ""))).cast("bigint")
    text = F.col("text")

    def cited(x):
        before, body = F.substring(text, F.lit(1), x["start"]), F.substring(text, x["start"] + 1, x["end"] - x["start"])
        return F.struct(x["node_id"].alias("node_id"), (breaks(before) + 1).alias("first_line"), (breaks(before) + breaks(body) + 1).alias("last_line"), F.sha2(body, 256).alias("sha"))

    return docs.join(spans, "doc_id").select("doc_id", F.explode(F.transform("xs", cited)).alias("r")).select("doc_id", "r.*")


def subtree_sizes(nodes: DataFrame) -> DataFrame:
    """``doc_id, node_id, n_below``: nodes under each one, from the paths."""
    ids = paths(nodes).select("doc_id", F.col("node_id").alias("leaf"), F.explode(F.split("path", "/")).alias("node_id"))
    return ids.groupBy("doc_id", "node_id").agg((F.count(F.lit(1)) - 1).alias("n_below"))


def violations(nodes: DataFrame) -> DataFrame:
    """``doc_id, rule, n``: repeated ids, missing parents, children outside their parent, siblings that overlap."""
    ids = nodes.groupBy("doc_id", "node_id").agg(F.count(F.lit(1)).alias("c"))
    twice = ids.groupBy("doc_id").agg(F.count_if(F.col("c") > 1).alias("n")).select("doc_id", F.lit("repeated_id").alias("rule"), "n")
    up = nodes.select("doc_id", F.col("node_id").alias("parent_id"), F.col("start").alias("ps"), F.col("end").alias("pe"))
    child = nodes.where("parent_id is not null").join(up, ["doc_id", "parent_id"], "left")
    orphan = child.groupBy("doc_id").agg(F.count_if(F.col("ps").isNull()).alias("n")).select("doc_id", F.lit("missing_parent").alias("rule"), "n")
    outside = child.groupBy("doc_id").agg(F.count_if((F.col("start") < F.col("ps")) | (F.col("end") > F.col("pe"))).alias("n")).select("doc_id", F.lit("outside_parent").alias("rule"), "n")
    order = Window.partitionBy("doc_id", "parent_id").orderBy("start", "end", "node_id")
    lapped = nodes.where("parent_id is not null").withColumn("lap", F.coalesce(F.lag("end").over(order) > F.col("start"), F.lit(False)))
    overlap = lapped.groupBy("doc_id").agg(F.count_if("lap").alias("n")).select("doc_id", F.lit("overlap").alias("rule"), "n")
    return twice.unionByName(orphan).unionByName(outside).unionByName(overlap)
