"""Search over a scored content tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborspark.operators import walk


def beam(nodes: DataFrame, depth: int, width: int, least: float | None = None) -> DataFrame:
    """``doc_id, depth, node_id, score, rank``: level by level, the best ``width`` children of what was kept above.

    One join by document for each level of the tree; levels are few and fixed.
    """
    order = Window.partitionBy("doc_id").orderBy(F.desc("score"), "start", "node_id")
    kept, out = None, None
    for level in range(1, depth + 1):
        rows = nodes.where(F.col("depth") == level)
        if least is not None:
            rows = rows.where(F.col("score") >= least)
        if kept is not None:
            rows = rows.join(kept.select("doc_id", F.col("node_id").alias("parent_id")), ["doc_id", "parent_id"], "left_semi")
        kept = rows.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= width)
        part = kept.select("doc_id", "depth", "node_id", "score", "rank")
        out = part if out is None else out.unionByName(part)
    return out


def open_hits(nodes: DataFrame, paths: DataFrame, hits: int, best: int) -> DataFrame:
    """``doc_id, hit, node_id, score``: the best nodes of any level, and the best paragraphs below (or at) each."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("score"), "start", "node_id")
    top = nodes.where("depth > 0").withColumn("hit", F.row_number().over(order).cast("bigint")).where(F.col("hit") <= hits).select("doc_id", "hit", F.col("node_id").alias("top"))
    leaves = nodes.where("kind = 'paragraph'").join(paths, ["doc_id", "node_id"]).select("doc_id", "node_id", "score", "start", F.explode(F.split("path", "/")).alias("top"))
    opened = leaves.join(top, ["doc_id", "top"])
    by = Window.partitionBy("doc_id", "hit").orderBy(F.desc("score"), "start", "node_id")
    return opened.withColumn("k", F.row_number().over(by)).where(F.col("k") <= best).select("doc_id", "hit", "node_id", "score")


def resumed(nodes: DataFrame, width: int, accept: float, budget: int) -> DataFrame:
    """``doc_id, node_id, score, step``: paragraphs in the order they are reached; every one that is scored stays.

    A layer beam runs first; accepted nodes that it left closed, or that a layer too dear for
    the budget left unopened, are taken up again, the best first whose children fit.
    """
    steps = walk.trace(nodes, ["score"], walk.Limits(beam=width, acceptance=accept, decisions=budget, extra=1e9))
    told = steps.select("doc_id", "step", "terminals", F.posexplode(F.arrays_zip("candidates", "scores")).alias("k", "c")).where(F.array_contains("terminals", F.col("c.candidates")))
    order = Window.partitionBy("doc_id").orderBy("step", F.desc("c.scores"), "k")
    return told.select("doc_id", F.col("c.candidates").alias("node_id"), F.col("c.scores").alias("score"), (F.row_number().over(order) - 1).cast("bigint").alias("step"))
