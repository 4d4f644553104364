"""Topic boundaries and representatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborspark.functions.arrays import let, scan
from arborspark.functions.probability import posterior_same
from arborspark.functions.text import jaccard, token_set
from arborspark.functions.vectors import dot

#: Groups whose sums (a vector each) are broadcast, at most.
BROADCAST_GROUPS = 4096
_STEP = "struct<paragraph:bigint,anchor:bigint,score:double,posterior:double,previous:double,cut:boolean>"


def anchor_drop(units: DataFrame, prior: float = 0.7, cutoff: float = 0.5, drop: float = 0.2) -> DataFrame:
    """The boundary decisions of each document: ``doc_id, paragraph, anchor, score, posterior, previous, cut``.

    Each unit is compared with the first of its group; it starts a new group where the
    posterior is at most ``cutoff`` and fell by ``drop`` or more. State is carried from unit
    to unit, so a document is folded as one ordered array; the only shuffle is by document.
    """
    items = units.select("doc_id", F.struct("paragraph", token_set(F.col("text")).alias("set")).alias("u"))
    runs = items.groupBy("doc_id").agg(F.array_sort(F.collect_list("u")).alias("us"))
    first = F.col("us")[0]
    start = F.struct(first["set"].alias("set"), first["paragraph"].alias("anchor"), F.lit(float(prior)).alias("previous"))

    def step(at: Column, u: Column) -> tuple[Column, Column]:
        cut = (u["posterior"] <= cutoff) & (at["previous"] - u["posterior"] >= drop)
        row = F.struct(u["paragraph"].alias("paragraph"), at["anchor"].alias("anchor"), u["score"].alias("score"), u["posterior"].alias("posterior"), at["previous"].alias("previous"), cut.alias("cut"))
        following = F.struct(F.when(cut, u["set"]).otherwise(at["set"]).alias("set"), F.when(cut, u["paragraph"]).otherwise(at["anchor"]).alias("anchor"), F.when(cut, F.lit(float(prior))).otherwise(u["posterior"]).alias("previous"))
        return following, row

    def judged(at: Column, u: Column) -> Column:
        """The unit with its score and posterior against the anchor, each worked out once."""
        shown = lambda score, p: F.struct(u["paragraph"].alias("paragraph"), u["set"].alias("set"), score.alias("score"), p.alias("posterior"))
        return let(jaccard(at["set"], u["set"]), lambda score: let(posterior_same(score, prior), lambda p: shown(score, p)))

    rest = F.slice("us", 2, F.greatest(F.size("us") - 1, F.lit(1)))
    return runs.select("doc_id", F.explode(scan(rest, start, step, _STEP, judged)).alias("d")).select("doc_id", "d.*")


def groups(units: DataFrame, decisions: DataFrame) -> DataFrame:
    """``doc_id, paragraph, topic``: a new topic at each cut, counted from 0."""
    rows = units.select("doc_id", "paragraph").join(decisions.select("doc_id", "paragraph", "cut"), ["doc_id", "paragraph"], "left")
    order = Window.partitionBy("doc_id").orderBy("paragraph")
    return rows.select("doc_id", "paragraph", F.sum(F.coalesce("cut", F.lit(False)).cast("bigint")).over(order).alias("topic"))


def quantile_split(vectors: DataFrame, section: str, order: str, vector: str, quantile: float = 0.85) -> DataFrame:
    """``section, order, distance, threshold, cut``: cuts where the distance to the row before lies above the section's quantile."""
    by = Window.partitionBy(section).orderBy(order)
    rows = vectors.select(section, order, (1 - dot(F.col(vector).cast("array<double>"), F.lag(F.col(vector).cast("array<double>")).over(by))).alias("distance"))
    ends = rows.where("distance is not null").groupBy(section).agg(F.percentile("distance", F.lit(quantile)).alias("threshold"))
    rows = rows.join(ends, section, "left").withColumn("threshold", F.coalesce("threshold", F.lit(2.0)))
    return rows.select(section, order, "distance", "threshold", F.coalesce(F.col("distance") > F.col("threshold"), F.lit(False)).alias("cut"))


def centroid_scores(vectors: DataFrame, group: str, item: str, vector: str) -> DataFrame:
    """``group, item, score``: mean similarity to the group's others, from the group's sum: n rows for n items, not n squared."""
    v = F.col(vector).cast("array<double>")
    dims = vectors.select(group, F.posexplode(v).alias("dim", "x")).groupBy(group, "dim").agg(F.sum("x").alias("total"), F.count(F.lit(1)).alias("n"))
    total = dims.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("dim", "total"))).alias("t"), F.max("n").alias("n")).select(group, F.col("t.total").alias("total"), "n")
    # A group's sum is one row: few groups are broadcast, so that a large group is not brought together.
    total = F.broadcast(total) if vectors.select(group).distinct().limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS else total
    rows = vectors.select(group, item, v.alias("v")).join(total, group)
    mean = (dot(F.col("v"), F.col("total")) - dot(F.col("v"), F.col("v"))) / (F.col("n") - 1)
    return rows.select(group, item, F.when(F.col("n") == 1, F.lit(1.0)).otherwise(F.least(F.greatest((mean + 1) / 2, F.lit(0.0)), F.lit(1.0))).alias("score"))


def outside_in(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adds ``depth`` and ``visit``: from both ends inward, the left one first."""
    by = Window.partitionBy(*keys).orderBy(order)
    rows = rows.withColumn("__i", F.row_number().over(by) - 1).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    rows = rows.withColumn("depth", F.least(F.col("__i"), F.col("__n") - 1 - F.col("__i")).cast("bigint"))
    return rows.withColumn("visit", F.row_number().over(Window.partitionBy(*keys).orderBy("depth", "__i")).cast("bigint") - 1).drop("__i", "__n")


def mean_pairwise(items: DataFrame, keys: list[str], item: str, text: str) -> DataFrame:
    """``keys, item, score``: mean Jaccard similarity to the others of the group; 1 for a single item.

    Groups are sentences of one paragraph, so pairs are bounded by it.
    """
    a = items.select(*keys, F.col(item).alias("a"), token_set(F.col(text)).alias("a_set"))
    b = items.select(*keys, F.col(item).alias("b"), token_set(F.col(text)).alias("b_set"))
    pairs = a.join(b, keys).where("a < b").select(*keys, "a", "b", jaccard(F.col("a_set"), F.col("b_set")).alias("s"))
    both = pairs.select(*keys, F.explode(F.array("a", "b")).alias(item), "s")
    means = both.groupBy(*keys, item).agg(F.avg("s").alias("score"))
    return items.select(*keys, item).join(means, [*keys, item], "left").select(*keys, item, F.coalesce("score", F.lit(1.0)).alias("score"))


def representatives(scored: DataFrame, keys: list[str], item: str, budget: int | None = None, stop: float | None = None) -> DataFrame:
    """The best item of each group among those visited outside-in; ties go to the first visited.

    ``budget`` bounds the items visited. With ``stop``, a whole wave (both ends at one depth)
    is the last one if it reaches that score.
    """
    rows = outside_in(scored, keys, item)
    if budget is not None:
        rows = rows.where(F.col("visit") < budget)
    if stop is not None:
        reached = rows.where(F.col("score") >= stop).groupBy(*keys).agg(F.min("depth").alias("last"))
        rows = rows.join(reached, keys, "left").where(F.col("last").isNull() | (F.col("depth") <= F.col("last")))
    best = F.max_by(F.struct(item, "score"), F.struct(F.round("score", 9).alias("s"), (-F.col("visit")).alias("v")))
    return rows.groupBy(*keys).agg(best.alias("b"), F.count(F.lit(1)).alias("visited")).select(*keys, "b.*", "visited")
