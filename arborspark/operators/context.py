"""What is read around the passages that a search reached, and where a search lost them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborspark.functions.text import stripped
from arborspark.operators import tree


def heading_tree(headings: DataFrame, doc: str, order: str, title: str) -> DataFrame:
    """``doc, node_id, parent_id, title, depth, implicit, first, last`` from flat titles ``A ::: B``.

    A heading's last part is a new node even if it repeats; parts before it are the nodes open
    at that depth while the path agrees with the heading's just before, else implicit ones. A
    row with a null title closes what is open. ``first`` and ``last`` are the orders covered.
    The open node of a depth is the latest begun there, so two windows tell all of it.
    """
    parts = F.transform(F.split(F.col(title), " ::: "), stripped)
    parts = F.when(F.exists(parts, lambda p: p == ""), F.array(F.col(title))).otherwise(parts)
    by = Window.partitionBy(doc).orderBy(order)
    rows = headings.select(doc, order, parts.alias("ps")).withColumn("before", F.lag("ps").over(by)).where("ps is not null")
    rows = rows.select(doc, order, "ps", "before", F.posexplode("ps").alias("depth", "title"))
    n = F.col("depth") + 1
    same = F.coalesce((F.size("before") >= n) & (F.slice("ps", F.lit(1), n) == F.slice("before", F.lit(1), n)), F.lit(False))
    rows = rows.withColumn("own", n == F.size("ps")).withColumn("new", F.col("own") | ~same)
    level = Window.partitionBy(doc, "depth").orderBy(order)
    rows = rows.withColumn("begun", F.last(F.when(F.col("new"), F.col(order)), ignorenulls=True).over(level))
    name = F.concat(F.lit("h"), "begun", F.lit("."), "depth")
    rows = rows.withColumn("node_id", name).withColumn("parent_id", F.lag("node_id").over(Window.partitionBy(doc, order).orderBy("depth")))
    first = lambda c: F.min_by(c, order).alias(c)
    nodes = rows.groupBy(doc, "node_id").agg(first("parent_id"), first("title"), first("depth"), (~F.min_by("own", order)).alias("implicit"), F.min(order).alias("first"), F.max(order).alias("last"))
    return nodes.withColumn("depth", F.col("depth").cast("bigint")).withColumn("parent_id", F.coalesce("parent_id", F.lit("root")))


def cores(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """``doc_id, node_id, place, parent_id, start, end``: paragraphs of the leaves (``doc_id, node_id, rank``), by their best leaf."""
    up = nodes.select("doc_id", "node_id", "parent_id")
    best = leaves.join(up, ["doc_id", "node_id"]).groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.min("rank").alias("place"))
    return best.join(nodes.select("doc_id", "node_id", "parent_id", "start", "end"), ["doc_id", "node_id"])


def _first_of_each_span(rows: DataFrame) -> DataFrame:
    """``doc_id, start, end, tier, rank`` from rows with an ``at`` that orders them, its first field the tier."""
    one = rows.groupBy("doc_id", "start", "end").agg(F.min("at").alias("at"))
    order = Window.partitionBy("doc_id").orderBy("at", "start", "end")
    return one.select("doc_id", "start", "end", F.col("at")[0].alias("tier"), F.row_number().over(order).cast("bigint").alias("rank"))


def bottom_up(leaves: DataFrame, nodes: DataFrame, heading: str = "heading") -> DataFrame:
    """``doc_id, start, end, tier, rank``: what to read, from the reached paragraphs outward.

    Tier 0: the paragraphs; 1: the leaves reached; 2: the paragraphs' parents; 3: their
    siblings, nearest first, turn by turn over the paragraphs; 4: parents' parents of the
    kind ``heading``. A span counts where it comes first.
    """
    core = cores(leaves, nodes)
    at = lambda tier, a, b=0: F.array(F.lit(tier).cast("bigint"), F.lit(a).cast("bigint") if isinstance(a, int) else F.col(a).cast("bigint"), F.lit(b).cast("bigint") if isinstance(b, int) else F.col(b).cast("bigint")).alias("at")
    out = core.select("doc_id", "start", "end", at(0, "place"))
    out = out.unionByName(leaves.select("doc_id", "node_id", "rank").join(nodes.select("doc_id", "node_id", "start", "end"), ["doc_id", "node_id"]).select("doc_id", "start", "end", at(1, "rank")))
    above = nodes.select("doc_id", F.col("node_id").alias("parent_id"), F.col("parent_id").alias("over"), "kind", "start", "end")
    parents = core.select("doc_id", "parent_id", "place").join(above, ["doc_id", "parent_id"])
    out = out.unionByName(parents.select("doc_id", "start", "end", at(2, "place")))
    among = Window.partitionBy("doc_id", "parent_id").orderBy("start", "node_id")
    row = nodes.where("kind = 'paragraph'").select("doc_id", "parent_id", "node_id", "start", "end", F.row_number().over(among).alias("i"))
    own = core.select("doc_id", "node_id", "place").join(row.select("doc_id", "parent_id", "node_id", F.col("i").alias("mine")), ["doc_id", "node_id"]).drop("node_id")
    near = own.join(row, ["doc_id", "parent_id"]).where("i <> mine")
    turn = Window.partitionBy("doc_id", "place").orderBy(F.abs(F.col("i") - F.col("mine")), "i")
    out = out.unionByName(near.withColumn("turn", F.row_number().over(turn)).select("doc_id", "start", "end", at(3, "turn", "place")))
    over = parents.select("doc_id", F.col("over").alias("parent_id"), "place").join(above, ["doc_id", "parent_id"]).where(F.col("kind") == heading)
    return _first_of_each_span(out.unionByName(over.select("doc_id", "start", "end", at(4, "place"))))


def ancestors(core: DataFrame, nodes: DataFrame, paths: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """``doc_id, start, end, tier, rank``: paragraphs level by level up the tree, nearest to a core first.

    Tier 0 holds ``initial`` (``doc_id, start, end, rank``); tier n the paragraphs below the
    cores' n-th ancestors, turn by turn over the cores (``doc_id, node_id, place, start, end``).
    """
    trail = paths.select("doc_id", "node_id", F.reverse(F.split("path", "/")).alias("up"))
    mine = core.select("doc_id", "node_id", "place", F.col("start").alias("cs"), F.col("end").alias("ce")).join(trail, ["doc_id", "node_id"])
    mine = mine.select("doc_id", "place", "cs", "ce", F.posexplode("up").alias("tier", "top")).where("tier > 0")
    below = nodes.where("kind = 'paragraph'").select("doc_id", "node_id", "start", "end").join(trail, ["doc_id", "node_id"]).select("doc_id", "start", "end", F.explode("up").alias("top"))
    pairs = mine.join(below, ["doc_id", "top"])
    apart = F.greatest(F.lit(0), F.col("start") - F.col("ce"), F.col("cs") - F.col("end"))
    turn = Window.partitionBy("doc_id", "place", "tier").orderBy(apart, "start", "end")
    big = lambda c: F.col(c).cast("bigint")
    out = pairs.withColumn("turn", F.row_number().over(turn)).select("doc_id", "start", "end", F.array(big("tier"), big("turn"), big("place")).alias("at"))
    if initial is not None:
        zero = F.lit(0).cast("bigint")
        out = out.unionByName(initial.select("doc_id", "start", "end", F.array(zero, big("rank"), zero).alias("at")))
    return _first_of_each_span(out)


def fit_spans(spans: DataFrame, texts: DataFrame, budget: int, measure: Callable[[str], int] = lambda text: len(text.split())) -> DataFrame:
    """``doc_id, rank, start, end, taken, used``: spans by rank, each taken if the union with those before fits.

    ``measure`` prices the union's text (``texts``: ``doc_id, text``), so each document is
    walked by itself; spans that touch are one.
    """
    kind = spans.schema["doc_id"].dataType.simpleString()

    def walk(pdf):
        pdf = pdf.sort_values("rank")
        text, held, used, taken, costs = pdf["text"].iloc[0] or "", [], 0, [], []
        for start, end in zip(pdf["start"], pdf["end"], strict=True):
            union: list[list[int]] = []
            for a, b in sorted([*held, (start, end)]):
                if union and a <= union[-1][1]:
                    union[-1][1] = max(union[-1][1], b)
                else:
                    union.append([a, b])
            cost = sum(measure(text[a:b]) for a, b in union)
            taken.append(cost <= budget)
            if taken[-1]:
                held, used = [tuple(u) for u in union], cost
            costs.append(used)
        return pdf[["doc_id", "rank", "start", "end"]].assign(taken=taken, used=costs)

    rows = spans.select("doc_id", "rank", "start", "end").join(texts.select("doc_id", "text"), "doc_id", "left")
    return rows.groupBy("doc_id").applyInPandas(walk, f"doc_id {kind}, rank bigint, start bigint, end bigint, taken boolean, used bigint")


def promoted(cards: DataFrame, query: str, item: str, place: str, preference: Callable[[Column, Column], Column], k: int = 5, threshold: float = 0.8) -> DataFrame:
    """``query, item, rank, selected``: the first card stays; each next slot goes to the first card left, or to one that surely beats it.

    A card surely beats another where both ``preference(it, other)`` and one less
    ``preference(other, it)`` reach the threshold; the surest does, then the earliest.
    Candidates are bounded by the search before.
    """
    if not 0.5 < threshold <= 1 or k < 1:
        raise ValueError("k must be positive and the threshold in (0.5, 1]")
    fields = [place, *[c for c in cards.columns if c not in (query, place)]]
    rows = cards.groupBy(query).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("cs"))
    rest = lambda a: F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0)))

    def step(acc: Column, _: Column) -> Column:
        first = acc["left"][0]
        sure = F.transform(rest(acc["left"]), lambda c: F.struct(F.least(preference(c, first), 1 - preference(first, c)).alias("p"), (-c[place]).alias("o"), c[item].alias("i")))
        won = F.array_max(F.filter(sure, lambda s: s["p"] >= threshold))
        chosen = F.coalesce(won["i"], first[item])
        return F.when(F.size(acc["left"]) == 0, acc).otherwise(F.struct(F.array_append(acc["done"], chosen).alias("done"), F.filter(acc["left"], lambda c: c[item] != chosen).alias("left")))

    start = F.struct(F.array(F.col("cs")[0][item]).alias("done"), rest(F.col("cs")).alias("left"))
    turns = F.slice(F.sequence(F.lit(1), F.lit(max(k, 2))), 1, k - 1) if k > 1 else F.expr("cast(array() as array<int>)")
    out = rows.select(query, F.aggregate(turns, start, step, lambda acc: F.concat(acc["done"], F.transform(acc["left"], lambda c: c[item]))).alias("all"))
    return out.select(query, F.posexplode("all").alias("p", item)).select(query, item, (F.col("p") + 1).cast("bigint").alias("rank"), (F.col("p") < k).alias("selected"))


def blended(cards: DataFrame, query: str, item: str, place: str, score: str, weight: float = 1.0, limit: int = 30) -> DataFrame:
    """``query, item, blend, rank``: of the best ``limit``, score and place in the earlier ranking by weight."""
    pool = cards.where(F.col(place) <= limit)
    n = F.count(F.lit(1)).over(Window.partitionBy(query))
    i = F.row_number().over(Window.partitionBy(query).orderBy(place)) - 1
    rows = pool.select(query, item, place, F.round(weight * F.col(score) + (1 - weight) * (1 - i / F.greatest(n - 1, F.lit(1))), 9).alias("blend"))
    order = Window.partitionBy(query).orderBy(F.desc("blend"), place)
    return rows.select(query, item, "blend", F.row_number().over(order).cast("bigint").alias("rank"))


def first_barriers(targets: DataFrame, paths: DataFrame, kept: DataFrame) -> DataFrame:
    """``doc_id, node_id, n_levels, n_reached, barrier``: how far a search got towards each target.

    ``kept`` has the nodes that the search kept; the barrier is the first node on the way
    from the root that it did not keep, null where the target was reached.
    """
    way = targets.select("doc_id", "node_id").join(paths, ["doc_id", "node_id"]).select("doc_id", "node_id", F.posexplode(F.split("path", "/")).alias("depth", "step")).where("depth > 0")
    seen = kept.select("doc_id", F.col("node_id").alias("step"), F.lit(True).alias("seen")).distinct()
    way = way.join(seen, ["doc_id", "step"], "left")
    lost = F.col("seen").isNull()
    first = F.coalesce(F.min(F.when(lost, F.col("depth"))), F.max("depth") + 1)
    return way.groupBy("doc_id", "node_id").agg(F.count(F.lit(1)).alias("n_levels"), (first - 1).cast("bigint").alias("n_reached"), F.min_by(F.when(lost, F.col("step")), F.when(lost, F.col("depth"))).alias("barrier"))


def retained_by_depth(barriers: DataFrame, doc: str = "doc_id") -> DataFrame:
    """``doc, depth, n_targets, n_retained``: targets whose way was still kept at each depth."""
    rows = barriers.select(doc, "n_reached", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n_levels"))).alias("depth"))
    return rows.groupBy(doc, "depth").agg(F.count(F.lit(1)).alias("n_targets"), F.count_if(F.col("n_reached") >= F.col("depth")).alias("n_retained"))


def rendered(passages: DataFrame, query: str, title: str, order: list[str], heading: str, text: str) -> DataFrame:
    """``query, context``: a title line, then the numbered passages in source order."""
    rows = passages.groupBy(query).agg(F.min(title).alias("t"), F.array_sort(F.collect_list(F.struct(*order, F.col(heading).alias("__h"), F.col(text).alias("__x")))).alias("ps"))
    parts = F.transform("ps", lambda p, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), p["__h"].cast("string"), F.lit("\n"), p["__x"]))
    return rows.select(query, F.concat(F.lit("Title: "), F.col("t").cast("string"), F.lit("\n\n"), F.array_join(parts, "\n\n")).alias("context"))


def eligible(nodes: DataFrame, kind: str = "sentence") -> DataFrame:
    """The nodes that are of the kind or lead to one: all that stand on the paths of these."""
    live = nodes.where(F.col("kind") == kind).select("doc_id", "node_id")
    trail = tree.paths(nodes).join(live, ["doc_id", "node_id"], "left_semi")
    return trail.select("doc_id", F.explode(F.split("path", "/")).alias("node_id")).distinct()
