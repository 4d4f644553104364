"""Selection among retrieved passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborspark.functions.text import CONTINUATION, INTRODUCTION, stripped
from arborspark.sources.work import importable


def pairwise_wins(cards: DataFrame, query: str, item: str, place: str, preference, threshold: float = 0.5, limit: int = 30) -> DataFrame:
    """``query, item, wins, rank``: each pair of the best ``limit`` is compared both ways; both must agree, else it is a tie.

    ``preference(a, b)`` is the probability that a beats b, of two struct columns. Pairs are
    bounded by the limit.
    """
    top = cards.where(F.col(place) <= limit).select(query, F.struct(*[c for c in cards.columns if c != query]).alias("a"))
    pairs = top.join(top.withColumnRenamed("a", "b"), query).where(F.col(f"a.{place}") < F.col(f"b.{place}"))
    ab, ba = preference(F.col("a"), F.col("b")), preference(F.col("b"), F.col("a"))
    w = F.when((ab > threshold) & (ba < 1 - threshold), 1.0).when((ab < 1 - threshold) & (ba > threshold), 0.0).otherwise(0.5)
    sides = pairs.withColumn("w", w).select(query, F.explode(F.array(F.struct(F.col(f"a.{item}").alias("i"), F.col("w")), F.struct(F.col(f"b.{item}").alias("i"), (1 - F.col("w")).alias("w")))).alias("x"))
    wins = sides.groupBy(query, F.col("x.i").alias(item)).agg(F.sum("x.w").alias("wins"))
    rows = top.select(query, f"a.{item}", f"a.{place}").join(wins, [query, item], "left").withColumn("wins", F.coalesce("wins", F.lit(0.0)))
    order = Window.partitionBy(query).orderBy(F.desc("wins"), place)
    return rows.select(query, item, "wins", F.row_number().over(order).cast("bigint").alias("rank"))


def joint_selection(scores: DataFrame, query: str, item: str, place: str, first: str, second: str, k: int = 5) -> DataFrame:
    """Mean of the scores under two orders of presentation; ties go to the earlier ranking."""
    rows = scores.withColumn("mean", F.round((F.col(first) + F.col(second)) / 2, 9))
    order = Window.partitionBy(query).orderBy(F.desc("mean"), place)
    rows = rows.withColumn("rank", F.row_number().over(order).cast("bigint"))
    return rows.select(query, item, F.round("mean", 6).alias("mean"), "rank", (F.col("rank") <= k).alias("selected"))


#: Roles of a unit that follows another, fixed values.
DEPENDENT, FOLLOWING = "dependent_source_continuation", "following_source_paragraph"


def is_introduction(text: Column) -> Column:
    return text.rlike(INTRODUCTION)


def neighbours(units: DataFrame, doc: str, section: str, order: str, text: str) -> DataFrame:
    """For each unit, in its section: the last introduction before it, the unit before and the one after, with roles.

    A unit that introduces a list itself takes nothing from before it.
    """
    by = Window.partitionBy(doc, section).orderBy(order)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    intro = is_introduction(F.col(text))
    last_intro = F.last(F.when(intro, F.col(order)), ignorenulls=True).over(before)
    rows = units.select(doc, section, order, text, intro.alias("is_intro"), last_intro.alias("li"), F.lag(order).over(by).alias("lp"), F.lead(order).over(by).alias("following"), F.lead(text).over(by).alias("after"))
    rows = rows.withColumn("introduction", F.when(~F.col("is_intro"), F.col("li")))
    rows = rows.withColumn("preceding", F.when(~F.col("is_intro") & (F.col("li").isNull() | (F.col("lp") != F.col("li"))), F.col("lp")))
    depends = F.regexp_extract(F.rtrim(text), "[,:]$", 0).isin(",", ":") | stripped(F.col("after")).rlike(CONTINUATION)
    role = F.when(F.col("following").isNotNull(), F.when(depends, DEPENDENT).otherwise(FOLLOWING))
    return rows.select(doc, section, order, "is_intro", "introduction", "preceding", "following", role.alias("following_role"))


def packet(targets: DataFrame, links: DataFrame, query: str, doc: str, order: str) -> DataFrame:
    """``query, doc, order, is_target``: targets and all that their links name, once each."""
    own = targets.select(query, doc, order, F.lit(True).alias("is_target"))
    near = targets.join(links, [doc, order])
    extra = [near.where(F.col(c).isNotNull()).select(query, doc, F.col(c).alias(order), F.lit(False).alias("is_target")) for c in ("introduction", "preceding", "following")]
    for e in extra:
        own = own.unionByName(e)
    return own.groupBy(query, doc, order).agg(F.max("is_target").alias("is_target"))


def greedy_coverage(query: str, need_scores: list[list[float]], relevance: list[float], costs: list[int], budget: int, weight: float = 0.6, power: float = 0.5) -> list[int]:
    """Items taken one by one by coverage gain and relevance over cost, while one fits and is worth it."""
    width = len(need_scores[0]) if need_scores else 0
    covered, left, taken, used = [0.0] * width, set(range(len(costs))), [], 0
    while True:
        best = None
        for i in sorted(left):
            if used + costs[i] > budget:
                continue
            gain = sum(max(0.0, s - c) for s, c in zip(need_scores[i], covered, strict=True)) / width
            worth = ((weight * gain + (1 - weight) * relevance[i]) / max(1, costs[i]) ** power, relevance[i], -i)
            best = max(best, (worth, i)) if best else (worth, i)
        if not best or best[0][0] <= 0:
            return taken
        i = best[1]
        taken.append(i)
        left.discard(i)
        used += costs[i]
        covered = [max(c, s) for c, s in zip(covered, need_scores[i], strict=True)]


def select_evidence(cards: DataFrame, query: str, item: str, needs: list[str], relevance: str, cost: str, budget: int) -> DataFrame:
    """``query, item, place``: greedy coverage within each query; candidates are bounded by the search before it."""
    kinds = cards.schema
    schema = f"{query} {kinds[query].dataType.simpleString()}, {item} {kinds[item].dataType.simpleString()}, place bigint"

    def run(pdf):
        pdf = pdf.sort_values(item)
        got = greedy_coverage("", pdf[needs].to_numpy().tolist(), pdf[relevance].tolist(), pdf[cost].tolist(), budget)
        out = pdf.iloc[got][[query, item]].copy()
        out["place"] = range(len(got))
        return out

    return importable(cards).groupBy(query).applyInPandas(run, schema)
