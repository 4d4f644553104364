"""Ranking metrics, summaries and significance."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate
from math import ceil, exp, factorial, nan

from numpy import quantile
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborspark.operators.draws import drawn, signed, summed


def paragraph_metrics(predicted: DataFrame, references: DataFrame, query: str, item: str, place: str, k: int = 5) -> DataFrame:
    """``query, precision, recall, f1, complete`` at k: each the best over the query's alternative reference sets (``ref``)."""
    top = predicted.where(F.col(place) <= k).select(query, item).distinct()
    n_top = top.groupBy(query).agg(F.count(F.lit(1)).alias("n"))
    sizes = references.groupBy(query, "ref").agg(F.count_distinct(item).alias("m"))
    hits = references.select(query, "ref", item).distinct().join(top, [query, item]).groupBy(query, "ref").agg(F.count(F.lit(1)).alias("h"))
    rows = sizes.join(hits, [query, "ref"], "left").join(n_top, query, "left").na.fill(0, ["h", "n"])
    precision = F.when(F.col("n") > 0, F.col("h") / F.col("n")).otherwise(0.0)
    recall = F.col("h") / F.col("m")
    rows = rows.withColumn("p", precision).withColumn("r", recall).withColumn("f", F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0))
    best = lambda c: F.round(F.max(c), 6)
    return rows.groupBy(query).agg(best("p").alias("precision"), best("r").alias("recall"), best("f").alias("f1"), F.max((F.col("h") == F.col("m")).cast("double")).alias("complete"))


def boundary_f1(predicted: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """One row: true and false positives, misses, and their precision, recall and F1 over all documents."""
    both = predicted.select(*keys, F.lit(1).alias("p")).join(gold.select(*keys, F.lit(1).alias("g")), keys, "full")
    n = both.agg(F.count_if(F.col("p").isNotNull() & F.col("g").isNotNull()).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))
    ratio = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 6)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return n.select("tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def reciprocal_ranks(ranked: DataFrame, gold: DataFrame, query: str, item: str, place: str) -> DataFrame:
    """``query, first_hit, hit_1, recall_3, rr`` of every query that has gold items."""
    found = ranked.join(gold.select(query, item).distinct(), [query, item]).groupBy(query).agg(F.min(place).alias("first_hit"), F.count_if(F.col(place) <= 3).alias("h3"))
    sizes = gold.groupBy(query).agg(F.count_distinct(item).alias("m"))
    rows = sizes.join(found, query, "left")
    return rows.select(query, "first_hit", F.coalesce((F.col("first_hit") == 1).cast("int"), F.lit(0)).alias("hit_1"), F.round(F.coalesce(F.col("h3") / F.col("m"), F.lit(0.0)), 6).alias("recall_3"), F.round(F.coalesce(1 / F.col("first_hit"), F.lit(0.0)), 6).alias("rr"))


def holm(rows: DataFrame, family: list[str], p: str, item: list[str]) -> DataFrame:
    """Adds ``adjusted``: the step-down adjustment within a family."""
    order = Window.partitionBy(*family).orderBy(p, *item)
    m = F.count(F.lit(1)).over(Window.partitionBy(*family))
    step = F.least(F.lit(1.0), F.col(p) * (m - F.row_number().over(order) + 1))
    return rows.withColumn("__step", step).withColumn("adjusted", F.round(F.max("__step").over(order.rowsBetween(Window.unboundedPreceding, 0)), 6)).drop("__step")


def sign_test(differences: DataFrame, pair: list[str], cluster: str, value: str, draws: int = 200, seed: int = 7) -> DataFrame:
    """``pair, mean, p``: cluster sums keep or change sign at random; two-sided, the observed one counted too.

    A sign is + where the digest of the draw and the cluster begins with a digit below 8.
    """
    def made(s, n):
        return float(s[0]), float(n[0]), int((abs(s[1:]) >= abs(s[0]) - 1e-9).sum())

    rows = summed(signed(differences, pair, cluster, value, draws, seed), pair, made, "total double, n double, reached bigint")
    return rows.select(*pair, F.round(F.nanvl("total", F.lit(None).cast("double")) / F.col("n"), 6).alias("mean"), F.round((F.col("reached") + 1) / (draws + 1), 6).alias("p"))


#: Poisson distribution with mean 1, as far as a 32-bit draw tells its steps apart.
POISSON = list(accumulate(exp(-1) / factorial(k) for k in range(13)))


def bootstrap(rows: DataFrame, group: list[str], cluster: str, value: str, draws: int = 100, seed: int = 7, steps: Sequence[float] = (0.3679, 0.7358, 0.9197)) -> DataFrame:
    """``group, mean, low, high``: clusters drawn with hash-made weights, question-weighted.

    A weight is the number of ``steps`` at or below its draw: 0 to 3 as the twin has it, or Poisson without a cap.
    """
    bounds = [ceil(x * (1 << 32)) for x in steps]

    def weigh(x):
        return sum((x >= b for b in bounds if b < 1 << 32), x * 0)

    def made(s, n):
        means = s[1:][n[1:] > 0] / n[1:][n[1:] > 0]
        ends = quantile(means, [0.025, 0.975]).tolist() if len(means) else [nan, nan]
        return float(s[0] / n[0]), *ends

    found = summed(drawn(rows, group, cluster, value, weigh, draws, seed, counts=True), group, made, "mean double, low double, high double")
    return found.select(*group, *[F.round(F.nanvl(c, F.lit(None).cast("double")), 6).alias(c) for c in ("mean", "low", "high")])


def accuracy(rows: DataFrame, group: list[str], answer: str, label: str) -> DataFrame:
    """``group, accuracy, invalid, n``: share of answers that are the label; a null answer is invalid and wrong."""
    right = F.coalesce((F.col(answer) == F.col(label)).cast("int"), F.lit(0))
    return rows.groupBy(*group).agg(F.round(F.avg(right), 6).alias("accuracy"), F.count_if(F.col(answer).isNull()).alias("invalid"), F.count(F.lit(1)).alias("n"))


def resampled(rows: DataFrame, group: list[str], cluster: str, values: list[str], draws: int = 10_000, seed: int = 7, level: float = 0.95) -> DataFrame:
    """``group, value, mean, low, high, n, clusters``: whole clusters drawn with replacement, as many as there are.

    A draw is a multinomial resample, the same for all values, weighted by question. What a
    group's task holds is one row of sums for each cluster; draws are made one by one.
    """
    sums = rows.groupBy(*group, cluster).agg(F.count(F.lit(1)).alias("n"), *[F.sum(v).cast("double").alias(v) for v in values])
    kinds = ", ".join(f"{g} {rows.schema[g].dataType.simpleString()}" for g in group)

    def draw(pdf):
        import numpy as np

        pdf = pdf.sort_values(cluster)
        n, own = pdf["n"].to_numpy(np.int64), pdf[values].to_numpy(np.float64)
        r, found = np.random.default_rng(seed), np.empty((draws, len(values)))
        even = np.full(len(n), 1 / len(n))
        for k in range(draws):
            w = r.multinomial(len(n), even)
            found[k] = (w @ own) / (w @ n)
        ends = np.quantile(found, [(1 - level) / 2, (1 + level) / 2], axis=0)
        head = pdf[group].iloc[0].tolist()
        out = [(*head, v, own[:, i].sum() / n.sum(), ends[0, i], ends[1, i], n.sum(), len(n)) for i, v in enumerate(values)]
        return pdf.__class__(out, columns=[*group, "value", "mean", "low", "high", "n", "clusters"])

    return sums.groupBy(*group).applyInPandas(draw, f"{kinds}, value string, mean double, low double, high double, n bigint, clusters bigint")


def paired(rows: DataFrame, group: list[str], cluster: str, item: str, method: str, score: str, ours: str, draws: int = 10_000, seed: int = 7) -> DataFrame:
    """The interval of the mean difference between ``ours`` and each other method, over the items that both have, by cluster."""
    mine = rows.where((F.col(method) == ours) & F.col(score).isNotNull()).select(*group, cluster, item, F.col(score).alias("mine"))
    theirs = rows.where((F.col(method) != ours) & F.col(score).isNotNull()).select(*group, item, F.col(method).alias("other"), F.col(score).alias("theirs"))
    both = mine.join(theirs, [*group, item]).withColumn("difference", F.col("mine") - F.col("theirs"))
    return resampled(both, [*group, "other"], cluster, ["difference"], draws, seed).drop("value")
