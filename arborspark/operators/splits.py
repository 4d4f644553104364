"""Duplicate groups, split registries and coverage checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborspark.sources.work import written


def duplicate_groups(items: DataFrame, item: str, keys: list[str], rounds: int = 50) -> DataFrame:
    """``item, grp``: items that share a value of any key, transitively; named by the least item.

    Each key's groups become stars to their least item; labels then move along the stars
    until none changes. Every round is written down, so that no plan grows with the rounds.
    """
    stars = None
    for key in keys:
        # A group's least item comes from an aggregate, so that no task holds a group of copies.
        named = items.where(F.col(key).isNotNull()).select(F.col(item).alias("a"), F.col(key).alias("shared"))
        least = named.groupBy("shared").agg(F.min("a").alias("b"))
        part = named.join(least, "shared").where("a <> b").select("a", "b")
        stars = part if stars is None else stars.unionByName(part)
    stars = written(stars.distinct())
    labels = items.select(F.col(item).alias("a"), F.col(item).alias("grp")).distinct()
    for _ in range(rounds):
        up = stars.join(labels, "a").select(F.col("b").alias("a"), "grp")
        down = stars.join(labels.withColumnRenamed("a", "b"), "b").select("a", "grp")
        new = written(labels.unionByName(up).unionByName(down).groupBy("a").agg(F.min("grp").alias("grp")))
        if new.join(labels.withColumnRenamed("grp", "old"), "a").where("grp <> old").isEmpty():
            return new.select(F.col("a").alias(item), "grp")
        labels = new
    raise RuntimeError(f"groups did not settle in {rounds} rounds")


def hash_order(seed: str, key: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(seed), key.cast("string")), 256)


def first_by_hash(rows: DataFrame, keys: list[str], item: str, n: int, seed: str) -> DataFrame:
    """The first n of each stratum in the order of a digest."""
    order = Window.partitionBy(*keys).orderBy(hash_order(seed, F.col(item)), item)
    return rows.withColumn("place", F.row_number().over(order).cast("bigint")).where(F.col("place") <= n)


def registry(items: DataFrame, groups: DataFrame, item: str, exposure: list[str]) -> DataFrame:
    """Adds ``partition``: every member of a group goes to the most exposed partition of any member (first in ``exposure``)."""
    rank = F.array_position(F.array(*map(F.lit, exposure)), F.col("partition"))
    rows = items.join(groups, item).withColumn("r", rank)
    least = rows.groupBy("grp").agg(F.min("r").alias("least"))
    return rows.join(least, "grp").select(item, "grp", F.element_at(F.array(*map(F.lit, exposure)), F.col("least").cast("int")).alias("partition"), (F.col("least") != F.col("r")).alias("moved"))


def coverage(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, issue`` of what is missing, unexpected or there more than once."""
    counts = actual.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    both = expected.select(*keys).distinct().withColumn("e", F.lit(True)).join(counts, keys, "full")
    issue = F.when(F.col("n").isNull(), "missing").when(F.col("e").isNull(), "unexpected").when(F.col("n") > 1, "duplicate")
    return both.withColumn("issue", issue).where("issue is not null").select(*keys, "issue")


def align(evidence: DataFrame, passages: DataFrame, keys: list[str], text: str, passage: str) -> DataFrame:
    """Evidence texts to passages: exact text first, else text with white space collapsed; ``passage, issue``."""
    from arborspark.functions.text import collapsed

    counted = lambda key, name: passages.groupBy(*keys, key.alias(f"{name}_key")).agg(F.count(F.lit(1)).alias(f"{name}_n"), F.min(passage).alias(f"{name}_id"))
    rows = evidence.withColumn("exact_key", F.col(text)).withColumn("loose_key", collapsed(F.col(text)))
    rows = rows.join(counted(F.col(text), "exact"), [*keys, "exact_key"], "left").join(counted(collapsed(F.col(text)), "loose"), [*keys, "loose_key"], "left")
    n = F.coalesce("exact_n", "loose_n")
    return rows.drop("exact_key", "loose_key").withColumn("passage", F.when(n == 1, F.coalesce("exact_id", "loose_id"))).withColumn("issue", F.when(n.isNull(), "unmatched").when(n > 1, "ambiguous")).drop("exact_n", "loose_n", "exact_id", "loose_id")
