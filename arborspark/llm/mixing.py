"""Mixing sources to target weights, in DataFrame operations only.

Sizes are added up per source, a target is set for each source by filling to a common
level, and a source's repetition rate is its target over its size. A document is emitted
floor(rate) times, and once more if a hash of its id and the seed, as a number in [0, 1),
is below the rate's fraction.

Targets depend on each other, so the table of sources, one row of a name and two numbers
for each, is worked on in one task: a million sources are about 100 MB there. Documents
are never gathered.

Defined results: a null text has size 0; sources of size 0 have target 0 and rate 0; a
null source is a source of its own, after all others; rows with the same id draw alike,
and a row without an id draws by its text; an empty table gives an empty table; other
columns are carried by :func:`mix` only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborspark.llm.common import columns, fresh, table, text_of

#: Sources up to this many are joined by broadcast (32 bytes and a name each); more by a shuffle.
BROADCAST_SOURCES = 10_000


def size_of(text: str | Column) -> Column:
    """Number of words of a text."""
    return F.size(F.split(F.concat(F.lit(" "), text_of(text), F.lit(" ")), r"[\x20\x09-\x0D]+")).cast("bigint") - 2


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``source, source_size, target`` from rows of ``source, size``.

    The share of all sizes is dealt by weight; what lies above ``most`` times a source's
    size is dealt again among the others. That is the level L at which the sum of
    min(most * size, L * weight) is the share, found in one pass over the sources in the
    order of their caps for each unit of weight. The table has a row for each source only.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), place + 1)
    rows = by.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("wanted", F.least(F.sum("source_size").over(every) * F.lit(float(share)), F.sum("cap").over(every)))
    rows = rows.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    rows = rows.withColumn("open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    # The first source whose cap lies above the level that is left for it and all later ones sets the level.
    level = (F.col("wanted") - F.col("capped")) / F.col("open")
    rows = rows.withColumn("level", F.when(F.col("cap") >= level * F.col("weight"), level))
    found = F.first("level", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.least(F.col("cap"), F.coalesce(found, F.lit(float("inf"))) * F.col("weight"))
    return rows.select("source", "source_size", target.alias("target"))


def copies(rate: Column, key: Column, seed: int) -> Column:
    """floor(rate), and one more where the hash of key and seed falls below the fraction."""
    digits = F.substring(F.md5(F.concat_ws(":", key, F.lit(str(seed)))), 1, 12)
    draw = F.conv(digits, 16, 10).cast("double") / float(1 << 48)
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("bigint")


def draw_key(id_col: str, text_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text:"), F.md5(text_of(text_col))))


def plan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42, **how) -> DataFrame:
    """``id, source, size, source_size, target, n_copies`` of every document.

    Texts are read once; what follows moves ids and sizes only. With few sources, as a
    count of them tells, the targets are broadcast; otherwise the join is left to Spark,
    which splits a source that holds much of the table.
    """
    sizes = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size_of(text_col).alias("size"), draw_key(id_col, text_col).alias("key"))
    sizes = table(sizes, "mixing-sizes")
    goal = table(targets(sizes, **how), "mixing-targets")
    side = F.broadcast(goal) if goal.count() <= BROADCAST_SOURCES else goal
    right = side.withColumnRenamed("source", "_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    out = sizes.join(right, F.col("source").eqNullSafe(F.col("_source")), "left")
    return out.select("id", "source", "size", "source_size", "target", copies(rate, F.col("key"), seed).alias("n_copies"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42, **how) -> DataFrame:
    """The mixed corpus: each row of ``df`` as often as its plan says, with its own columns."""
    size = size_of(text_col)
    goal = table(targets(df.select(F.col(source_col).alias("source"), size.alias("size")), **how), "mixing-targets")
    side = F.broadcast(goal) if goal.count() <= BROADCAST_SOURCES else goal
    source, source_size, target, copy = fresh(df, "mix_source", "mix_source_size", "mix_target", "mix_copy")
    right = side.toDF(source, source_size, target)
    rate = F.when(F.col(source_size) > 0, F.col(target) / F.col(source_size)).otherwise(0.0)
    out = df.join(right, F.col(source_col).eqNullSafe(F.col(source)), "left")
    times = F.array_repeat(F.lit(0), copies(rate, draw_key(id_col, text_col), seed).cast("int"))
    return out.withColumn(copy, F.explode(times)).select(columns(df.columns))


def mixing_query(df: DataFrame, seed: int = 42) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every document."""
    rows = plan(df, seed=seed)
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("n_copies")).alias("taken"))
