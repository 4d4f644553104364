"""Fusion of rankings, and unions of spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fused(rankings: DataFrame, query: str, item: str, place: str = "rank", weight: str | None = None, k: int = 60, order_as: str = "string") -> DataFrame:
    """Reciprocal rank fusion: ``query, item, score, rank``; an item counts once a list (``source``), ties go by id text."""
    once = rankings.groupBy(query, "source", item).agg(F.min(place).alias("p"), F.first(weight).alias("w") if weight else F.lit(1.0).alias("w"))
    ranked = once.withColumn("p", F.row_number().over(Window.partitionBy(query, "source").orderBy("p")))
    scored = ranked.groupBy(query, item).agg(F.round(F.sum(F.col("w") / (k + F.col("p"))), 9).alias("score"))
    order = Window.partitionBy(query).orderBy(F.desc("score"), F.col(item).cast(order_as))
    return scored.withColumn("rank", F.row_number().over(order).cast("bigint"))


def interleaved(rankings: DataFrame, query: str, item: str, place: str = "rank", need: str = "need") -> DataFrame:
    """Round robin over needs: by place, then need; each item where it is first seen."""
    first = rankings.groupBy(query, item).agg(F.min(F.struct(place, need)).alias("at"))
    order = Window.partitionBy(query).orderBy("at")
    return first.select(query, item, F.row_number().over(order).cast("bigint").alias("rank"))


def span_union(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Spans that overlap or touch become one: ``keys, start, end``."""
    by = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.withColumn("__new", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int"))
    rows = rows.withColumn("__island", F.sum("__new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "__island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__island")


def covered_items(items: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """Items that lie within the union of spans."""
    merged = span_union(spans, keys).select(*keys, F.col("start").alias("__s"), F.col("end").alias("__e"))
    inside = (F.col("start") >= F.col("__s")) & (F.col("end") <= F.col("__e"))
    return items.join(merged, keys).where(inside).drop("__s", "__e")
