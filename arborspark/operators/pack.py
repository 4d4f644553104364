"""Packing under budgets: ordered folds in which an item that does not fit is passed over."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborspark.functions.arrays import scan


def packed(items: DataFrame, query: str, item: str, order: str, cost: str, budget: int, text: str | None = None, header: int = 0, joint: int = 0) -> DataFrame:
    """``query, item, order, taken, used``: what is taken in rank order, and the budget used up to then.

    Repeated items count once, and any number of them is taken that fits. With ``header`` and
    ``joint``, the cost is that of the rendered context: the header once and ``joint`` more
    for each further item.
    """
    first = items.groupBy(query, item).agg(F.min(F.struct(order, cost)).alias("x")).select(query, F.struct(F.col(f"x.{order}").alias("o"), F.col(item).alias("i"), F.col(f"x.{cost}").alias("c")).alias("x"))
    runs = first.groupBy(query).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    row = "struct<o:bigint,i:string,taken:boolean,used:bigint>"
    start = F.struct(F.lit(header).cast("bigint").alias("used"), F.lit(0).cast("bigint").alias("n"))

    def step(at, x):
        price = x["c"] + F.when(at["n"] > 0, F.lit(joint)).otherwise(F.lit(0))
        fits = at["used"] + price <= budget
        used = (at["used"] + F.when(fits, price).otherwise(F.lit(0))).cast("bigint")
        made = F.struct(x["o"].cast("bigint").alias("o"), x["i"].cast("string").alias("i"), fits.alias("taken"), used.alias("used"))
        return F.struct(used.alias("used"), (at["n"] + fits.cast("bigint")).alias("n")), made

    out = runs.select(query, F.explode(scan(F.col("xs"), start, step, row)).alias("r"))
    return out.select(query, F.col("r.i").alias(item), F.col("r.o").alias(order), "r.taken", "r.used")


def packed_units(units: DataFrame, keys: list[str], order: str, cost: str, budget: int) -> DataFrame:
    """Adds ``pack``: contiguous units packed greedily, a new pack where the next unit does not fit."""
    runs = units.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(cost).alias("c")))).alias("xs"))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.lit(0).cast("bigint").alias("pack"))

    def step(at, x):
        fresh = (at["used"] > 0) & (at["used"] + x["c"] > budget)
        pack = (at["pack"] + fresh.cast("bigint")).cast("bigint")
        used = F.when(fresh, x["c"]).otherwise(at["used"] + x["c"]).cast("bigint")
        return F.struct(used.alias("used"), pack.alias("pack")), F.struct(x["o"].cast("bigint").alias("o"), pack.alias("pack"))

    rows = runs.select(*keys, F.explode(scan(F.col("xs"), start, step, "struct<o:bigint,pack:bigint>")).alias("r"))
    return rows.select(*keys, F.col("r.o").alias(order), "r.pack")


def first_that_fit(items: DataFrame, query: str, order: str, cost: str, budget: int) -> DataFrame:
    """Stops at the first item that does not fit: a running sum."""
    by = Window.partitionBy(query).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return items.withColumn("used", F.sum(cost).over(by)).where(F.col("used") <= budget)
