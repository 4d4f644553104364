"""A pool takes every candidate that fits, however many they are."""

from pyspark.sql import functions as F

from arborspark.operators import pack
from arborspark.plans import retrieval

SF = "/root/testdata/sf0.001"


def test_all_small_items_are_taken(spark):
    items = spark.range(300).select(F.lit("q").alias("q"), F.concat(F.lit("i"), "id").alias("item"), (F.col("id") + 1).alias("rank"), F.when(F.col("id") == 7, 1000).otherwise(2).cast("long").alias("cost"))
    got = {r["rank"]: (r["taken"], r["used"]) for r in pack.packed(items, "q", "item", "rank", "cost", 600).collect()}
    assert got == {k: (k != 8, 2 * (k - (k >= 8))) for k in range(1, 301)}


def test_the_pool_is_a_plain_fold(spark):
    cards = {}
    for r in retrieval._cards(spark, SF).select("question", "item", "rank", "cost").collect():
        cards.setdefault(r["question"], []).append((r["rank"], r["item"], r["cost"]))
    want, most = [], 0
    for question, xs in cards.items():
        used = n = 0
        for rank, item, cost in sorted(xs):
            taken = used + cost <= 600
            used, n = used + taken * cost, n + taken
            want.append((question, item, rank, taken, used))
        most = max(most, n)
    assert most > 12, "the questions hold a pool of more than twelve"
    assert sorted(map(tuple, retrieval.candidate_pool(spark, SF).collect())) == sorted(want)
