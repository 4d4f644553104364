"""Scores that tie with a round number are told as the SQL twins tell them."""

import math

import duckdb
from pyspark.sql import functions as F

from arborspark.functions import probability as P
from arborspark.operators import segment
from arborspark.plans.corpus import cuts_sql, posterior_sql

FRACTIONS = sorted({a / b for b in range(1, 120) for a in range(1, b)})


def test_posteriors_are_those_of_sql_to_the_last_place(spark):
    con = duckdb.connect()
    rows = spark.createDataFrame([(x,) for x in FRACTIONS], "j double")
    for prior in (0.7, 0.95):
        want = dict(con.execute(f"select j, {posterior_sql('j', prior)} from (select unnest(?::DOUBLE[]) as j)", [FRACTIONS]).fetchall())
        got = dict(rows.select("j", P.posterior_same(F.col("j"), prior)).collect())
        assert sum(got[j] != want[j] for j in FRACTIONS) <= len(FRACTIONS) / 100  # 1,751 of 4,353 differed at 0.7
        assert all(got[j] == want[j] for j in (1 / 20, 2 / 59, 3 / 41, 9 / 116, 3 / 10))
        assert {j: round(p, 6) for j, p in got.items()} == {j: round(p, 6) for j, p in want.items()}


def test_logarithm_and_exponential(spark):
    rows = spark.createDataFrame([(x, 50 * x - 25) for x in FRACTIONS], "x double, y double")
    for x, y, log, exp in rows.select("x", "y", P.logarithm(F.col("x")), P.exponential(F.col("y"))).collect():
        assert abs(log - math.log(x)) <= math.ulp(math.log(x)) and abs(exp - math.exp(y)) <= math.ulp(math.exp(y))


def test_a_fall_of_just_the_least_drop(spark):
    """Likeness 3/41, then 2/59: posteriors 0.6 and 0.4, whose difference is just below 0.2 in doubles."""
    first = [f"a{i}" for i in range(20)]
    texts = [first, [*first[:3], *(f"b{i}" for i in range(21))], [*first[:2], *(f"c{i}" for i in range(39))]]
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, text varchar)")
    con.executemany("insert into conversations values (1, ?, ?)", [(i, " ".join(t)) for i, t in enumerate(texts)])
    want = con.execute(f"with recursive {cuts_sql(0.95)} select paragraph, posterior, cut from walk where paragraph > 0 order by 1").fetchall()
    units = spark.createDataFrame([(1, i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, paragraph bigint, text string")
    got = segment.anchor_drop(units, 0.95).orderBy("paragraph").select("paragraph", "posterior", "cut")
    assert [tuple(r) for r in got.collect()] == want and not want[1][2]
