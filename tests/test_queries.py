"""Every registered query with a SQL twin gives the twin's rows on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from arborspark.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
entry.queries()


def plain(value):
    if isinstance(value, float):
        return None if value != value else round(value, 5) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = duck.execute(registry.SQL[name])
    columns = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, got.fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).take(1)
