"""The driver's contract: every named query runs, and equals its SQL where it has one."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = sorted(n for n in entry.QUERIES)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return repr(value)


@pytest.mark.parametrize("name", OWN)
def test_query(spark, duck, data, name):
    df = entry.queries()[name](spark, data)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    sql = entry.oracle_sql().get(name)
    if sql is not None:
        found = duck.execute(sql)
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["state_runs", "dup_by_role_source", "components", "persistent_objects"])
def test_partitioning_changes_nothing(spark, data, name):
    plan, results = entry.queries()[name], set()
    for parts in ("1", "7", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        results.add(repr(sorted(map(repr, plan(spark, data).collect()))))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(results) == 1
