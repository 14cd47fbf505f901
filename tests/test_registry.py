"""Registered queries give the rows of their SQL on the test tables, and the contract's functions work."""

import math

import duckdb
import pytest

import __spark_entry__

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(n for n in __spark_entry__.queries() if not n.startswith("op") and n != "pipeline")


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    if isinstance(v, dict):
        return norm(list(v.values()))
    return str(v)


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf_dir, con, name):
    df = __spark_entry__.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(map(norm, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    sql = __spark_entry__.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(tuple(norm(r[i]) for i in at) for r in result.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
