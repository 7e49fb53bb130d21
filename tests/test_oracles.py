"""Every registered query against its DuckDB oracle, over whole tables."""

import glob
import os

import duckdb
import pytest

from folioframe.plans import registry


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return round(float(value), 6)


def rows(names, found):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    found = df.collect()
    if name not in registry.ORACLE_SQL:
        assert found
        return
    oracle = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(oracle.columns)
    assert rows(df.columns, found) == rows(oracle.columns, oracle.fetchall())


def test_every_oracle_has_a_query():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns
