"""Every registered query with SQL against DuckDB, over the smallest tables."""

from __future__ import annotations

import math
from collections import Counter

import pytest

from tidemark.plans import registry
from tidemark.session import ship_package

duckdb = pytest.importorskip("duckdb")
FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    made = duckdb.connect()
    for name in TABLES:
        made.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return made


def cell(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    return f"{float(value):.6g}" if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    return Counter(tuple(cell(row[k]) for k in order) for row in values)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    ship_package(spark)
    got = registry.queries()[name](spark, FOLDER)
    want = duck.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_queries_without_sql_run(spark):
    ship_package(spark)
    for name in ("zigzag", "find_maxmin", "replace_repeat_gap", "backpack01_float_dy", "get_xingzuo"):
        assert registry.queries()[name](spark, FOLDER).count() > 0
