"""A database file as a data source: stretches, pushed filters, sinks, failing jobs."""

from __future__ import annotations

import datetime
import json
import sqlite3

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNull, StringStartsWith

from tidemark.session import ship_package
from tidemark.sources import database
from tidemark.sources.database import FilteredReader, read, write

SCHEMA = "k long, v double, s string, d date, b boolean"


@pytest.fixture
def base(spark, tmp_path):
    ship_package(spark)
    return {"database": str(tmp_path / "base.db"), "timeout": 60}


@pytest.fixture
def rows(spark):
    day = datetime.date(2024, 1, 1)
    return spark.createDataFrame([(k if k else None, k / 2, f"it's {k % 3}" if k % 5 else None, day + datetime.timedelta(k), k % 2 == 0) for k in range(50)], SCHEMA).repartition(4)


def stored(base, sql):
    with sqlite3.connect(**base) as held:
        return held.execute(sql).fetchall()


def test_round_trip_in_stretches(spark, base, rows):
    write(rows, "t", base)
    assert stored(base, "SELECT count(*), count(k) FROM t") == [(50, 49)] and len(stored(base, "SELECT name FROM sqlite_master")) == 1
    for options in ({}, {"column": "k", "partitions": 6}, {"column": "k", "partitions": 3, "lower": 10, "upper": 20}):
        back = read(spark, "t", base, schema=SCHEMA, **options)
        assert back.rdd.getNumPartitions() == options.get("partitions", 1)
        assert back.exceptAll(rows).isEmpty() and rows.exceptAll(back).isEmpty()
    assert read(spark, "t", base).dtypes == [("k", "bigint"), ("v", "double"), ("s", "string"), ("d", "string"), ("b", "bigint")]
    assert read(spark, "t", base, query="SELECT s, count(*) AS n FROM t GROUP BY s").count() == 4
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        back = read(spark, "t", base, schema=SCHEMA)
        some = back.where((F.col("v") > 3) & (F.col("s") == "it's 1") & F.col("k").isin(7, 13, 4, 99) & F.col("d").isNotNull())
        assert sorted(r.k for r in some.collect()) == [7, 13]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_filters_go_into_the_where_clause(base, rows):
    write(rows, "t", base)
    reader = FilteredReader({"connect": f'{{"database": "{base["database"]}"}}', "table": "t"}, T._parse_datatype_string(SCHEMA))
    filters = [GreaterThan(("v",), 3), EqualTo(("s",), "it's 1"), In(("k",), (7, 13)), StringStartsWith(("s",), "it"), IsNull(("b", "c")), EqualTo(("b",), True)]
    assert list(reader.pushFilters(filters)) == filters and len(reader.pushed) == 3
    assert sorted(r[0] for r in reader.read(reader.partitions()[0])) == [7, 13]


def test_sinks(spark, base):
    write(spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k int, s string, v double"), "t", base, keys="k")
    more = spark.createDataFrame([(2, "B", 7), (3, "C", 8)], "k int, s string, w int")
    with pytest.raises(Exception, match="comes twice"):
        write(more, "t", base, keys="k")
    write(more, "t", base, keys="k", sink="insert_ignore")
    assert sorted(stored(base, "SELECT k, s, v, w FROM t")) == [(1, "a", 1.0, None), (2, "b", 2.0, None), (3, "C", None, 8)]
    write(more, "t", base, keys="k", sink="replace")
    assert sorted(stored(base, "SELECT k, s, v, w FROM t")) == [(1, "a", 1.0, None), (2, "B", 2.0, 7), (3, "C", None, 8)]
    with pytest.raises(Exception, match="comes twice"):
        write(more.union(more), "t", base, keys="k", sink="replace")
    write(more.limit(0), "t", base, keys="k", sink="replace")
    assert len(stored(base, "SELECT * FROM t")) == 3
    write(more, "t", base, overwrite=True)
    assert sorted(stored(base, "SELECT k, w FROM t")) == [(2, 7), (3, 8)]
    assert [r[0] for r in stored(base, "SELECT name FROM sqlite_master")] == ["t"]  # nothing is left beside the target


def test_a_failing_job_changes_nothing(spark, base, rows):
    write(rows, "t", base)
    broken = rows.withColumn("k", F.when(F.col("v") > 20, F.raise_error("no")).otherwise(F.col("k")).cast("long"))
    with pytest.raises(Exception):
        write(broken, "t", base, overwrite=True)
    assert stored(base, "SELECT count(*) FROM t") == [(50,)] and [r[0] for r in stored(base, "SELECT name FROM sqlite_master")] == ["t"]


@pytest.mark.parametrize("sink", ["replace", "insert_ignore"])
def test_work_of_a_sink_grows_with_the_rows(base, monkeypatch, sink):
    steps, plain = [0], database.connection

    def counting(options):
        held = plain(options)
        held.set_progress_handler(lambda: steps.__setitem__(0, steps[0] + 1), 100)
        return held

    monkeypatch.setattr(database, "connection", counting)
    took = []
    for n in (1000, 4000):
        table = f"{sink}{n}"
        with sqlite3.connect(**base) as held:
            held.execute(f"CREATE TABLE {table} (k BIGINT, j TEXT, v BIGINT)")
            held.executemany(f"INSERT INTO {table} VALUES (?, ?, 0)", [(k * 7919 % n, "a") for k in range(n)])
        options = {"connect": json.dumps(base), "table": table, "keys": "k,j", "sink": sink}
        writer = database.Writer(options, T._parse_datatype_string("k long, j string, v long"), False)
        # half of the keys are stored, the others are new; with a null no key is another's
        new = [(k, "a", 1) for k in range(n // 2, n + n // 2)] + [(None, "a", 1), (0, None, 1)]
        steps[0] = 0
        writer.commit([writer.write(iter(new))])
        took.append(steps[0])
        old = 1 if sink == "replace" else 0
        assert stored(base, f"SELECT count(*), sum(v = {old}) FROM {table} WHERE k >= {n // 2} AND k < {n}") == [(n // 2, n // 2)]
        assert stored(base, f"SELECT count(*), sum(v), count(DISTINCT k) FROM {table}") == [(n + n // 2 + 2, n // 2 + 2 + old * n // 2, n + n // 2)]
    assert took[1] < 6 * took[0]
    assert [r[0] for r in stored(base, "SELECT type FROM sqlite_master")] == ["table"] * 2
