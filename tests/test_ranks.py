"""Running ranks in blocks against counting, and totals by ranges."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import stats
from tidemark.operators.order import Order
from tidemark.operators.ranges import running
from tidemark.operators.ranks import RANKS, cum_rank, earlier_less

ORDER = Order("g", ("t", "i"))


def rank(values, k, method):
    v, past = values[k], [x for x in values[: k + 1] if x is not None]
    if v is None:
        return None
    less, ties = sum(x < v for x in past), sum(x == v for x in past)
    return {"min": less + 1, "max": less + ties, "first": less + ties, "average": less + (ties + 1) / 2, "dense": len({x for x in past if x < v}) + 1}[method]


def test_earlier_less():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 17, 64, 100):
        codes, point = rng.integers(0, 9, n), rng.random(n) < 0.6
        assert earlier_less(codes, point).tolist() == [sum(point[j] and codes[j] < codes[k] for j in range(k)) for k in range(n)]


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(3)
    rows = [(g, k // 2, k, rng.choice((None, float("nan"), 7.0, 7.0, 7.0, 7.0, *map(float, range(30))))) for g, n in ((1, 400), (2, 9), (3, 150), (None, 70), (5, 1)) for k in range(n)]
    return spark.createDataFrame(rows, "g int, t int, i int, x double").repartition(3)


@pytest.mark.parametrize("block", [16, 128, 100_000])
@pytest.mark.parametrize("method", RANKS)
def test_ranks(table, method, block):
    ascending = method != "max"
    got = cum_rank(table, ORDER, "x", method, ascending, block=block).collect()
    groups = {}
    for r in sorted(got, key=lambda r: (r.t, r.i)):
        groups.setdefault(r.g, []).append(r)
    assert len(got) == 630
    for rows in groups.values():
        values = [None if r.x is None or r.x != r.x else (r.x if ascending else -r.x) for r in rows]
        assert [r["rank"] for r in rows] == [rank(values, k, method) for k in range(len(rows))]


def test_without_a_key(spark):
    df = spark.createDataFrame([(k, float((k * 7) % 11)) for k in range(60)], "t int, x double")
    for block in (8, 1000):
        got = [r["rank"] for r in cum_rank(df, Order((), "t"), "x", "min", block=block).orderBy("t").collect()]
        assert got == [rank([float((k * 7) % 11) for k in range(60)], k, "min") for k in range(60)]
    assert cum_rank(df.limit(0), Order((), "t"), "x").count() == 0


def test_running_totals_with_null_keys(table):
    rows = running(table, ["g"], ["t", "i"], n=F.lit(1), s=F.coalesce(F.nanvl("x", F.lit(0.0)), F.lit(0.0))).collect()
    seen = {}
    for r in sorted(rows, key=lambda r: (r.t, r.i)):
        n, s = seen.get(r.g, (0, 0.0))
        seen[r.g] = n + 1, s + (0.0 if r.x is None or r.x != r.x else r.x)
        assert (r.n, r.s) == seen[r.g]
    assert len(rows) == 630


@pytest.mark.parametrize("method", ["dense", "average"])
def test_quantiles_of_all_rows(table, method):
    rows = table.where("NOT isnan(x) OR x IS NULL")
    got = stats.quantiles(rows, [], "x", method).collect()
    values = [r.x for r in got]
    some = sorted({v for v in values if v is not None})
    for r in got:
        if r.x is None:
            assert r.quantile is None
        elif method == "dense":
            assert r.quantile == pytest.approx((some.index(r.x) + 1) / len(some))
        else:
            less, ties = sum(v is not None and v < r.x for v in values), values.count(r.x)
            assert r.quantile == pytest.approx((less + (ties + 1) / 2) / len(values))
