"""Queries do the whole job: no rows, sets or sums are left out."""

from __future__ import annotations

import datetime
import time
from itertools import combinations

import pytest

from tidemark.operators import solve
from tidemark.plans import registry
from tidemark.session import ship_package

FOLDER = "/root/testdata/sf0.01"


def test_subset_sums_for_all_suppliers(spark):
    ship_package(spark)
    lines = {}
    for r in spark.read.parquet(f"{FOLDER}/lineitem.parquet").select("l_suppkey", "l_quantity", "l_orderkey", "l_linenumber").collect():
        lines.setdefault(r.l_suppkey, {}).setdefault(r.l_orderkey * 10 + r.l_linenumber, []).append(r.l_quantity)
    got = {r.l_suppkey: r["items"] for r in registry.queries()["find_addends_bigfirst"](spark, FOLDER).collect()}
    assert set(got) == set(lines)
    for key, items in got.items():
        # a line's key can occur twice, with other quantities
        sums = {0.0}
        for k in set(items):
            sums = {s + q for s in sums for q in lines[key][k]} if items.count(k) == 1 else {s + sum(lines[key][k]) for s in sums}
        assert 137.0 in sums


def test_subset_sum_ends_with_an_answer():
    # even items have no odd sum, and that takes no 2^60 steps
    begun = time.perf_counter()
    assert solve.subset_sum(301, [float(2 * k) for k in range(1, 61)]) is None
    # with the odd item no even sum is left, and more than a million steps lie under it
    items = [201.0, *(float(2 * k) for k in range(1, 61))]
    found = solve.subset_sum(400, items)
    assert found is not None and sum(items[k] for k in found) == 400
    assert sum([0.1, 0.2][k] for k in solve.subset_sum(0.3, [0.2, 0.1, float("nan")])) > 0.29
    assert time.perf_counter() - begun < 20


def test_best_load_of_all_parts_of_a_brand(spark):
    ship_package(spark)
    parts = spark.read.parquet(f"{FOLDER}/part.parquet").collect()
    got = {r.p_brand: r for r in registry.queries()["backpack01_float_dy"](spark, FOLDER).collect()}
    assert set(got) == {r.p_brand for r in parts}
    for brand, load in got.items():
        best = [0.0] * 121  # by capacity
        own = {r.p_partkey: (r.p_size, r.p_retailprice) for r in parts if r.p_brand == brand}
        for size, price in own.values():
            for c in range(120, size - 1, -1):
                best[c] = max(best[c], best[c - size] + price)
        assert abs(load.total - best[120]) < 1e-6
        assert len(set(load["items"])) == len(load["items"]) and sum(own[k][0] for k in load["items"]) <= 120
        assert abs(sum(own[k][1] for k in load["items"]) - load.total) < 1e-6


def event_sets(spark):
    """Support of each frequent set of event types by user and day, by enumeration."""
    baskets = {}
    for r in spark.read.parquet(f"{FOLDER}/events.parquet").select("user_id", "ts", "event_type").collect():
        baskets.setdefault((r.user_id, r.ts.date()), set()).add(r.event_type)
    kinds = sorted(set().union(*baskets.values()))
    freq = {c: sum(b.issuperset(c) for b in baskets.values()) for n in range(1, len(kinds) + 1) for c in combinations(kinds, n)}
    return {c: n for c, n in freq.items() if n >= 0.005 * len(baskets)}, len(baskets)


def test_frequent_sets_of_all_sizes(spark):
    ship_package(spark)
    sets, _ = event_sets(spark)
    assert max(map(len, sets)) > 3
    got = registry.queries()["get_CkSup_and_FreqLk_all"](spark, FOLDER).collect()
    assert sorted((r["items"], r.freq) for r in got) == sorted(("&".join(c), n) for c, n in sets.items())


@pytest.mark.parametrize(("name", "over"), [("gen_rules", lambda c: c > 0.02), ("fpgrowth_mlx", lambda c: c >= 0.02)])
def test_rules_with_sides_of_all_sizes(spark, name, over):
    ship_package(spark)
    sets, n = event_sets(spark)
    want = {}
    for whole, freq in sets.items():
        for size in range(1, len(whole)):
            for a in combinations(whole, size):
                c = tuple(x for x in whole if x not in a)
                if over(freq / sets[a]):
                    want["&".join(a), "&".join(c)] = (freq / n, freq / sets[a], freq / sets[a] / (sets[c] / n))
    got = {(r.antecedent, r.consequent): (r.support, r.confidence, r.lift) for r in registry.queries()[name](spark, FOLDER).collect()}
    assert any("&" in a and "&" in c for a, c in want) and set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


@pytest.mark.parametrize(("name", "n", "forth"), [("get_recent_workday", 0, 1), ("get_recent_workday_pre", 0, -1), ("get_next_nth_workday", 5, 1), ("get_next_nth_workday_back", 3, -1)])
def test_workdays_of_all_order_dates(spark, name, n, forth):
    ship_package(spark)

    def worked(day):
        return day.isoweekday() < 6 and day.day > 1 or day.isoweekday() == 6 and day.month == 1 and 8 <= day.day <= 14

    want = {}
    for r in spark.read.parquet(f"{FOLDER}/orders.parquet").select("o_orderdate").distinct().collect():
        at = r.o_orderdate.date()
        if n == 0:
            while not worked(at):
                at += datetime.timedelta(days=forth)
        left = n
        while left:
            at += datetime.timedelta(days=forth)
            left -= worked(at)
        want[str(r.o_orderdate.date())] = str(at)
    assert max(want) > "2001"
    got = registry.queries()[name](spark, FOLDER).collect()
    assert sorted((r.day, r.workday) for r in got) == sorted(want.items())


def test_date_ranges_of_all_orders(spark):
    ship_package(spark)
    begun = {r.o_orderkey: r.o_orderdate.date() for r in spark.read.parquet(f"{FOLDER}/orders.parquet").select("o_orderkey", "o_orderdate").collect()}
    day = datetime.timedelta(days=1)
    cut = sorted((k, str(b + i * day), str(b + min(i + 9, 25) * day)) for k, b in begun.items() for i in (0, 10, 20))
    assert sorted(map(tuple, registry.queries()["cut_date"](spark, FOLDER).select("o_orderkey", "begin", "end").collect())) == cut
    days = []
    for k, b in begun.items():
        # the first weekday is left out, as the range is open at its beginning
        days += [(k, str(x)) for x in [b + i * day for i in range(10) if (b + i * day).isoweekday() < 6][1:]]
    assert sorted(map(tuple, registry.queries()["get_dates_between"](spark, FOLDER).select("o_orderkey", "day").collect())) == sorted(days)
