"""Tables, statistics, scaling, solvers, dates and stores on small data."""

from __future__ import annotations

import datetime
import math
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates as D
from tidemark.functions import distributions as P
from tidemark.functions import scalars as X
from tidemark.operators import extrema, frame, scoring, solve, stats, subsets
from tidemark.operators.order import Order
from tidemark.sources import files, tables


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first().v


def test_upsert_sides_and_nulls(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, v string, o int")
    new = spark.createDataFrame([(2, None, 9), (3, "c", 8)], "k int, v string, n int")
    get = lambda df: {r.k: (r.v, r.o, r.n) for r in df.collect()}
    assert get(frame.upsert(old, new, "k")) == {1: ("a", 1, None), 2: (None, 2, 9), 3: ("c", None, 8)}
    assert get(frame.upsert(old, new, "k", keep="old"))[2] == ("b", 2, 9)
    assert get(frame.upsert(old, new, "k", null_overwrites=False))[2] == ("b", 2, 9)


def test_wide_rejects_repeats(spark):
    df = spark.createDataFrame([(1, "a", 5), (1, "a", 6)], "k int, c string, v int")
    with pytest.raises(Exception, match="several rows"):
        frame.rows_to_cols(df, "k", "c", "v", ["a"]).collect()


def test_members_at_dates(spark):
    m = spark.createDataFrame([("i", "a", datetime.date(2020, 1, 1), datetime.date(2020, 6, 1)), ("i", "b", datetime.date(2020, 3, 1), None)], "p string, c string, a date, b date")
    d = spark.createDataFrame([(datetime.date(2020, k, 1),) for k in (1, 3, 6, 7)], "d date")
    got = {(r.time.month, r.c) for r in frame.members_at(m, "p", "c", "a", "b", d, "d").collect()}
    assert got == {(1, "a"), (3, "a"), (6, "a"), (3, "b"), (6, "b"), (7, "b")}


@pytest.mark.parametrize("method", stats.RANKS)
def test_running_rank_is_that_of_each_prefix(spark, method):
    rng = random.Random(3)
    values = [rng.choice([None, 1.0, 2.0, 3.0, 4.0]) for _ in range(60)]
    df = spark.createDataFrame([(1, n, v) for n, v in enumerate(values)], "k int, t int, x double")
    got = [r["rank"] for r in stats.cum_rank(df, Order("k", "t"), "x", method).orderBy("t").collect()]
    for n, v in enumerate(values):
        if v is None:
            assert got[n] is None or math.isnan(got[n])
        else:
            assert got[n] == pd.Series([x for x in values[: n + 1] if x is not None]).rank(method=method).iloc[-1]


def test_distribution_functions():
    x = np.array([-2.0, -0.5, 0.0, 0.3, 1.0, 4.0])
    for cdf, pdf in ((lambda v: P.student_cdf(v, 5.0), lambda v: math.exp(math.lgamma(3) - math.lgamma(2.5)) / math.sqrt(5 * math.pi) * (1 + v * v / 5) ** -3),
                     (lambda v: P.normal_cdf(v, 0.0, 1.0), lambda v: np.exp(-v * v / 2) / math.sqrt(2 * math.pi)),
                     (lambda v: P.chi2_cdf(v, 3.0), lambda v: np.where(v > 0, np.sqrt(np.abs(v)) * np.exp(-v / 2) / (2**1.5 * math.gamma(1.5)), 0))):
        for a, b in zip(x, x[1:]):
            grid = np.linspace(a, b, 20001)
            assert cdf(np.array([b]))[0] - cdf(np.array([a]))[0] == pytest.approx(np.trapezoid(pdf(grid), grid), abs=2e-6)
    assert P.f_cdf(np.array([1.0]), 7.0, 7.0)[0] == pytest.approx(0.5, abs=1e-12)


def test_weibull_fit(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(float(v),) for v in 3.0 * rng.weibull(1.7, 4000)], "x double")
    shape, scale = P.fit_weibull(df, "x")
    assert shape == pytest.approx(1.7, rel=0.05) and scale == pytest.approx(3.0, rel=0.05)
    assert stats.ks_test(df, "x", "weibull", (shape, scale)).first().p_value > 0.05


def test_solvers_against_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        n = rng.randint(1, 9)
        values, weights = [rng.uniform(0, 9) for _ in range(n)], [rng.uniform(0.1, 9) for _ in range(n)]
        cap = rng.uniform(0, 25)
        best = max(sum(values[k] for k in c) for r in range(n + 1) for c in combinations(range(n), r) if sum(weights[k] for k in c) <= cap)
        total, taken = solve.knapsack(cap, values, weights)
        assert total == pytest.approx(best) and sum(values[k] for k in taken) == pytest.approx(best)
        items = [rng.randint(-5, 20) for _ in range(n)]
        target = rng.randint(-5, 40)
        there = any(sum(items[k] for k in c) == target for r in range(1, n + 1) for c in combinations(range(n), r))
        found = solve.subset_sum(target, items)
        assert (found is not None) == there and (found is None or sum(items[k] for k in found) == target)


def test_extrema_rules():
    near = [0, 5, 4, 6, 0]
    marks = extrema.turning_marks(near)
    assert marks == [-1, 1, -1, 1, -1]
    assert extrema.prune(near, marks, extrema.Limits(2)) == [-1, 0, 0, 1, -1]  # one row apart, and the trend is the same without
    assert extrema.prune(near, marks, extrema.Limits(2, max_val=1)) == marks  # but it differs enough
    assert extrema.prune(near, marks, extrema.Limits(2, max_pct=0.3)) == [-1, 0, 0, 1, -1]
    assert extrema.prune(near, marks, extrema.Limits(0)) == marks
    trend = [0, 5, 4, 3, 0]
    assert extrema.prune(trend, extrema.turning_marks(trend), extrema.Limits(2)) == [-1, 1, 0, 0, -1]
    needed = [0, 9, 1, 5, 0, 7]  # the peak of 9 is above the next one, so its pair stays
    assert extrema.prune(needed, extrema.turning_marks(needed), extrema.Limits(2))[1] == 1
    far = [0, 4, 8, 7.8, 7.6, 7.4, 7.2, 12, 0]
    marks = extrema.turning_marks(far)
    assert extrema.prune(far, marks, extrema.Limits(2)) == marks
    assert extrema.prune(far, marks, extrema.Limits(2, min_val=1)) == [-1, 0, 0, 0, 0, 0, 0, 1, -1]
    assert extrema.prune(far, marks, extrema.Limits(2, t_max=4, min_val=1)) == marks
    assert extrema.turning_marks([1, 3, 3, 2]) == [-1, 1, 0, -1] and extrema.turning_marks([2, 2]) == [0, 0]
    rng = random.Random(2)
    for _ in range(50):
        v = [rng.uniform(0, 50) for _ in range(60)]
        kept = extrema.prune(v, extrema.turning_marks(v), extrema.Limits(3, min_val=8.0))
        spots = [k for k, m in enumerate(kept) if m]
        assert all(kept[a] == -kept[b] and (v[b] - v[a]) * kept[b] > 0 for a, b in zip(spots, spots[1:]))


def test_labels_of_the_last_row(spark):
    rng = random.Random(7)
    v = [float(rng.randrange(30)) for _ in range(40)]
    df = spark.createDataFrame([(1, k, x) for k, x in enumerate(v)], "g int, t int, x double")
    order = Order("g", "t")
    got = {r.t: r.extremum for r in extrema.last_labels(df, order, "x", 10).collect()}
    whole = {r.t: r.extremum for r in extrema.last_labels(df, order, "x", None, 3).collect()}
    for k in range(40):
        some = v[max(0, k - 9) : k + 1]
        assert got[k] == (extrema.prune(some, extrema.turning_marks(some))[-1] if k >= 9 else None)
        assert whole[k] == (extrema.prune(v[: k + 1], extrema.turning_marks(v[: k + 1]))[-1] if k >= 2 else None)
    close = spark.createDataFrame([(1, k, x, m) for k, (x, m) in enumerate([(10.0, 1), (9.9, -1), (20.0, 1), (5.0, -1)])], "g int, t int, x double, m int")
    assert [r.m for r in extrema.drop_close(close, order, "x", "m").orderBy("t").collect()] == [0, 0, 1, -1]


def test_sums(spark):
    rng = random.Random(3)
    rows = [(k, i, float(rng.randint(-3, 12))) for k in range(12) for i in range(9)]
    df = spark.createDataFrame(rows, "k int, i long, x double")
    got = {}
    for r in subsets.sums_by(df, "k", "x", 10.0, "i", stretch=7).collect():
        got.setdefault(r.k, set()).add(tuple(r["items"]))
    best = {r.k: r.total for r in solve.nearest_sum_by(df, "k", "x", 20.0).collect()}
    loads = {r.k: r.total for r in solve.knapsack_value_by(df.withColumn("w", F.abs("x").cast("int")), "k", "x", "w", 15).collect()}
    exact = {r.k: r.total for r in solve.knapsack_value_by(df.withColumn("w", F.abs("x")), "k", "x", "w", 15.0, whole=False).collect()}
    for k in range(12):
        x = {i: v for kk, i, v in rows if kk == k}
        sets = [c for n in range(1, 10) for c in combinations(sorted(x), n)]
        assert got.get(k, set()) == {c for c in sets if sum(x[i] for i in c) == 10}
        assert best[k] == max([0] + [s for c in sets if all(x[i] > 0 for i in c) and (s := sum(x[i] for i in c)) <= 20])
        assert loads[k] == exact[k] == max([0] + [sum(x[i] for i in c) for c in sets if sum(abs(x[i]) for i in c) <= 15])


def test_all_sets_by_both_tables():
    rng = random.Random(9)
    for _ in range(150):
        n, places = rng.randrange(0, 9), rng.choice((0, 1, 3))
        values = [round(rng.uniform(-9, 20), places) for _ in range(n)]
        target, below, above = round(rng.uniform(-5, 25), places), rng.choice((0, 0.5, 3)), rng.choice((0, 1))
        *sizes, goal, under, over = solve._scaled(*values, target, below, above)
        want = {c for m in range(1, n + 1) for c in combinations(range(n), m) if goal - under <= sum(sizes[k] for k in c) <= goal + over}
        for made in (subsets.Layers(sizes, goal - under, goal + over), subsets.Halves(sizes, goal - under, goal + over)):
            got = [tuple(made.set_of(k)) for k in range(made.count)]
            assert len(got) == len(want) and set(got) == want
    many = subsets.sets_table(tuple([1.0] * 60), 30.0)
    assert many.count == math.comb(60, 30) and many.set_of(many.count - 1) == list(range(30, 60))
    fine = tuple(rng.uniform(0, 1) for _ in range(30))  # no two sums are alike
    assert isinstance(subsets.sets_table(fine, 7.5, 1e-6, 1e-6), subsets.Halves)
    for k in range(min(50, subsets.sets_table(fine, 7.5, 1e-6, 1e-6).count)):
        assert abs(sum(fine[i] for i in subsets.sets_table(fine, 7.5, 1e-6, 1e-6).set_of(k)) - 7.5) < 2e-6


def test_stretches_of_sets(spark):
    df = spark.createDataFrame([(k, i, float(1 + (i * k) % 5)) for k in (1, 2) for i in range(14)] + [(3, 1, None), (None, 5, 6.0)], "k int, i long, x double")
    whole = sorted((r.k or 0, tuple(r["items"])) for r in subsets.sums_by(df, "k", "x", 6.0, "i").collect())
    counts = {r.k: r.sets for r in subsets.count_sums_by(df, "k", "x", 6.0, "i").collect()}
    assert {k: sum(r[0] == (k or 0) for r in whole) for k in counts} == counts and counts[None] == 1 and len(set(whole)) == len(whole)
    part = [(r.k or 0, tuple(r["items"])) for r in subsets.sums_by(df, "k", "x", 6.0, "i", first=5, last=25, stretch=4).collect()]
    assert len(part) == 40 and set(part) < set(whole)
    assert solve.subset_sum(5, [4.0, 1.0, 2.0, 3.0]) == [0, 1] and solve.subset_sum(5, [4.0, 1.0, 2.0, 3.0], smallest=True) in ([0, 1], [2, 3])
    assert [r[0] for r in spark.range(1).select(subsets.last_fitting(F.array(*map(F.lit, [1.0, 5.0, 9.0])), 5.0)).collect()] == [1]
    assert [r[0] for r in spark.range(1).select(subsets.last_fitting(F.array().cast("array<double>"), 5.0)).collect()] == [-1]


def test_known_ciphers(spark):
    from tidemark.functions import scalars

    key, iv = bytes.fromhex("2b7e151628aed2a6abf7158809cf4f3c"), bytes(range(16))
    df = spark.createDataFrame([("exactly 16 bytes",), ("short",), ("",), ("über sechzehn Zeichen lang",)], "s string")
    plain = spark.createDataFrame([(bytearray.fromhex("6bc1bee22e409f96e93d7e117393172a"),)], "s binary")
    assert plain.select(scalars.encrypt_ecb(F.col("s"), key)).first()[0] == "3ad77bb40d7a3660a89ecaf32466ef97"
    assert plain.select(scalars.encrypt_cbc(F.col("s"), key, iv)).first()[0] == "7649abac8119b246cee98e9b12e9197d"
    for back in (scalars.decrypt_ecb(scalars.encrypt_ecb(F.col("s"), key), key), scalars.decrypt_cbc(scalars.encrypt_cbc(F.col("s"), key, iv), key, iv)):
        assert all(r.s == r.back for r in df.select("s", back.alias("back")).collect())


def test_sinks_keep_rows_and_keys(spark, tmp_path):
    from tidemark.sources import tables

    tables.create_database(spark, "sinks", str(tmp_path / "sinks"))
    try:
        one = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
        tables.sink(one, "sinks.t")
        tables.set_key(spark, "sinks.t", "k")
        with pytest.raises(ValueError):
            tables.sink(one, "sinks.t", "insert", "k")
        tables.sink(spark.createDataFrame([(3, 1.5)], "k int, w double"), "sinks.t", "insert", "k")
        assert sorted(map(tuple, spark.table("sinks.t").collect())) == [(1, "a", None), (2, "b", None), (3, None, 1.5)]
        with pytest.raises(ValueError):
            tables.set_key(spark, "sinks.t", "v")
        tables.rename_columns(spark, "sinks.t", {"v": "u"})
        assert tables.primary_key(spark, "sinks.t") == ["k"] and tables.tables(spark, "sinks") == ["t"]
        tables.drop_columns(spark, "sinks.t", "k")
        assert tables.primary_key(spark, "sinks.t") == [] and spark.table("sinks.t").count() == 3
    finally:
        tables.drop_database(spark, "sinks")


def test_sinks_rewrite_only_what_changes(spark, tmp_path):
    import glob
    import os

    from tidemark.sources import tables

    rows = [(k, float(k), f"p{k % 4}" if k % 4 else None) for k in range(40)]
    spark.range(1).createOrReplaceTempView("a_view")
    tables.create_database(spark, "parts", str(tmp_path / "parts"))
    try:
        tables.create(spark, "parts.t", {"k": "long", "v": "double", "s": "string"}, "k", "s")
        tables.sink(spark.createDataFrame(rows, "k long, v double, s string"), "parts.t", "insert")

        def times():
            return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{tmp_path}/parts/t/**/*.parquet", recursive=True)}

        def stored():
            return {r.k: (r.v, r.s) for r in spark.table("parts.t").collect()}

        before, want = times(), {k: (v, s) for k, v, s in rows}
        tables.sink(spark.createDataFrame([(1, -1.0, "p1"), (50, 5.0, "p9")], "k long, v double, s string"), "parts.t")
        want |= {1: (-1.0, "p1"), 50: (5.0, "p9")}
        after = times()
        assert stored() == want and {f for f in before if "s=p1" not in f} == {f for f in before if after.get(f) == before[f]}
        tables.remove(spark, "parts.t", "s = 'p2' OR k = 50 OR s IS NULL")  # whole partitions, the one of null too
        want = {k: x for k, x in want.items() if x[1] not in ("p2", "p9", None)}
        assert stored() == want and {r.partition for r in tables.partitions(spark, "parts.t").collect()} == {"s=p1", "s=p3"}
        tables.sink(spark.createDataFrame([(k, 0.0, "it's") for k in range(3, 40, 4)], "k long, v double, s string"), "parts.t", keys="k")  # p3 is empty now
        want |= {k: (0.0, "it's") for k in range(3, 40, 4)}
        assert stored() == want and tables.partitions(spark, "parts.t").count() == 2
        tables.rename_columns(spark, "parts.t", {"k": "id", "s": "part"})
        assert tables.primary_key(spark, "parts.t") == ["id"] and tables.partition_columns(spark, "parts.t") == ["part"] and tables.tables(spark, "parts") == ["t"]
        tables.retype_columns(spark, "parts.t", {"v": "int"})
        tables.drop_columns(spark, "parts.t", "v")
        assert tables.partition_columns(spark, "parts.t") == ["part"]
        for bad in ([(5, "x"), (5, "y")], [(None, "x")], [(1, "x")]):
            with pytest.raises(ValueError):
                tables.sink(spark.createDataFrame(bad, "id long, part string"), "parts.t", "insert")
        with pytest.raises(ValueError):
            tables.sink(spark.createDataFrame([(5, "x"), (5, "y")], "id long, part string"), "parts.t")
        tables.unpartition(spark, "parts.t")
        assert tables.partition_columns(spark, "parts.t") == [] and spark.table("parts.t").count() == len(want)
    finally:
        tables.drop_database(spark, "parts")
        spark.catalog.dropTempView("a_view")


def test_bootstrap_and_dense_grid(spark):
    df = spark.range(0, 500, 1, 4).withColumn("v", F.col("id") * 2)
    got = frame.bootstrap(df, 3, seed=4).collect()
    assert Counter(r["round"] for r in got) == {0: 500, 1: 500, 2: 500} and all(r.v == 2 * r.id for r in got)
    assert len({r.id for r in got}) > 400 and len({r.id for r in got if r["round"] == 0}) < 400
    assert frame.bootstrap(df.limit(0), 2).count() == 0
    tuples = spark.range(7).withColumnRenamed("id", "a")
    for most in (100_000, 10):
        assert frame._every(tuples, spark.range(2500).withColumnRenamed("id", "t"), "t", most).distinct().count() == 7 * 2500


def test_rejection_picks_by_weight(spark):
    from tidemark.operators import picks

    options = spark.createDataFrame([(1, 1), (2, 2), (3, 7)], "o int, w int")
    got = picks.by_rejection(spark.range(6000).withColumnRenamed("id", "d"), "d", options, "o", "w", tries=2)
    share = {r.o: r.n / 6000 for r in picks.counted(got, options, "o").collect()}
    assert abs(sum(share.values()) - 1) < 1e-9 and all(abs(share[o] - w / 10) < 0.03 for o, w in ((1, 1), (2, 2), (3, 7)))


def test_weights_of_a_consistent_matrix():
    w = np.array([0.5, 0.3, 0.2])
    got, index, _ = scoring.eigen_weights(w[:, None] / w[None, :])
    assert np.allclose(got, w) and abs(index) < 1e-9


def test_scalars(spark):
    assert one(spark, X.gcd(F.lit(84), F.lit(-36))) == 12 and one(spark, X.lcm_array(F.array(F.lit(4), F.lit(6), F.lit(10)))) == 60
    assert one(spark, X.hmac_sha256(F.lit("text"), "key")) == __import__("hmac").new(b"key", b"text", "sha256").hexdigest()
    assert one(spark, X.insert(F.array(F.lit(1), F.lit(2)), 9, 2)) == [1, 9, 2] and one(spark, X.insert(F.array(F.lit(1), F.lit(2)), 9, 1, False)) == [1, 9, 2]
    assert one(spark, X.vote(F.array(F.lit(3), F.lit(1), F.lit(3), F.lit(1)))) == 1
    assert one(spark, X.softmax_array(F.array(F.lit(1000.0), F.lit(1000.0)))) == [0.5, 0.5]


def test_dates(spark):
    assert [one(spark, D.carry(F.lit(2023), F.lit(4), 12, n)[0]) for n in (-8, 8, 9)] == [2022, 2023, 2024]
    assert [one(spark, D.carry(F.lit(2023), F.lit(4), 12, n)[1]) for n in (-8, 8, 9)] == [8, 12, 1]
    day = lambda s: F.lit(s).cast("date")
    assert one(spark, D.cycle_day(day("2000-01-07"))) == "甲子" and one(spark, D.cycle_year(F.lit(2024))) == "甲辰"
    want = {(0, 1): "2024-06-10", (5, 1): "2024-06-14", (1, 1): "2024-06-10", (-1, 1): "2024-06-07", (-6, 1): "2024-05-31"}
    for (n, _), text in want.items():
        assert str(one(spark, D.nth_weekday_day(day("2024-06-08"), n))) == text
    assert str(one(spark, D.nth_weekday_day(day("2024-06-05"), 3))) == "2024-06-10" and str(one(spark, D.nth_weekday_day(day("2024-06-05"), -3))) == "2024-05-31"


def test_files_and_archive(spark, tmp_path):
    df = spark.createDataFrame([(k, f"n,{k}\"\n") for k in range(20)], "k long, v string")
    for kind in ("csv", "json", "orc", "parquet"):
        files.save(df, f"{tmp_path}/x.{kind}", max_rows=7)
        back = files.load(spark, f"{tmp_path}/x.{kind}", schema=df.schema, mark="file")
        assert sorted((r.k, r.v) for r in back.collect()) == sorted(map(tuple, df.collect())) and back.select("file").distinct().count() >= 3
    with pytest.raises(ValueError):
        files.save(df, f"{tmp_path}/x.doc")
    at = f"{tmp_path}/store"
    files.archive(spark, df.where("k < 3"), at, "k")
    both = files.archive(spark, spark.createDataFrame([(2, "new"), (9, "y")], "k long, v string"), at, "k")
    assert {r.k: r.v for r in both.collect()}[2] == "new" and both.count() == 4


def test_table_sinks(spark, tmp_path):
    name = "t_" + tmp_path.name.replace("-", "_")
    old, new = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, v double"), spark.createDataFrame([(2, 9.0, 5), (3, 8.0, 6)], "k int, v double, w int")
    get = lambda: {r.k: (r.v, r.w) for r in spark.table(name).collect()}
    try:
        for mode, want in (("replace", {1: (1.0, None), 2: (9.0, 5), 3: (8.0, 6)}), ("insert_ignore", {1: (1.0, None), 2: (2.0, 5), 3: (8.0, 6)}), ("insert_new_columns", {1: (1.0, None), 2: (2.0, 5)})):
            tables.sink(old, name, "new")
            tables.sink(new, name, mode, "k")
            assert get() == want, mode
        tables.sink(old, name, "new")
        with pytest.raises(ValueError):
            tables.sink(new, name, "insert", "k")
        tables.remove(spark, name, "k = 1")
        assert [r.k for r in spark.table(name).collect()] == [2]
    finally:
        tables.drop(spark, name)
    bad = spark.createDataFrame([(float("nan"), float("inf"))], "a double, b double")
    assert tuple(tables.prepared(bad).first()) == (None, None) and tables.prepared(bad).columns == ["A", "B"]
