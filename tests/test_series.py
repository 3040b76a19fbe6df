"""Ordered-series operators on small series with known answers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.operators import series as S
from tidemark.operators.order import Order

ORDER = Order("k", "t")


def frame(spark, *columns, schema="k int, t int, x int"):
    return spark.createDataFrame([(1, n, *row) for n, row in enumerate(zip(*columns))], schema)


def column(df, name):
    return [r[name] for r in df.orderBy("t").collect()]


def test_streaks(spark):
    df = frame(spark, [0, 1, 1, None, 1, 1, 1, 0, 1])
    assert column(S.con_count(df, ORDER, F.col("x") == 1), "con_count") == [0, 1, 2, 0, 1, 2, 3, 0, 1]
    assert column(S.con_count_ignore(df, ORDER, F.col("x") == 1, F.col("x").isNull()), "con_count") == [0, 1, 2, 0, 3, 4, 5, 0, 1]


def test_gaps(spark):
    df = frame(spark, [0, 1, 0, 0, 1, 1, 0, 0])
    assert column(S.gap_count(df, ORDER, F.col("x") == 1), "gap") == [0, 0, 1, 2, 3, 1, 1, 2]
    assert column(S.previous_match(df, ORDER, "t", F.col("x") == 1), "preval") == [None, None, 1, 1, 1, 4, 5, 5]
    assert [(r.start, r.end) for r in S.run_bounds(df, ORDER, F.col("x") == 1).orderBy("start").collect()] == [(1, 1), (4, 5)]


@pytest.mark.parametrize("now_gap,now,want", [
    (False, True, [0, 0, 1, 1, 2, 0, 1, 0]), (True, True, [0, 0, 1, 1, 2, 3, 1, 1]),
    (False, False, [0, 0, 0, 1, 1, 0, 0, 0]), (True, False, [0, 0, 0, 1, 1, 2, 0, 1])])
def test_count_between_gap(spark, now_gap, now, want):
    df = frame(spark, [0, 1, 0, 0, 0, 1, 0, 1], [1, 0, 1, 0, 1, 1, 1, 0], schema="k int, t int, g int, n int")
    assert column(S.count_between_gap(df, ORDER, F.col("g") == 1, F.col("n") == 1, now_gap, now), "count") == want


def test_aggregate_behind_a_match(spark):
    df = frame(spark, [5, 3, 4, 9, 1, 2], [0, 1, 0, 0, 1, 0], schema="k int, t int, v int, c int")
    for agg, plain, first in ((F.max, [None, None, 4, 9, 9, 2], [None, None, 4, 9, 9, 2]), (F.sum, [None, None, 4, 13, 14, 2], [None, None, 7, 16, 17, 3]),
                              (F.count, [None, None, 1, 2, 3, 1], [None, None, 2, 3, 4, 2]), (F.avg, [None, None, 4.0, 6.5, 14 / 3, 2.0], [None, None, 3.5, 16 / 3, 17 / 4, 1.5])):
        assert column(S.val_gap_cond(df, ORDER, F.col("v"), F.col("c") == 1, agg), "val_gap") == plain
        assert column(S.val_gap_cond(df, ORDER, F.col("v"), F.col("c") == 1, agg, contain_first=True), "val_gap") == first


def test_repeats(spark):
    df = frame(spark, [0, 1, 1, 0, 1, -1, 0, 1, 1])
    keep = {False: [0, 1, 0, 0, 0, -1, 0, 1, 0], True: [0, 0, 0, 0, 1, -1, 0, 0, 1]}
    for last, want in keep.items():
        assert column(S.replace_repeat(df, ORDER, "x", F.col("x") == 1, F.lit(0), F.col("x") == 0, keep_last=last), "x") == want
    assert column(S.replace_repeat_gap(df, ORDER, "x", 1, 0, gap=3), "x") == [0, 1, 0, 0, 1, -1, 0, 1, 0]
    other = frame(spark, [-1, 1, -1, 0, 1, 0, 1, 1, -1])
    assert column(S.replace_repeat_gap(other, ORDER, "x", 1, 0, gap=5), "x") == [-1, 1, -1, 0, 1, 0, 0, 0, -1]
    assert column(S.replace_repeat_gap(other, ORDER, "x", lambda x: x > 0, lambda x: 0, gap=1), "x") == [-1, 1, -1, 0, 1, 0, 0, 0, -1]
    # a value that the rule leaves as it is breaks no run
    assert column(S.replace_repeat_gap(other, ORDER, "x", lambda x: x > 0, lambda x: min(x, 0), gap=1), "x") == [-1, 1, -1, 0, 0, 0, 0, 0, -1]


def test_segments_turns_and_chain(spark):
    df = frame(spark, [1, 1, None, None, 2, 1])
    assert column(S.segments(df, ORDER, "x"), "segment") == [0, 0, 1, 1, 2, 3]
    df = frame(spark, [1, 3, 3, 2, 2, 5, 4])
    assert column(S.turns(df, ORDER, "x"), "turn") == [-1, 1, 0, -1, 0, 1, -1]
    assert column(S.chain_filter(df, ORDER, "x", lambda a, b: b > a), "kept") == [1, 3, None, None, None, 5, None]
    assert column(S.appear_order(df, ORDER, "x"), "nth") == [1, 1, 2, 1, 2, 1, 1]
    assert column(S.label_repeats(df, ORDER, "x", "l"), "l") == ["1", "3", "3_2", "2", "2_2", "5", "4"]


@pytest.mark.parametrize("method,want", [("min", [2.0, 1.0, 2.0, None, 4.0]), ("max", [3.0, 1.0, 3.0, None, 4.0]), ("average", [2.5, 1.0, 2.5, None, 4.0]), ("dense", [2.0, 1.0, 2.0, None, 3.0]), ("first", [2.0, 1.0, 3.0, None, 4.0])])
def test_group_rank(spark, method, want):
    df = frame(spark, [5, 1, 5, None, 9])
    assert column(S.group_rank(df, ["k"], "x", method, tie=["t"]), "rank") == want


def test_order_of_rows_and_partitions_do_not_matter(spark):
    rows = [(n % 3, n, (n * 7919) % 5) for n in range(300)]
    got = []
    for n, parts in ((1, rows), (7, rows[::-1])):
        df = spark.createDataFrame(parts, "k int, t int, x int").repartition(n)
        got.append(sorted(map(tuple, S.con_count(df, ORDER, F.col("x") > 1).collect())))
    assert got[0] == got[1]


def test_rolling_corr_of_columns_that_do_not_vary(spark):
    a, b = [1.0, 1.0, 1.0, 2.0, 4.0, None, 3.0, 5.0], [1.0, 2.0, 5.0, 5.0, 5.0, 5.0, 1.0, 4.0]
    df = frame(spark, a, b, schema="k int, t int, a double, b double")
    want = [None, None, None, 0.5, None, None, 1.0, 1.0]  # pairs with a null are left out
    assert column(S.rolling_corr(df, ORDER, "a", "b", 3), "corr") == [w if w is None else pytest.approx(w) for w in want]
    # equal values that are no binary fractions leave no rest, either
    flat = frame(spark, [0.1] * 9, [k / 7 for k in range(9)], schema="k int, t int, a double, b double")
    assert column(S.rolling_corr(flat, ORDER, "a", "b", 5), "corr") == [None] * 9
