"""Zigzag: sure pivots, both legs' rules, resuming."""

from __future__ import annotations

import math
import random
import time

import pytest

from tidemark.operators.extrema import Limits, Prefixes, prune, turning_marks
from tidemark.operators.order import Order
from tidemark.operators.pivots import Leg, next_high, resumed_labels, zigzag, zigzag_labels

ORDER = Order("g", "t")


def walks(seed: int, count: int):
    rng = random.Random(seed)
    for _ in range(count):
        x = [50.0]
        for _ in range(rng.randrange(3, 70)):
            x.append(max(1.0, x[-1] + rng.gauss(0, 3)))
        yield rng, [v + rng.random() for v in x], [v - rng.random() for v in x]


def test_known():
    x, leg = [4, 7, 1, 5, 9, 4, 2, 6, 8], Leg(min_val=3)
    assert zigzag_labels(x, x, leg, leg) == [-0.5, 1, -1, 0, 1, 0, -1, 0, 0.5]
    assert zigzag_labels([1, 5, 2], [1, 5, 2], leg, leg) == [0, 0, 0]  # no pivot is sure on both sides
    assert zigzag_labels([], [], leg, leg) == [] and zigzag_labels([1.0], [1.0], leg, leg) == [0] and zigzag_labels([5.0] * 6, [5.0] * 6, leg, leg) == [0] * 6


def test_rules_of_a_leg():
    slow = Leg(min_val=2, t_min=3)
    assert not slow.sure(5, None, 3) and slow.sure(5, None, 4) and not slow.sure(1, None, 9)
    fast = Leg(min_val=2, max_pct=0.5, t_min=3)
    assert fast.sure(5, 0.6, 2) and not fast.sure(5, 0.4, 2) and not fast.sure(1, 0.6, 4)
    assert Leg(min_val=2, t_max=5).sure(0, None, 5) and Leg(min_pct=0.1, from_zero=0.3).measure(0, 7) == 0.3
    with pytest.raises(ValueError):
        Leg(max_pct=0.5)


def test_up_and_down_have_rules_of_their_own():
    x = [20.0, 10, 30, 24, 31, 5, 9, 4, 20]
    assert zigzag_labels(x, x, Leg(min_val=3), Leg(min_val=5))[1:8] == [-1, 1, -1, 1, -1, 1, -1]  # the rise of 4 after 5 makes that sure
    assert zigzag_labels(x, x, Leg(min_val=3), Leg(min_val=7))[1:5] == [-1, 0, 0, 1]  # a fall of 6 no longer counts


def test_pivots_alternate_and_are_extremes_between_their_neighbours():
    for rng, high, low in walks(4, 300):
        labels = zigzag_labels(high, low, Leg(min_val=4.0), Leg(min_pct=0.07))
        sure = [(k, int(m)) for k, m in enumerate(labels) if abs(m) == 1]
        assert all(a[1] == -b[1] for a, b in zip(sure, sure[1:]))
        for (a, _), (b, kind), (c, _) in zip(sure, sure[1:], sure[2:]):
            side = high if kind == 1 else [-x for x in low]
            assert side[b] == max(side[a + 1 : c])


def test_resumed_is_one_pass_wherever_cut():
    checked = 0
    for rng, high, low in walks(5, 400):
        up, down = Leg(min_pct=rng.choice((0.03, 0.1)), max_pct=rng.choice((None, 0.2)), t_max=rng.choice((math.inf, 9))), Leg(min_val=rng.choice((2.0, 6.0)))
        whole, cut = zigzag_labels(high, low, up, down), rng.randrange(1, len(high))
        part = zigzag_labels(high[:cut], low[:cut], up, down)
        sure = max((k for k, m in enumerate(part) if abs(m) == 1), default=0)
        checked += abs(part[sure]) == 1
        assert part[:sure] + resumed_labels(high[sure:], low[sure:], part[sure], up, down) == whole
    assert checked > 150


def test_frames(spark):
    rows = [(g, t, h, lo) for g, (_, high, low) in enumerate(walks(6, 8)) for t, (h, lo) in enumerate(zip(high, low))]
    df = spark.createDataFrame(rows, "g int, t int, h double, l double").repartition(5)
    leg = Leg(min_val=4.0)
    whole = zigzag(df, ORDER, "h", "l", leg)
    early = zigzag(df.where("t < 12"), ORDER, "h", "l", leg).withColumnRenamed("zigzag", "known")
    again = zigzag(df.join(early.select("g", "t", "known"), ["g", "t"], "left"), ORDER, "h", "l", leg, label="known")
    want = {(r.g, r.t): r.zigzag for r in whole.collect()}
    assert {(r.g, r.t): r.zigzag for r in again.collect()} == want and len(want) == len(rows)
    assert any(want.values()) and again.columns == ["g", "t", "h", "l", "known", "zigzag"]
    assert zigzag(df.limit(0), ORDER, "h", "l", leg).count() == 0
    with pytest.raises(Exception, match="not finite"):
        zigzag(spark.createDataFrame([(1, 1, math.nan, 1.0)], df.schema), ORDER, "h", "l", leg).collect()


def test_next_high_at_the_end():
    leg = Leg(min_val=1.0)
    assert next_high([1.0, 3.0], [1.0, 3.0], 0, leg, leg) == (1, True, False) and next_high([1.0], [1.0], 0, leg, leg) == (1, False, False)


def test_prefixes_are_pruned_alike():
    for rng, high, _ in walks(8, 120):
        for values in (high, [float(int(x) // 2) for x in high]):
            limits = Limits(rng.choice((0, 1, 2, 4)), rng.choice((math.inf, 8)), min_val=rng.choice((None, 2.0)), max_pct=rng.choice((None, 0.1)))
            sofar = Prefixes(limits)
            for k, x in enumerate(values, 1):
                assert sofar.put(x) == prune(values[:k], turning_marks(values[:k]), limits)[-1]


def test_prefixes_take_time_in_proportion():
    rng, took = random.Random(1), []
    values = [50.0]
    for _ in range(40_000):
        values.append(values[-1] + rng.gauss(0, 1))
    for n in (10_000, 40_000):
        sofar, begun = Prefixes(Limits(3, min_val=1.0)), time.process_time()
        for x in values[:n]:
            sofar.put(x)
        took.append(time.process_time() - begun)
    assert took[1] < 8 * took[0] and took[1] < 60
