"""Knapsacks and subset sums, a problem for each key, solved within the key's task."""

from __future__ import annotations

import math
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _frontier(capacity: float, items: list[tuple[int, float, float]]) -> list[tuple[float, float, tuple | None]]:
    front: list[tuple[float, float, tuple | None]] = [(0.0, 0.0, None)]
    for k, v, w in items:
        both = sorted([*front, *((a + w, b + v, (k, c)) for a, b, c in front if a + w <= capacity + 1e-12)], key=lambda s: (s[0], -s[1]))
        front, best = [], -1.0
        for state in both:
            if state[1] > best:
                front.append(state)
                best = state[1]
    return front


def knapsack(capacity: float, values: list[float], weights: list[float]) -> tuple[float, list[int]]:
    """Highest value within the capacity and the items taken, from a frontier of states none of which another beats."""
    items = [(k, v, w) for k, (v, w) in enumerate(zip(values, weights)) if v > 0 and 0 <= w <= capacity]
    _, value, chain = _frontier(capacity, items)[-1]
    taken = []
    while chain:
        taken.append(chain[0])
        chain = chain[1]
    return value, sorted(taken)


def _scaled(*numbers: float) -> list[int]:
    """The numbers as they are written in decimals, times the power of ten that makes all of them whole."""
    exact = [Decimal(str(x)) for x in numbers]
    places = max(0, *(-x.as_tuple().exponent for x in exact))
    return [int(Fraction(x) * 10**places) for x in exact]


def subset_sum(target: float, items: list[float], below: float = 0.0, above: float = 0.0, count: int | None = None, smallest: bool = False) -> list[int] | None:
    """Positions of items whose sum is in [target - below, target + above], else None; ``count`` of them if given.

    Depth first from the largest item, or from the ``smallest``; the sums of what is left bound the search.  A sum that was reached before with
    the same items left is not followed again, so the search always ends, and None means that there is no such sum.
    Steps and memory are bounded by items x different sums, which may be very many if items have many decimals.
    Nulls, NaN and infinities are not taken.
    """
    order = sorted((k for k, x in enumerate(items) if x is not None and math.isfinite(x)), key=lambda k: items[k] if smallest else -items[k])
    *sizes, goal, under, over, slack = _scaled(*(items[k] for k in order), target, below, above, 1e-9)
    up = [0] * (len(order) + 1)
    down = [0] * (len(order) + 1)
    for k in range(len(order) - 1, -1, -1):
        up[k], down[k] = up[k + 1] + max(0, sizes[k]), down[k + 1] + min(0, sizes[k])
    low, high, seen = goal - under - slack, goal + over + slack, set()
    stack = [(0, 0, None, 0)]
    while stack:
        k, total, chain, n = stack.pop()
        if low <= total <= high and n and (count is None or n == count):
            taken = []
            while chain:
                taken.append(chain[0])
                chain = chain[1]
            return sorted(taken)
        if k == len(order) or total + up[k] < low or total + down[k] > high or (count is not None and n >= count):
            continue
        state = (k, total, n if count is not None else n > 0)
        if state in seen:
            continue
        seen.add(state)
        stack.append((k + 1, total, chain, n))
        stack.append((k + 1, total + sizes[k], (order[k], chain), n + 1))
    return None


def knapsack_by(df: DataFrame, key: str, value: str, weight: str, capacity: float, ident: str) -> DataFrame:
    """(key, total, items): for each key the best load and the ids taken."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(ident, kind="stable")
        total, taken = knapsack(capacity, frame[value].tolist(), frame[weight].tolist())
        return pd.DataFrame({key: [frame[key].iloc[0]], "total": [total], "items": [[int(frame[ident].iloc[k]) for k in taken]]})

    schema = T.StructType([df.schema[key], T.StructField("total", T.DoubleType()), T.StructField("items", T.ArrayType(T.LongType()))])
    return df.groupBy(key).applyInPandas(run, schema)


def subset_sum_by(df: DataFrame, key: str, value: str, target: float, ident: str, below: float = 0.0, above: float = 0.0, count: int | None = None,
                  smallest: bool = False) -> DataFrame:
    """(key, items): for each key the ids of values that add up to the target, null if there are none."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(ident, kind="stable")
        taken = subset_sum(target, frame[value].tolist(), below, above, count, smallest)
        return pd.DataFrame({key: [frame[key].iloc[0]], "items": [None if taken is None else [int(frame[ident].iloc[k]) for k in taken]]})

    return df.groupBy(key).applyInPandas(run, T.StructType([df.schema[key], T.StructField("items", T.ArrayType(T.LongType()))]))


def knapsack_whole(capacity: int, values: list[float], weights: list[int]) -> float:
    """Highest value for whole weights: one array over the capacities."""
    best = np.zeros(int(capacity) + 1)
    for v, w in zip(values, weights):
        if v > 0 and 0 <= w <= capacity:
            # the right side is computed in full before it is assigned, so an item counts once
            best[int(w) :] = np.maximum(best[int(w) :], best[: len(best) - int(w)] + v)
    return float(best[-1])


def knapsack_value_by(df: DataFrame, key: str, value: str, weight: str, capacity: float, whole: bool = True) -> DataFrame:
    """(key, total): for each key the highest value within the capacity."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        v, w = frame[value].tolist(), frame[weight].tolist()
        return pd.DataFrame({key: [frame[key].iloc[0]], "total": [knapsack_whole(int(capacity), v, w) if whole else knapsack(capacity, v, w)[0]]})

    return df.groupBy(key).applyInPandas(run, T.StructType([df.schema[key], T.StructField("total", T.DoubleType())]))


def nearest_sum_by(df: DataFrame, key: str, value: str, target: float) -> DataFrame:
    """(key, total): the largest sum of some of each key's positive values that is not over the target.

    The sums that can be reached are the bits of one number, so the work is bounded by items x target in units.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        *sizes, goal = _scaled(*(x for x in frame[value].dropna() if x > 0), target)
        mask, reach = (1 << goal + 1) - 1, 1
        for x in sizes:
            reach |= reach << x & mask if x <= goal else 0
        return pd.DataFrame({key: [frame[key].iloc[0]], "total": [(reach.bit_length() - 1) * target / goal if goal else 0.0]})

    return df.groupBy(key).applyInPandas(run, T.StructType([df.schema[key], T.StructField("total", T.DoubleType())]))


def candidates(df: DataFrame, value: str, target: float, tolerance: float = 0.0) -> DataFrame:
    """The rows whose value alone is not over the target."""
    return df.where(F.col(value) <= target + tolerance)
