"""All sets of a key's values that add up to a target within bounds: how many there are, and which, by ranges of them.

The sets of one key are numbered.  Their number and any stretch of them follow from one of two tables:

*   a layered graph: for each item the sums that some of the items before reach and from which the bounds can still be
    reached, with the number of ways to go on; small where sums coincide, as with whole numbers and few decimals;
*   meet in the middle: all sums of the first half of the items, and those of the second half in order, so that a first
    half's partners are a stretch of it; 2 to the half of the items, whatever the values.

The smaller one is taken.  Listing is dealt over tasks by stretches of a key's numbers, so one key with very many sets is
listed by many tasks, each of which makes the key's table anew.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .solve import _scaled


class Layers:
    """The layered graph; a set with the first item has a lower number than one without it."""

    def __init__(self, sizes: list[int], low: int, high: int, most: int | None = None):
        n = len(sizes)
        up, down = [0] * (n + 1), [0] * (n + 1)
        for k in range(n - 1, -1, -1):
            up[k], down[k] = up[k + 1] + max(0, sizes[k]), down[k + 1] + min(0, sizes[k])
        fits = lambda k, s: s + up[k] >= low and s + down[k] <= high
        reach, held = [{0} if fits(0, 0) else set()], 1
        for k, x in enumerate(sizes):
            reach.append({s for t in reach[-1] for s in (t, t + x) if fits(k + 1, s)})
            held += len(reach[-1])
            if most is not None and held > most:
                raise OverflowError
        self.sizes, self.ways = sizes, [dict.fromkeys(reach[n], 1)]
        for k in range(n - 1, -1, -1):
            ahead = self.ways[-1]
            self.ways.append({s: ahead.get(s, 0) + ahead.get(s + sizes[k], 0) for s in reach[k]})
        self.ways.reverse()
        # the empty set is the last one, as it takes no item, and it is none
        self.count = self.ways[0].get(0, 0) - (low <= 0 <= high)

    def set_of(self, number: int) -> list[int]:
        total, out = 0, []
        for k, x in enumerate(self.sizes):
            with_it = self.ways[k + 1].get(total + x, 0)
            if number < with_it:
                out.append(k)
                total += x
            else:
                number -= with_it
        return out


class Halves:
    """Meet in the middle; sets are numbered by their part in the first half, then by the sum of the other part."""

    def __init__(self, sizes: list[int], low: int, high: int):
        self.half = len(sizes) // 2
        first, second = (self._sums(part) for part in (sizes[: self.half], sizes[self.half :]))
        self.order = np.argsort(second, kind="stable")
        ordered = second[self.order]
        self.begin = np.searchsorted(ordered, low - first)
        size = np.searchsorted(ordered, high - first, "right") - self.begin
        # the empty set (no first half, place 0 of the second) is none: its place in the stretch is passed over
        self.empty = int(np.flatnonzero(self.order == 0)[0]) - int(self.begin[0]) if low <= 0 <= high else None
        size[0] -= self.empty is not None
        self.ends = np.cumsum(size)
        self.count = int(self.ends[-1])

    @staticmethod
    def _sums(sizes: list[int]) -> np.ndarray:
        out = np.zeros(1, np.int64)
        for x in sizes:
            out = np.concatenate([out, out + x])
        return out

    def set_of(self, number: int) -> list[int]:
        left = int(np.searchsorted(self.ends, number, "right"))
        at = number - (int(self.ends[left - 1]) if left else 0)
        at += left == 0 and self.empty is not None and at >= self.empty
        right = int(self.order[int(self.begin[left]) + at])
        return [k for k in range(self.half) if left >> k & 1] + [self.half + k for k in range(right.bit_length()) if right >> k & 1]


@lru_cache(maxsize=8)
def sets_table(values: tuple[float, ...], target: float, below: float = 0.0, above: float = 0.0) -> Layers | Halves:
    *sizes, goal, under, over = _scaled(*values, target, below, above)
    low, high, n = goal - under, goal + over, len(values)
    try:
        return Layers(sizes, low, high, 4 << (n + 1) // 2 if n < 48 and sum(map(abs, sizes)) + abs(goal) < 1 << 62 else None)
    except OverflowError:
        return Halves(sizes, low, high)


def _problems(df: DataFrame, key: str, value: str, ident: str) -> DataFrame:
    """(key, ids, values): each key's items in the order of their ids; nulls, NaN and infinities are no items."""
    x = F.col(value).cast("double")
    some = df.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    items = F.sort_array(F.collect_list(F.struct(F.col(ident).cast("long").alias("i"), x.alias("x"))))
    return some.groupBy(key).agg(items.alias("__items")).select(key, F.col("__items.i").alias("__ids"), F.col("__items.x").alias("__values"))


def count_sums_by(df: DataFrame, key: str, value: str, target: float, ident: str, below: float = 0.0, above: float = 0.0) -> DataFrame:
    """(key, sets): how many different sets of each key's rows have a sum in [target - below, target + above]."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            counts = [str(sets_table(tuple(v), target, below, above).count) for v in frame["__values"]]
            yield frame[[key]].assign(sets=counts)

    counted = _problems(df, key, value, ident).mapInPandas(run, T.StructType([df.schema[key], T.StructField("sets", T.StringType())]))
    return counted.withColumn("sets", F.col("sets").cast("decimal(38,0)"))


def sums_by(df: DataFrame, key: str, value: str, target: float, ident: str, below: float = 0.0, above: float = 0.0, first: int = 0, last: int | None = None,
            stretch: int = 20_000) -> DataFrame:
    """(key, items): the sets of each key's rows whose sum is in [target - below, target + above], as sorted ids.

    All of them, or those numbered from ``first`` to before ``last`` in each key.
    """
    wanted = _problems(df, key, value, ident)
    counts = count_sums_by(df, key, value, target, ident, below, above).withColumnRenamed("sets", "__n")
    upto = F.col("__n") if last is None else F.least(F.col("__n"), F.lit(last).cast("decimal(38,0)"))
    starts = F.when(upto > first, F.sequence(F.lit(first).cast("long"), (upto - 1).cast("long"), F.lit(stretch).cast("long"))).otherwise(F.array().cast("array<long>"))
    dealt = counts.select(F.col(key).alias("__key"), upto.cast("long").alias("__upto"), F.explode(starts).alias("__from"))
    parts = dealt.repartition("__key", "__from").join(wanted, F.col("__key").eqNullSafe(F.col(key))).select(key, "__ids", "__values", "__from", F.least(F.col("__upto"), F.col("__from") + stretch).alias("__to"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keys, found = [], []
            for k, ids, values, begin, end in frame.itertuples(index=False):
                table = sets_table(tuple(values), target, below, above)
                found += [[int(ids[i]) for i in table.set_of(n)] for n in range(begin, end)]
                keys += [k] * (end - begin)
                if len(found) >= stretch:
                    yield pd.DataFrame({key: pd.Series(keys, dtype=frame[key].dtype), "items": pd.Series(found, dtype=object)})
                    keys, found = [], []
            yield pd.DataFrame({key: pd.Series(keys, dtype=frame[key].dtype), "items": pd.Series(found, dtype=object)})

    return parts.mapInPandas(run, T.StructType([df.schema[key], T.StructField("items", T.ArrayType(T.LongType()))]))


def last_fitting(values: Column, target: float, tol: float = 0.0) -> Column:
    """Place (from 0) of the last value of an array that is not over the target by more than ``tol``; the first place if
    none is, -1 for an empty array."""
    fits = F.filter(F.transform(values, lambda x, k: F.when((x <= target) | (x - target <= tol), k)), lambda k: k.isNotNull())
    return F.when(F.size(values) == 0, -1).when(values.isNotNull(), F.coalesce(F.array_max(fits), F.lit(0)))
