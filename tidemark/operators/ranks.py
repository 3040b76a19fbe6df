"""Ranks of each value among those so far in its key, whatever the size of the key.

The rank of a row follows from how many earlier rows of its key have a smaller value, and how many the same.  Keys of up
to ``block`` rows are dealt into buckets, whose rows are counted in one pass of array operations over all keys of the
bucket.  Larger keys are cut twice, in blocks of ``block`` rows by position and in ranges of about ``block`` rows by value,
and the earlier smaller rows are counted in three parts:

1.  those in earlier blocks and lower ranges: sums over the table of rows by block and range;
2.  those in the same block: the block's own pass;
3.  those in earlier blocks and the same range: the range's own pass (a range of a single value has none).

So no task holds a key, nor a value that most of its rows have.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .order import Order
from .ranges import running, same

RANKS = ("min", "max", "average", "first", "dense")


def earlier_less(codes: np.ndarray, point: np.ndarray) -> np.ndarray:
    """For each place of ``codes`` (whole numbers from 0), how many earlier places with ``point`` have a smaller code."""
    n = len(codes)
    out, place, width, span = np.zeros(n, np.int64), np.arange(n), 1, int(codes.max(initial=0)) + 1
    while width < n:
        pair, right = place // (2 * width), (place // width) % 2 == 1
        left = np.sort(pair[~right & point] * span + codes[~right & point])
        base = pair[right] * span
        out[right] += np.searchsorted(left, base + codes[right]) - np.searchsorted(left, base)
        width *= 2
    return out


def _codes(group: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Codes of values that are smaller in later groups, so that rows of earlier groups never count as smaller."""
    kinds = np.unique(values, return_inverse=True)[1].reshape(-1)
    return np.unique((group.max(initial=0) - group) * (len(values) + 1) + kinds, return_inverse=True)[1].reshape(-1)


def _ranked(less: np.ndarray, ties: np.ndarray, method: str) -> np.ndarray:
    """less: smaller rows before (dense: smaller values before); ties: equal rows so far, the row itself included."""
    return {"min": less + 1, "dense": less + 1, "max": less + ties, "first": less + ties, "average": less + (ties + 1) / 2}[method].astype(float)


def cum_rank(df: DataFrame, order: Order, col: str, method: str = "dense", ascending: bool = True, out: str = "rank", block: int = 32_768) -> DataFrame:
    """Rank of each value among those so far in its key (ties by ``method``); null rows have none and do not count."""
    if method not in RANKS:
        raise ValueError(f"method must be one of {RANKS}")
    value = F.nanvl(F.col(col).cast("double"), F.lit(None).cast("double"))
    rows = df.withColumn("__v", value if ascending else -value)
    keys = list(order.key)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")) if keys else df.agg(F.count(F.lit(1)).alias("__n"))
    total, most = sizes.agg(F.sum("__n"), F.max("__n")).first()
    if (most or 0) <= block:
        return _by_bucket(rows, df, order, method, out, max(1, -(-(total or 0) // block)))
    held = sizes.withColumnsRenamed({k: f"__k_{k}" for k in keys})
    sized = rows.join(held, same(keys, [f"__k_{k}" for k in keys]))
    small = sized.where(F.col("__n") <= block).select(*rows.columns)
    large = sized.where(F.col("__n") > block).select(*rows.columns)
    return _by_bucket(small, df, order, method, out, -(-total // block)).unionByName(_by_block(large, df, order, method, out, block))


def _schema(df: DataFrame, out: str) -> T.StructType:
    return T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])


def _by_bucket(rows: DataFrame, df: DataFrame, order: Order, method: str, out: str, buckets: int) -> DataFrame:
    keys, by, names = list(order.key), list(order.by), df.columns

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(by, kind="stable").reset_index(drop=True)
        group = frame.groupby(keys, dropna=False, sort=False).ngroup().to_numpy() if keys else np.zeros(len(frame), np.int64)
        order = np.argsort(group, kind="stable")
        v = frame["__v"].to_numpy(float)[order]
        some = ~np.isnan(v)
        codes = _codes(group[order][some], v[some])
        ties = pd.Series(codes).groupby(codes).cumcount().to_numpy() + 1
        rank = np.full(len(frame), np.nan)
        rank[order[some]] = _ranked(earlier_less(codes, ties == 1 if method == "dense" else np.ones(len(codes), bool)), ties, method)
        return frame[names].assign(**{out: pd.Series(rank).astype("Float64").mask(np.isnan(rank))})

    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)) if keys else F.lit(0)
    return rows.groupBy(bucket.alias("__bucket")).applyInPandas(fold, _schema(df, out))


def _by_block(rows: DataFrame, df: DataFrame, order: Order, method: str, out: str, block: int) -> DataFrame:
    keys, names, dense = list(order.key), df.columns, method == "dense"
    placed = running(rows, keys, list(order.by), __rn=F.lit(1)).withColumn("__b", F.floor((F.col("__rn") - 1) / block))
    some, none = placed.where("__v IS NOT NULL"), placed.where("__v IS NULL")
    counted = some.groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__c"), F.min("__rn").alias("__first"))
    values = running(counted, keys, ["__v"], __upto=F.col("__c"))
    before, heavy = F.col("__upto") - F.col("__c"), F.col("__c") >= block
    values = values.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__v").alias("__w"), "__first", (2 * F.floor(before / block) + F.when(heavy, 1).otherwise(0)).alias("__r"), heavy.alias("__heavy"))
    found = some.join(values, same([*keys, "__v"], [*[f"__k_{k}" for k in keys], "__w"])).withColumn("__point", F.lit(True) if not dense else F.col("__rn") == F.col("__first"))
    found = cut(found.select(*rows.columns, "__rn", "__b", "__r", "__heavy", "__point"))

    cells = found.groupBy(*keys, "__r", "__b").agg(F.count_if("__point").alias("__c"))
    blocks = cells.groupBy(*[F.col(k).alias(f"__k_{k}") for k in keys]).agg(F.max("__b").alias("__last"))
    grid = cells.select(*keys, "__r").distinct().join(blocks, same(keys, [f"__k_{k}" for k in keys])).select(*keys, "__r", F.explode(F.sequence(F.lit(0).cast("long"), "__last")).alias("__b"))
    cell_names = [*keys, "__r", "__b"]
    renamed = cells.withColumnsRenamed({c: f"__j_{c}" for c in cell_names})
    grid = grid.join(renamed, same(cell_names, [f"__j_{c}" for c in cell_names]), "left").select(*cell_names, F.coalesce("__c", F.lit(0)).alias("__c"))
    earlier = grid.withColumn("__c", F.coalesce(F.sum("__c").over(Window.partitionBy(*keys, "__r").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    lower = earlier.withColumn("__part1", F.coalesce(F.sum("__c").over(Window.partitionBy(*keys, "__b").orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    part1 = lower.select(*[F.col(c).alias(f"__j_{c}") for c in cell_names], "__part1")

    tie_names = [*keys, "__v", "__b"]
    per = found.groupBy(*tie_names).agg(F.count(F.lit(1)).alias("__c"))
    past = F.sum("__c").over(Window.partitionBy(*keys, "__v").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    ties = per.select(*[F.col(c).alias(f"__i_{c}") for c in tie_names], F.coalesce(past, F.lit(0)).alias("__ties"))

    def in_range(frame: pd.DataFrame) -> pd.DataFrame:
        """Earlier blocks count, not the own one: within a block larger values come first."""
        frame = frame.sort_values(["__b", "__v"], ascending=[True, False], kind="stable")
        codes = np.unique(frame["__v"].to_numpy(), return_inverse=True)[1].reshape(-1)
        return frame[[*keys, "__rn"]].assign(__part3=earlier_less(codes, frame["__point"].to_numpy(bool)))

    at = [*keys, "__rn"]
    part3 = found.where("NOT __heavy").select(*at, "__b", "__v", "__r", "__point").groupBy(*keys, "__r").applyInPandas(in_range, T.StructType([*[df.schema[k] for k in keys], T.StructField("__rn", T.LongType()), T.StructField("__part3", T.LongType())]))
    part3 = part3.withColumnsRenamed({c: f"__h_{c}" for c in at})
    joined = (found.join(part1, same(cell_names, [f"__j_{c}" for c in cell_names])).join(ties, same(tie_names, [f"__i_{c}" for c in tie_names]))
              .join(part3, same(at, [f"__h_{c}" for c in at]), "left").withColumn("__less", F.col("__part1") + F.coalesce("__part3", F.lit(0))))

    def in_block(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("__rn", kind="stable").reset_index(drop=True)
        codes = np.unique(frame["__v"].to_numpy(), return_inverse=True)[1].reshape(-1)
        ties = pd.Series(codes).groupby(codes).cumcount().to_numpy() + 1 + frame["__ties"].to_numpy()
        less = earlier_less(codes, frame["__point"].to_numpy(bool)) + frame["__less"].to_numpy()
        return frame[names].assign(**{out: _ranked(less, ties, method)})

    ranked = joined.select(*rows.columns, "__rn", "__b", "__point", "__less", "__ties").groupBy(*keys, "__b").applyInPandas(in_block, _schema(df, out))
    return ranked.unionByName(none.select(*names, F.lit(None).cast("double").alias(out)))
