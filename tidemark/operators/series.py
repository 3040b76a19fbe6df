"""Operators on ordered series: runs, gaps, last matches, segments, turning points.

Each takes a DataFrame, an :class:`Order` and conditions as Columns, adds one column and plans as window expressions
over one exchange and sort on the key, whatever the number of rows.  Rules that depend on the row kept last are folds
over a key's rows and run as ``applyInPandas`` on the key.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .order import Order, flag

_TMP = "__seg"


def con_count(df: DataFrame, order: Order, cond: Column, out: str = "con_count") -> DataFrame:
    """Length so far of the streak of rows that meet ``cond``; 0 on other rows."""
    seg = df.withColumn("__c", flag(cond)).withColumn(_TMP, F.sum(1 - F.col("__c")).over(order.to_here()))
    return seg.withColumn(out, F.when(F.col("__c") == 1, F.sum("__c").over(order.to_here(_TMP))).otherwise(F.lit(0)).cast("long")).drop("__c", _TMP)


def con_count_ignore(df: DataFrame, order: Order, cond: Column, ignore: Column, out: str = "con_count") -> DataFrame:
    """As con_count, but rows to ignore get 0 and do not break a streak."""
    seg = df.withColumns({"__i": flag(ignore), "__c": flag(cond & ~F.coalesce(ignore, F.lit(False)))})
    seg = seg.withColumn(_TMP, F.sum((1 - F.col("__c")) * (1 - F.col("__i"))).over(order.to_here()))
    return seg.withColumn(out, F.when(F.col("__c") == 1, F.sum("__c").over(order.to_here(_TMP))).otherwise(F.lit(0)).cast("long")).drop("__c", "__i", _TMP)


def previous_match(df: DataFrame, order: Order, value: str, cond: Column, out: str = "preval") -> DataFrame:
    """``value`` at the last earlier row that meets ``cond``; null before the first."""
    return df.withColumn(out, F.last(F.when(cond, F.col(value)), ignorenulls=True).over(order.before()))


def gap_count(df: DataFrame, order: Order, cond: Column, out: str = "gap") -> DataFrame:
    """Rows since the last earlier row that meets ``cond``; 0 where there is none."""
    numbered = df.withColumn("__rn", order.row())
    last = F.last(F.when(cond, F.col("__rn")), ignorenulls=True).over(order.before())
    return numbered.withColumn(out, F.coalesce(F.col("__rn") - last, F.lit(0).cast("long"))).drop("__rn")


def count_between_gap(df: DataFrame, order: Order, gap: Column, count: Column, now_gap: bool = False, now: bool = True, out: str = "count") -> DataFrame:
    """Rows that meet ``count`` since the last row that meets ``gap``; 0 before the first.

    now_gap: a gap row shows the count that it ends; now: the row itself counts.
    """
    w = order.window()
    base = df.withColumns({"__g": flag(gap), "__n": flag(count)}).withColumn(_TMP, F.sum("__g").over(order.to_here()))
    base = base.withColumns({
        "__b": F.when((F.col("__g") == 1) | (F.col(_TMP) == 0), 0).otherwise(F.sum(F.col("__n") * (1 - F.col("__g"))).over(order.to_here(_TMP))),
        "__p": F.coalesce(F.lag("__g").over(w), F.lit(0))})
    if now_gap:
        ended = F.when(F.col("__p") == 1, F.col("__n")).otherwise(F.lag("__b").over(w) + F.col("__n"))
        base = base.withColumn("__b2", F.when((F.col("__g") == 1) & (F.col(_TMP) > 1), ended).otherwise(F.col("__b")))
    else:
        base = base.withColumn("__b2", F.col("__b"))
    result = F.col("__b2")
    if not now:
        result = F.when(F.col("__p" if now_gap else "__g") == 1, 0).otherwise(F.coalesce(F.lag("__b2").over(w), F.lit(0)))
    return base.withColumn(out, result.cast("long")).drop("__g", "__n", _TMP, "__b", "__p", "__b2")


def val_gap_cond(df: DataFrame, order: Order, value: Column, cond: Column, agg: Callable[[Column], Column] = F.max,
                 where: Column | None = None, contain_first: bool = False, out: str = "val_gap") -> DataFrame:
    """Aggregate of ``value`` over the rows behind the last row that met ``cond``, up to this row.

    contain_first: the row that met ``cond`` is among them.  Null before the first such row and where ``where`` fails.
    """
    seg = df.withColumns({"__c": flag(cond), "__v": value}).withColumn(_TMP, F.coalesce(F.sum("__c").over(order.before()), F.lit(0)))
    if contain_first:
        opened = F.last(F.when(F.col("__c") == 1, F.struct(F.col("__v").alias("v"))), ignorenulls=True).over(order.before())
        seg = seg.withColumn("__o", opened)
        run = agg("__v").over(order.to_here(_TMP))
        opening = F.col("__o.v")
        if agg is F.max:
            run = F.greatest(run, opening)
        elif agg is F.min:
            run = F.least(run, opening)
        elif agg is F.sum:
            run = F.when(run.isNull() & opening.isNull(), None).otherwise(F.coalesce(run, opening * 0) + F.coalesce(opening, F.lit(0)))
        elif agg is F.count:
            run = run + flag(opening.isNotNull())
        elif agg is F.avg:
            total = F.coalesce(F.sum("__v").over(order.to_here(_TMP)), F.lit(0)) + F.coalesce(opening, F.lit(0))
            run = F.try_divide(total, F.count("__v").over(order.to_here(_TMP)) + flag(opening.isNotNull()))
        else:
            raise ValueError("contain_first needs max, min, sum, count or avg")
    else:
        run = agg("__v").over(order.to_here(_TMP))
    keep = (F.col(_TMP) > 0) & (where if where is not None else F.lit(True))
    return seg.withColumn(out, F.when(keep, run)).drop("__c", "__v", "__o", _TMP)


def replace_repeat(df: DataFrame, order: Order, col: str, hit: Column, filler: Column, other: Column, keep_last: bool = False, out: str | None = None) -> DataFrame:
    """Of each run of hits only the first (last) stays, later ones become ``filler``; fillers do not break a run.

    ``other`` says of a row that it holds a filler.
    """
    w = order.window(descending=keep_last).rowsBetween(Window.unboundedPreceding, -1)
    kind = df.withColumns({"__h": flag(hit), "__f": flag(other)})
    before = F.last(F.when(F.col("__f") == 0, F.col("__h")), ignorenulls=True).over(w)
    return kind.withColumn("__p", before).withColumn(out or col, F.when((F.col("__h") == 1) & (F.col("__p") == 1), filler).otherwise(F.col(col))).drop("__h", "__f", "__p")


def replace_repeat_gap(df: DataFrame, order: Order, col: str, val, val0, gap: int, keep_last: bool = False) -> DataFrame:
    """As replace_repeat with values, but a hit stays again from ``gap`` rows behind the one kept on; 1 is no limit.

    ``val`` is the value of hits or says of a value whether it is one, ``val0`` what hits become or gives it for a value.
    """
    hit = val if callable(val) else lambda x: x == val
    filler = val0 if callable(val0) else lambda x: val0

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(list(order.by), ascending=not keep_last, kind="stable")
        out, kept = [], None
        for n, x in enumerate(frame[col].tolist()):
            if hit(x):
                if kept is not None and (gap == 1 or n - kept < gap):
                    out.append(filler(x))
                    continue
                kept = n
            elif x != filler(x):
                kept = None
            out.append(x)
        return frame.assign(**{col: out})

    return df.groupBy(*order.key).applyInPandas(fold, df.schema)


def segments(df: DataFrame, order: Order, by: str, out: str = "segment") -> DataFrame:
    """Number from 0 of the stretch of equal ``by`` values (nulls are equal) that a row is in."""
    moved = df.withColumn("__l", F.lag(F.struct(F.col(by).alias("v"))).over(order.window()))
    new = F.when(F.col("__l").isNull(), 0).when(F.col("__l.v").eqNullSafe(F.col(by)), 0).otherwise(1)
    return moved.withColumn(out, F.sum(new).over(order.to_here()).cast("long")).drop("__l")


def run_bounds(df: DataFrame, order: Order, cond: Column, begin: str = "start", end: str = "end") -> DataFrame:
    """(key, start, end): row numbers from 0 of the first and last row of each run that meets ``cond``."""
    seg = df.withColumns({"__c": flag(cond), "__rn": order.row() - 1}).withColumn(_TMP, F.sum(1 - F.col("__c")).over(order.to_here()))
    return seg.where("__c = 1").groupBy(*order.key, _TMP).agg(F.min("__rn").alias(begin), F.max("__rn").alias(end)).drop(_TMP)


def first_match(df: DataFrame, order: Order, cond: Column, value: str, reverse: bool = False, out: str = "value", position: str = "position") -> DataFrame:
    """(key, value, position from 0) at the first (last) row of each key that meets ``cond``; keys without one are left out."""
    hit = df.withColumn("__rn", order.row() - 1).where(cond)
    pick = F.max_by if reverse else F.min_by
    return hit.groupBy(*order.key).agg(pick(value, "__rn").alias(out), (F.max("__rn") if reverse else F.min("__rn")).alias(position))


def appear_order(df: DataFrame, order: Order, value: str, ascending: bool = True, out: str = "nth") -> DataFrame:
    """How many times the value has come up to and with this row (from the end, if descending)."""
    return df.withColumn(out, F.row_number().over(order.window(value, descending=not ascending)).cast("long"))


def label_repeats(df: DataFrame, order: Order, label: str, out: str | None = None) -> DataFrame:
    """Labels with _2, _3, ... behind repeats."""
    n = F.row_number().over(order.window(label))
    return df.withColumn("__n", n).withColumn(out or label, F.when(F.col("__n") > 1, F.concat_ws("_", F.col(label).cast("string"), "__n")).otherwise(F.col(label).cast("string"))).drop("__n")


def drop_repeats(df: DataFrame, order: Order, cols: list[str], keep: str = "first") -> DataFrame:
    """One row of each value of ``cols`` within the key: the first or the last in order; keep='none' drops all repeats."""
    if keep == "none":
        return df.withColumn("__n", F.count(F.lit(1)).over(order.whole(*cols))).where("__n = 1").drop("__n")
    return df.withColumn("__n", F.row_number().over(order.window(*cols, descending=keep == "last"))).where("__n = 1").drop("__n")


def count_values(df: DataFrame, cols: list[str], out: str = "n") -> DataFrame:
    """How many rows have this row's values of ``cols``; null where one of them is null.

    The counts are aggregated first and joined back, so a value that fills much of the table is split by adaptive
    skew handling, which a window over it could not be.
    """
    counts = df.groupBy(*cols).agg(F.count(F.lit(1)).alias(out)).dropna(subset=cols)
    return df.join(counts, cols, "left")


def turns(df: DataFrame, order: Order, col: str, out: str = "turn") -> DataFrame:
    """1 at peaks, -1 at troughs (a plateau at its first row), 0 elsewhere; both ends are labelled."""
    step = df.withColumn("__s", F.signum(F.col(col).cast("double") - F.lag(F.col(col).cast("double")).over(order.window())).cast("int"))
    step = step.withColumn("__n", F.first(F.when(F.col("__s") != 0, F.col("__s")), ignorenulls=True).over(order.after()))
    label = F.when(F.col("__s").isNull(), F.coalesce(-F.col("__n"), F.lit(0))).when((F.col("__s") != 0) & (F.col("__n").isNull() | (F.col("__n") != F.col("__s"))), F.col("__s")).otherwise(0)
    return step.withColumn(out, label.cast("int")).drop("__s", "__n")


def chain_filter(df: DataFrame, order: Order, col: str, keeps: Callable[[object, object], bool], ignores: Callable[[object], bool] | None = None, out: str = "kept") -> DataFrame:
    """The chain that keeps the first row, then each next one y with ``keeps(last kept, y)``; others become null.

    Rows that ``ignores`` holds for stay as they are and are no part of the chain.
    """

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(list(order.by), kind="stable")
        res, last, begun = [], None, False
        for x in frame[col].tolist():
            if ignores is not None and ignores(x):
                res.append(x)
            elif not begun or keeps(last, x):
                res.append(x)
                last, begun = x, True
            else:
                res.append(None)
        return frame.assign(**{out: pd.Series(res, index=frame.index, dtype=object)})

    schema = T.StructType([*df.schema.fields, T.StructField(out, df.schema[col].dataType, True)])
    return df.groupBy(*order.key).applyInPandas(fold, schema)


def shift(df: DataFrame, order: Order, col: str, n: int = 1, out: str = "shifted") -> DataFrame:
    return df.withColumn(out, (F.lag(col, n) if n >= 0 else F.lead(col, -n)).over(order.window()))


def fill(df: DataFrame, order: Order, col: str, method: str = "ffill", value=None, out: str | None = None) -> DataFrame:
    """Nulls become the last value before (ffill), the next one behind (bfill), the first of both, or ``value``."""
    forth = F.last(col, ignorenulls=True).over(order.to_here())
    back = F.first(col, ignorenulls=True).over(order.window().rowsBetween(0, Window.unboundedFollowing))
    how = {"ffill": forth, "bfill": back, "both": F.coalesce(forth, back)}.get(method)
    return df.withColumn(out or col, F.coalesce(F.col(col), F.lit(value)) if how is None else how)


def group_rank(df: DataFrame, key: list[str], col: str, method: str = "average", ascending: bool = True, pct: bool = False, tie: list[str] | None = None, out: str = "rank") -> DataFrame:
    """Rank of ``col`` within the key: average, min, max, dense or first (ties by ``tie``); nulls have none.

    All but ``first`` rank the distinct values, which are counted first, and join the ranks back; so a key with very
    many rows is no single task as long as its values repeat.
    """
    by = F.col(col).asc() if ascending else F.col(col).desc()
    if method == "first":
        w = Window.partitionBy(*key, F.col(col).isNull()).orderBy(by, *(tie or []))
        rank = F.row_number().over(w).cast("double")
        rank = rank / F.count(F.lit(1)).over(Window.partitionBy(*key, F.col(col).isNull())) if pct else rank
        return df.withColumn(out, F.when(F.col(col).isNotNull(), rank))
    values = df.where(F.col(col).isNotNull()).groupBy(*key, col).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*key).orderBy(by)
    upto = F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0))
    rank = {"min": upto - F.col("__n") + 1, "max": upto, "dense": F.row_number().over(w), "average": upto - (F.col("__n") - 1) / 2.0}[method].cast("double")
    if pct:
        whole = Window.partitionBy(*key)
        rank = rank / (F.count(F.lit(1)) if method == "dense" else F.sum("__n")).over(whole)
    ranks = values.select(*key, col, rank.alias(out))
    return df.join(ranks.withColumnsRenamed({c: f"__k_{c}" for c in [*key, col]}), [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in [*key, col]], "left").drop(*[f"__k_{c}" for c in [*key, col]])


def pct_change(df: DataFrame, order: Order, col: str, lag: int = 1, out: str = "pct") -> DataFrame:
    """Change against the value ``lag`` rows before, over that value's magnitude; null where it is 0 or missing."""
    before = F.lag(F.col(col).cast("double"), lag).over(order.window())
    return df.withColumn(out, F.try_divide(F.col(col) - before, F.abs(before)))


def rolling_corr(df: DataFrame, order: Order, a: str, b: str, n: int, out: str = "corr") -> DataFrame:
    """Correlation of two columns over the last ``n`` rows, null until there are ``n`` and where one of them does not vary.

    ``F.corr`` divides by zero there, which ANSI mode makes an error; so the quotient is written out, over rows with both values.
    """
    w = order.last(n)
    x, y = F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))
    corr = F.try_divide(F.covar_pop(x, y).over(w), F.stddev_pop(x).over(w) * F.stddev_pop(y).over(w))
    return df.withColumn(out, F.when(F.count(F.lit(1)).over(w) == n, corr))


def group_rolling(df: DataFrame, order: Order, col: str, n: int, agg: Callable[[Column], Column], least: int | None = None, out: str = "rolled") -> DataFrame:
    """An aggregate over the last ``n`` rows of the key, null with fewer than ``least`` (default ``n``) values."""
    w = order.last(n)
    return df.withColumn(out, F.when(F.count(col).over(w) >= (n if least is None else least), agg(F.col(col)).over(w)))
