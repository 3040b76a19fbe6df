"""Cleaning and scaling: winsorising, normalising, filling, dropping what is mostly missing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import Order, names


def with_stats(df: DataFrame, key: list[str], stats: dict[str, Column]) -> DataFrame:
    """Each row with its group's statistics: one aggregation, joined back (one row, without a key)."""
    if key:
        small = df.groupBy(*key).agg(*[c.alias(n) for n, c in stats.items()])
        return df.join(small, key)
    return df.join(F.broadcast(df.agg(*[c.alias(n) for n, c in stats.items()])))


def cut_mad(df: DataFrame, col: str, n: float = 3, key: list[str] | None = None, high=None, low=None, where: Column | None = None, out: str | None = None) -> DataFrame:
    """Values beyond the median by more than n * 1.483 median absolute deviations become that bound, or ``high``/``low``."""
    x = F.when(where, F.col(col)) if where is not None else F.col(col)
    mid = with_stats(df.withColumn("__x", x), key or [], {"__m": F.median("__x")})
    mad = with_stats(mid.withColumn("__d", F.abs(F.col("__x") - F.col("__m"))), key or [], {"__mad": F.median("__d")})
    width = F.col("__mad") * (1.483 * n)
    up, down = F.col("__m") + width, F.col("__m") - width
    y = F.when(F.col(col) > up, up if high is None else F.lit(high)).when(F.col(col) < down, down if low is None else F.lit(low)).otherwise(F.col(col))
    return mad.withColumn(out or col, y).drop("__x", "__m", "__d", "__mad")


def cut_nstd(df: DataFrame, col: str, n: float = 3, key: list[str] | None = None, high=None, low=None, out: str | None = None) -> DataFrame:
    """As cut_mad with the mean and n sample standard deviations."""
    s = with_stats(df, key or [], {"__m": F.avg(col), "__s": F.stddev_samp(col)})
    up, down = F.col("__m") + n * F.col("__s"), F.col("__m") - n * F.col("__s")
    y = F.when(F.col(col) > up, up if high is None else F.lit(high)).when(F.col(col) < down, down if low is None else F.lit(low)).otherwise(F.col(col))
    return s.withColumn(out or col, y).drop("__m", "__s")


def standard(df: DataFrame, col: str, key: list[str] | None = None, ddof: int = 1, reverse: bool = False, out: str | None = None) -> DataFrame:
    """Standard scores; null where the deviation is 0."""
    s = with_stats(df, key or [], {"__m": F.avg(col), "__s": F.stddev_samp(col) if ddof == 1 else F.stddev_pop(col)})
    gap = F.col("__m") - F.col(col) if reverse else F.col(col) - F.col("__m")
    return s.withColumn(out or col, F.try_divide(gap, F.col("__s"))).drop("__m", "__s")


def linear(x: Column, xmin, xmax, ymin: float = 0, ymax: float = 1, reverse: bool = False, strict: bool = True, flat=None) -> Column:
    """[xmin, xmax] to [ymin, ymax]; ``flat`` where both ends are the same; strict: values outside are an error."""
    a, b = (v if isinstance(v, Column) else F.lit(v) for v in (xmin, xmax))
    share = F.try_divide((b - x) if reverse else (x - a), b - a)
    y = F.when(a == b, F.lit(flat).cast("double")).otherwise(ymin + share * (ymax - ymin))
    return F.when((x < a) | (x > b), F.raise_error(F.lit("a value is out of its range")).cast("double")).otherwise(y) if strict else y


def series_linear(df: DataFrame, col: str, key: list[str] | None = None, ymin: float = 0, ymax: float = 1, reverse: bool = False, out: str | None = None) -> DataFrame:
    s = with_stats(df, key or [], {"__a": F.min(col), "__b": F.max(col)})
    return s.withColumn(out or col, linear(F.col(col), F.col("__a"), F.col("__b"), ymin, ymax, reverse, strict=False)).drop("__a", "__b")


def middle(x: Column, xmin: float, xmax: float, ymin: float = 0, ymax: float = 1, best: float | None = None) -> Column:
    """Highest at ``best`` (the middle, if None), falling to both ends and ``ymin`` beyond them."""
    best = (xmin + xmax) / 2 if best is None else best
    rise, fall = F.try_divide(x - xmin, F.lit(best - xmin)), F.try_divide(xmax - x, F.lit(xmax - best))
    return F.when(x.isNull(), None).when((x <= xmin) | (x >= xmax), ymin).otherwise(ymin + (ymax - ymin) * F.when(x <= best, rise).otherwise(fall))


def sides(x: Column, xmin: float, xmax: float, ymin: float = 0, ymax: float = 1, worst: float | None = None, beyond: float | None = None) -> Column:
    """Lowest at ``worst`` (the middle, if None), rising to both ends; ``beyond`` (``ymax``, if None) outside."""
    worst = (xmin + xmax) / 2 if worst is None else worst
    left, right = F.try_divide(F.lit(worst) - x, F.lit(worst - xmin)), F.try_divide(x - worst, F.lit(xmax - worst))
    return F.when(x.isNull(), None).when((x < xmin) | (x > xmax), ymax if beyond is None else beyond).otherwise(ymin + (ymax - ymin) * F.when(x <= worst, left).otherwise(right))


def in_range(x: Column, xmin: float, xmax: float, least: float, most: float, ymin: float = 0, ymax: float = 1) -> Column:
    """Highest from xmin to xmax, falling to ``ymin`` at ``least`` and ``most``."""
    rise, fall = F.try_divide(x - least, F.lit(xmin - least)), F.try_divide(most - x, F.lit(most - xmax))
    return F.when(x.isNull(), None).when(x.between(xmin, xmax), ymax).when((x <= least) | (x >= most), ymin).otherwise(ymin + (ymax - ymin) * F.when(x < xmin, rise).otherwise(fall))


class Scaler:
    """Column scaling learned from one frame in one pass: 'std' (population deviation, 1 where it is 0) or 'minmax'."""

    def __init__(self, df: DataFrame, cols, kind: str = "std"):
        self.cols, self.kind = names(cols), kind
        low, wide = (F.avg, F.stddev_pop) if kind == "std" else (F.min, lambda c: F.max(c) - F.min(c))
        row = df.agg(*[low(c).alias(f"a{i}") for i, c in enumerate(self.cols)], *[wide(c).alias(f"b{i}") for i, c in enumerate(self.cols)]).first()
        self.shift = {c: row[f"a{i}"] for i, c in enumerate(self.cols)}
        self.scale = {c: row[f"b{i}"] or 1.0 for i, c in enumerate(self.cols)}

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - self.shift[c]) / self.scale[c] for c in self.cols})

    def inverse(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.col(c) * self.scale[c] + self.shift[c] for c in self.cols})


def miss_rate(df: DataFrame, cols=None) -> DataFrame:
    """(name, rate) for each column: its share of nulls and NaN, highest first."""
    kinds = dict(df.dtypes)
    cols = names(cols) or df.columns
    gone = {c: F.col(c).isNull() | F.isnan(c) if kinds[c] in ("double", "float") else F.col(c).isNull() for c in cols}
    wide = df.agg(*[F.avg(gone[c].cast("int")).alias(c) for c in cols])
    return wide.unpivot([], cols, "name", "rate").orderBy(F.desc("rate"), "name")


def drop_sparse_columns(df: DataFrame, cols=None, limit: float = 0.8) -> DataFrame:
    """Without the columns whose share of nulls is over ``limit``."""
    return df.drop(*[r.name for r in miss_rate(df, cols).collect() if r.rate is not None and r.rate > limit])


def drop_sparse_rows(df: DataFrame, limit: float = 0.5, cols=None) -> DataFrame:
    """Without the rows whose nulls in ``cols`` are more than ``limit`` of all columns of the frame."""
    gone = reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in names(cols) or df.columns])
    return df.where(gone <= limit * len(df.columns))


def fill_moving_average(df: DataFrame, order: Order, col: str, window: int | None = None, least: int = 2, out: str | None = None) -> DataFrame:
    """Nulls become the mean of the last ``window`` rows' values, if they are ``least`` or more.

    Without ``window`` it is twice the longest run of nulls, and 2 * least at least.
    """
    if window is None:
        seg = df.withColumn("__n", F.col(col).isNull().cast("int")).withColumn("__g", F.sum(1 - F.col("__n")).over(order.to_here()))
        longest = seg.groupBy(*order.key, "__g").agg(F.sum("__n").alias("n")).agg(F.max("n")).first()[0] or 0
        window = max(2 * longest, 2 * least)
    w = order.last(window)
    return df.withColumn(out or col, F.coalesce(F.col(col), F.when(F.count(col).over(w) >= least, F.avg(col).over(w))))


def fill_center(df: DataFrame, cols, how: str = "mean") -> DataFrame:
    """Nulls become the column's mean or exact median."""
    cols = names(cols)
    f = F.avg if how == "mean" else F.median
    row = df.agg(*[f(c).alias(f"v{i}") for i, c in enumerate(cols)]).first()
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(row[f"v{i}"])) for i, c in enumerate(cols)})


def softmax(df: DataFrame, key: list[str], col: str, out: str = "softmax") -> DataFrame:
    """Within each group, shifted by its maximum."""
    top = with_stats(df, key, {"__x": F.max(col)}).withColumn("__e", F.exp(F.col(col) - F.col("__x")))
    return with_stats(top, key, {"__t": F.sum("__e")}).withColumn(out, F.col("__e") / F.col("__t")).drop("__x", "__e", "__t")
