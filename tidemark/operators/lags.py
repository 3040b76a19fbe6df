"""Lag matrices, directional accuracy, static and recursive forecasting."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .order import Order, flag


def lag_matrix(df: DataFrame, order: Order, y: str, lags: dict[str, int], other: list[str] | None = None, gap: int = 0, steps: int = 1) -> DataFrame:
    """Rows of (key, order, x.., y..): for each column its ``lags`` values that end ``gap`` + 1 rows before the target.

    Oldest lags first; ``other`` are the target row's own values; ``steps`` targets follow each other.  Rows without a
    full history or all targets are left out.
    """
    w = order.window()
    xs = {f"{c}_lag{k + gap}": F.lag(c, k + gap).over(w) for c, n in lags.items() for k in range(n, 0, -1)}
    ys = {f"y{k}": F.lead(y, k).over(w) if k else F.col(y) for k in range(steps)}
    most = max(lags.values(), default=0) + gap
    rows = df.withColumns({**xs, **{f"__{c}": F.col(c) for c in other or []}, **ys, "__rn": order.row(), "__n": F.count(F.lit(1)).over(order.whole())})
    rows = rows.where((F.col("__rn") > most) & (F.col("__rn") + steps - 1 <= F.col("__n")))
    return rows.select(*order.key, *order.by, *xs, *[F.col(f"__{c}").alias(f"x_{c}") for c in other or []], *ys)


def directional_accuracy(df: DataFrame, order: Order, y: str, p: str) -> DataFrame:
    """(key, accuracy): share of rows whose change from the last truth is predicted with the right sign; the first is a hit."""
    last = F.lag(y).over(order.window())
    hit = flag(F.coalesce(F.signum(F.col(y) - last), F.lit(0.0)) == F.coalesce(F.signum(F.col(p) - last), F.lit(0.0)))
    return df.withColumn("__h", hit).groupBy(*order.key).agg(F.avg("__h").alias("accuracy"))


def linear_predictor(columns: dict[str, float], intercept: float = 0.0) -> Column:
    """A fitted linear model as a Column over a lag matrix, which keeps scoring in the JVM."""
    out = F.lit(float(intercept))
    for c, w in columns.items():
        out = out + F.col(c) * float(w)
    return out


def split_predict(matrices: dict[str, DataFrame], predict: Column, out: str = "pred") -> DataFrame:
    """Predictions of several splits (train, valid, test) in one frame with the split's name."""
    frames = [m.withColumn(out, predict).withColumn("split", F.lit(name)) for name, m in matrices.items()]
    done = frames[0]
    for f in frames[1:]:
        done = done.unionByName(f)
    return done


def recursive_forecast(df: DataFrame, order: Order, y: str, lags: int, horizon: int, predict: Callable[[np.ndarray], np.ndarray | float], steps: int = 1, out: str = "forecast") -> DataFrame:
    """(key, step, forecast): each key's next ``horizon`` values, every prediction feeding the next ones' lags.

    ``predict`` takes the last ``lags`` values and gives the next one, or the next ``steps``.  Keys with a shorter
    history have null forecasts.
    """

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        past = frame.sort_values(list(order.by), kind="stable")[y].tolist()
        made: list = []
        while len(made) < horizon:
            window = (past + made)[-lags:]
            if len(window) < lags:
                made = [None] * horizon
                break
            made += [float(v) for v in np.atleast_1d(predict(np.array(window)))[:steps]]
        res = pd.DataFrame({"step": range(1, horizon + 1), out: made[:horizon]})
        for c in order.key:
            res[c] = frame[c].iloc[0]
        return res[[*order.key, "step", out]]

    kinds = [df.schema[c] for c in order.key]
    return df.groupBy(*order.key).applyInPandas(fold, T.StructType([*kinds, T.StructField("step", T.IntegerType()), T.StructField(out, T.DoubleType())]))
