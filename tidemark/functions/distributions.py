"""Densities, distribution functions and fits of six distributions.

Densities and closed forms are Columns; distribution functions that need the error, gamma or beta integrals are Arrow
pandas functions over whole batches.  Fits use moments or sums that Spark aggregates; the few Newton or search steps run
on those sums, never on rows (Student, F and chi-square fits by moments).
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_erf = np.frompyfunc(math.erf, 1, 1)
_lgamma = np.frompyfunc(math.lgamma, 1, 1)


def _beta_fraction(a, b, x):
    """Lentz's continued fraction of the incomplete beta integral, for all elements at once."""
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    return h


def beta_integral(a, b, x):
    """Regularised incomplete beta integral."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    inside = (x > 0) & (x < 1)
    s = np.where(inside, x, 0.5)
    with np.errstate(all="ignore"):
        front = np.exp((_lgamma(a + b) - _lgamma(a) - _lgamma(b)).astype(float) + a * np.log(s) + b * np.log1p(-s))
        swap = s > (a + 1) / (a + b + 2)
        h = front * _beta_fraction(np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - s, s)) / np.where(swap, b, a)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, np.where(swap, 1 - h, h)))


def gamma_integral(a, x):
    """Regularised lower incomplete gamma integral: a series below a + 1, a continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    s = np.where(x > 0, x, 1.0)
    with np.errstate(all="ignore"):
        front = np.exp(a * np.log(s) - s - _lgamma(a).astype(float))
        term, total, n = 1 / a, 1 / a, a.copy()
        for _ in range(2000):
            n = n + 1
            term = term * s / n
            total = total + term
            if np.all((term < total * 1e-16) | (s >= a + 1)):
                break
        low = front * total
        b, c = s + 1 - a, np.full_like(s, 1e300)
        d = 1 / b
        h = d.copy()
        for k in range(1, 500):
            num = -k * (k - a)
            b = b + 2
            d, c = 1 / (num * d + b), b + num / c
            h = h * d * c
            if np.all((np.abs(d * c - 1) < 1e-15) | (s < a + 1)):
                break
        high = 1 - front * h
    return np.where(x <= 0, 0.0, np.where(s < a + 1, low, high))


def normal_cdf(x, mu, sigma):
    return 0.5 * (1 + _erf((np.asarray(x, float) - mu) / (np.asarray(sigma, float) * math.sqrt(2))).astype(float))


def student_cdf(x, df, loc=0.0, scale=1.0):
    z = (np.asarray(x, float) - loc) / scale
    tail = 0.5 * beta_integral(np.asarray(df, float) / 2, 0.5, df / (df + z * z))
    return np.where(z > 0, 1 - tail, tail)


def f_cdf(x, d1, d2, loc=0.0, scale=1.0):
    z = np.maximum((np.asarray(x, float) - loc) / scale, 0)
    return beta_integral(np.asarray(d1, float) / 2, np.asarray(d2, float) / 2, d1 * z / (d1 * z + d2))


def chi2_cdf(x, df, loc=0.0, scale=1.0):
    return gamma_integral(np.asarray(df, float) / 2, (np.asarray(x, float) - loc) / scale / 2)


CDFS: dict[str, Callable] = {"norm": normal_cdf, "t": student_cdf, "f": f_cdf, "chi2": chi2_cdf}


def cdf_column(name: str, x: Column, params: tuple) -> Column:
    """Distribution function of a Column; parameters are numbers or Columns. Null in, null out."""
    x = x.cast("double")
    p = [v if isinstance(v, Column) else F.lit(float(v)) for v in params]
    if name == "lognorm":
        return F.when(x > 0, cdf_column("norm", F.ln(F.when(x > 0, x)), params)).otherwise(F.when(x.isNotNull(), 0.0))
    if name == "weibull":
        return F.when(x > 0, 1 - F.exp(-F.pow(x / p[1], p[0]))).otherwise(F.when(x.isNotNull(), 0.0))
    exact = CDFS[name]

    @F.pandas_udf("double")
    def run(x: pd.Series, *rest: pd.Series) -> pd.Series:
        missing = x.isna()
        for r in rest:
            missing |= r.isna()
        fine = [v.where(~missing, 1.0).to_numpy(float) for v in (x, *rest)]
        return pd.Series(np.asarray(exact(*fine), float)).where(~missing.reset_index(drop=True))

    return run(x, *p)


def normal_pdf(mu, sigma, x: Column) -> Column:
    z = (x - mu) / sigma
    return F.exp(-z * z / 2) / (sigma * math.sqrt(2 * math.pi))


def lognormal_pdf(mu, sigma, x: Column) -> Column:
    return F.when(x > 0, normal_pdf(mu, sigma, F.ln(F.when(x > 0, x))) / x).otherwise(F.when(x.isNotNull(), 0.0))


def weibull_pdf(k, scale, x: Column) -> Column:
    return F.when(x >= 0, k / scale * F.pow(x / scale, F.lit(k - 1.0)) * F.exp(-F.pow(x / scale, F.lit(float(k))))).otherwise(F.when(x.isNotNull(), 0.0))


def student_pdf(x: Column, df: float, loc: float = 0.0, scale: float = 1.0) -> Column:
    z = (x - loc) / scale
    front = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi) / scale
    return front * F.pow(1 + z * z / df, F.lit(-(df + 1) / 2))


def chi2_pdf(x: Column, df: float, loc: float = 0.0, scale: float = 1.0) -> Column:
    z = (x - loc) / scale
    front = -(df / 2) * math.log(2) - math.lgamma(df / 2) - math.log(scale)
    return F.when(z > 0, F.exp(front + (df / 2 - 1) * F.ln(F.when(z > 0, z)) - z / 2)).otherwise(F.when(z.isNotNull(), 0.0))


def f_pdf(x: Column, d1: float, d2: float, loc: float = 0.0, scale: float = 1.0) -> Column:
    z = (x - loc) / scale
    front = d1 / 2 * math.log(d1 / d2) + math.lgamma((d1 + d2) / 2) - math.lgamma(d1 / 2) - math.lgamma(d2 / 2) - math.log(scale)
    ln = F.ln(F.when(z > 0, z))
    return F.when(z > 0, F.exp(front + (d1 / 2 - 1) * ln - (d1 + d2) / 2 * F.log1p(d1 / d2 * z))).otherwise(F.when(z.isNotNull(), 0.0))


def fit_normal(df: DataFrame, col: str) -> tuple[float, float]:
    return tuple(df.agg(F.avg(col), F.stddev_pop(col)).first())


def fit_lognormal(df: DataFrame, col: str) -> tuple[float, float]:
    """Mean and deviation of the logarithms of the positive values."""
    return fit_normal(df.where(F.col(col) > 0).select(F.ln(col).alias("x")), "x")


def fit_weibull(df: DataFrame, col: str, rounds: int = 40) -> tuple[float, float]:
    """Maximum likelihood (shape, scale) of the positive values: a bracket of the shape, narrowed by ten shapes a pass over the
    rows; within the last one the score is a straight line."""
    x = df.where(F.col(col) > 0).select(F.col(col).cast("double").alias("x"))
    mean, top = x.agg(F.avg(F.ln("x")), F.max("x")).first()
    if mean is None:
        return None, None
    low, high = 0.05, 50.0
    for _ in range(rounds // 4):
        tries = np.geomspace(low, high, 12)
        sums = x.agg(*[F.sum(F.pow(F.col("x") / top, F.lit(float(k)))).alias(f"s{i}") for i, k in enumerate(tries)], *[F.sum(F.pow(F.col("x") / top, F.lit(float(k))) * F.ln("x")).alias(f"l{i}") for i, k in enumerate(tries)]).first()
        score = [sums[f"l{i}"] / sums[f"s{i}"] - 1 / k - mean for i, k in enumerate(tries)]
        k = next((i for i, s in enumerate(score) if s > 0), len(tries) - 1)
        low, high = tries[max(0, k - 1)], tries[k]
        below, above = score[max(0, k - 1)], score[k]
        if high - low < 1e-8 * high:
            break
    shape = float(low - below * (high - low) / (above - below)) if below <= 0 < above else math.sqrt(low * high)
    return shape, top * x.agg(F.avg(F.pow(F.col("x") / top, F.lit(shape)))).first()[0] ** (1 / shape)


def fit_student(df: DataFrame, col: str) -> tuple[float, float, float]:
    """(degrees of freedom, location, scale) by moments: the kurtosis gives the degrees of freedom."""
    m, v, k = df.agg(F.avg(col), F.var_pop(col), F.kurtosis(col)).first()
    free = 4 + 6 / k if k and k > 1e-3 else 1e3
    return free, m, math.sqrt(v * (free - 2) / free)


def fit_chi2(df: DataFrame, col: str) -> tuple[float, float, float]:
    """(degrees of freedom, location, scale) by moments: the skewness gives the degrees of freedom."""
    m, s, g = df.agg(F.avg(col), F.stddev_pop(col), F.skewness(col)).first()
    free = 8 / g**2 if g and g > 1e-3 else 1e4
    scale = s / math.sqrt(2 * free)
    return free, m - free * scale, scale


def fit_f(df: DataFrame, col: str) -> tuple[float, float]:
    """(d1, d2) by moments of a positive variable with mean above 1; else large degrees of freedom."""
    m, v = df.agg(F.avg(col), F.var_pop(col)).first()
    d2 = 2 * m / (m - 1) if m > 1 + 1e-6 else 1e4
    d2 = max(d2, 4.01)
    under = v * (d2 - 2) ** 2 * (d2 - 4) - 2 * d2**2
    return max(1.0, 2 * d2**2 * (d2 - 2) / under) if under > 0 else 1e4, d2
