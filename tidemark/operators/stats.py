"""Statistics: metrics of predictions, running and rolling moments, ranks and quantiles, distributions and tests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import cdf_column
from .order import Order
from .ranges import running, same
from .ranks import RANKS, cum_rank  # noqa: F401

# ---- metrics: aggregate Columns of a truth and a prediction column


def mse(y: str, p: str) -> Column:
    return F.avg(F.pow(F.col(y) - F.col(p), 2))


def rmse(y: str, p: str) -> Column:
    return F.sqrt(mse(y, p))


def mae(y: str, p: str) -> Column:
    return F.avg(F.abs(F.col(y) - F.col(p)))


def mape(y: str, p: str) -> Column:
    """Mean absolute relative error; rows with a truth of 0 are left out."""
    return F.avg(F.abs(F.try_divide(F.col(y) - F.col(p), F.col(y))))


def smape(y: str, p: str) -> Column:
    """Rows where both are 0 are left out."""
    return F.avg(F.try_divide(F.abs(F.col(p) - F.col(y)), (F.abs(F.col(p)) + F.abs(F.col(y))) / 2))


def r2(y: str, p: str, linear: bool = False) -> Column:
    """1 - residual over total sum of squares; linear: explained over total. One pass, from central moments."""
    both = F.col(y).isNotNull() & F.col(p).isNotNull()
    total = F.var_pop(F.when(both, F.col(y)))
    if linear:
        mean_gap = F.avg(F.when(both, F.col(p))) - F.avg(F.when(both, F.col(y)))
        return F.try_divide(F.var_pop(F.when(both, F.col(p))) + mean_gap * mean_gap, total)
    return 1 - F.try_divide(mse(y, p), total)


def r2_adjusted(y: str, p: str, k: int) -> Column:
    """k counts the intercept."""
    n = F.count(F.when(F.col(y).isNotNull() & F.col(p).isNotNull(), 1))
    return r2_to_adjusted(r2(y, p), n, F.lit(k))


def r2_to_adjusted(r: Column, n: Column, k: Column) -> Column:
    return 1 - F.try_divide((1 - r) * (n - 1), n - k)


def adjusted_to_r2(adjusted: Column, n: Column, k: Column) -> Column:
    return 1 - F.try_divide((1 - adjusted) * (n - k), n - 1)


def r2_from_mse(error: Column, y: str) -> Column:
    return 1 - F.try_divide(error, F.var_pop(y))


def mse_from_r2(r: Column, y: str) -> Column:
    return (1 - r) * F.var_pop(y)


def regression(y: str, x: str, intercept: bool = True) -> tuple[Column, ...]:
    """(slope, intercept) of least squares on one variable, or (slope,) through the origin."""
    if intercept:
        return F.regr_slope(y, x), F.regr_intercept(y, x)
    return (F.try_divide(F.sum(F.col(x) * F.col(y)), F.sum(F.col(x) * F.col(x))),)


def f1(y: str, p: str, positive=1) -> Column:
    hit = F.count_if((F.col(y) == positive) & (F.col(p) == positive))
    return F.try_divide(2.0 * hit, F.count_if(F.col(y) == positive) + F.count_if(F.col(p) == positive))


def average_deviation(df: DataFrame, key, col: str, out: str = "avedev") -> DataFrame:
    """Mean distance to the group's mean, by two aggregations."""
    keys = [key] if isinstance(key, str) else list(key)
    means = df.groupBy(*keys).agg(F.avg(col).alias("__m"))
    return df.join(means, keys).groupBy(*keys).agg(F.avg(F.abs(F.col(col) - F.col("__m"))).alias(out))


def auc(df: DataFrame, y: str, score: str) -> DataFrame:
    """Area under the ROC curve from rank sums, with ties; distinct scores are counted first.

    Ranks need a total order, so the counts of distinct scores are cut in ranges by score, summed within each, and the
    ranges' sums (one row a range) are added up.
    """
    counts = df.where(F.col(y).isNotNull() & F.col(score).isNotNull()).groupBy(score).agg(F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).alias("pos"), F.count(F.lit(1)).alias("n"))
    part = counts.repartitionByRange(F.col(score)).withColumn("__p", F.spark_partition_id())
    w = Window.partitionBy("__p").orderBy(score).rowsBetween(Window.unboundedPreceding, 0)
    inner = part.withColumn("__upto", F.sum("n").over(w))
    per = inner.groupBy("__p").agg(F.sum(F.col("pos") * (F.col("__upto") - (F.col("n") - 1) / 2.0)).alias("s"), F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    summed = per.withColumn("b", before).agg(F.sum(F.col("s") + F.col("pos") * F.col("b")).alias("s"), F.sum("n").alias("n"), F.sum("pos").cast("double").alias("p"))
    return summed.select(F.try_divide(F.col("s") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * (F.col("n") - F.col("p"))).alias("auc"))


def confusion(df: DataFrame, y: str, p: str, labels: list) -> DataFrame:
    """Counts of truth by prediction with margins, and each truth's recall; a last row has the predictions' precision."""
    base = df.groupBy(F.col(y).cast("string").alias("truth")).agg(*[F.count_if(F.col(p) == k).cast("double").alias(str(k)) for k in labels], F.count(F.lit(1)).cast("double").alias("All"))
    recall = reduce(lambda a, k: F.when(F.col("truth") == str(k), F.try_divide(F.col(str(k)), F.col("All"))).otherwise(a), labels, F.lit(None).cast("double"))
    rows = base.withColumn("recall", recall)
    every = df.agg(*[F.count_if(F.col(p) == k).cast("double").alias(str(k)) for k in labels], F.count(F.lit(1)).cast("double").alias("All"), (F.count_if(F.col(y) == F.col(p)) / F.count(F.lit(1))).alias("recall"))
    precision = df.agg(*[F.try_divide(F.count_if((F.col(p) == k) & (F.col(y) == k)), F.count_if(F.col(p) == k)).alias(str(k)) for k in labels])
    last = precision.select(F.lit("precision").alias("truth"), *[str(k) for k in labels], F.lit(None).cast("double").alias("All"), F.lit(None).cast("double").alias("recall"))
    return rows.unionByName(every.withColumn("truth", F.lit("All"))).unionByName(last)


# ---- moments


def merge_variance(n0: Column, mean0: Column, var0: Column, n1: Column, mean1: Column, var1: Column, ddof: int = 1) -> Column:
    """Variance of two samples together from their sizes, means and variances; null with no more than ``ddof`` values."""
    n = n0 + n1
    squares = var0 * (n0 - ddof) + var1 * (n1 - ddof) + F.try_divide(n0 * n1, n) * F.pow(mean1 - mean0, 2)
    return F.when(n > ddof, F.try_divide(squares, n - ddof))


def cum_mean(df: DataFrame, order: Order, col: str, out: str = "cummean") -> DataFrame:
    return df.withColumn(out, F.when(F.col(col).isNotNull(), F.avg(col).over(order.to_here())))


def cum_var(df: DataFrame, order: Order, col: str, ddof: int = 1, std: bool = False, out: str = "cumvar") -> DataFrame:
    """Running variance (standard deviation) of the values so far; null on null rows and with no more than ``ddof`` values."""
    w = order.to_here()
    n = F.count(col).over(w)
    var = F.when(n > ddof, F.try_divide(F.var_pop(col).over(w) * n, n - ddof))
    return df.withColumn(out, F.when(F.col(col).isNotNull(), F.sqrt(var) if std else var))


def _scaled(x: Column, col: str, w, kind: str, low: float, high: float) -> Column:
    if kind == "std":
        return F.try_divide(x - F.avg(col).over(w), F.stddev_samp(col).over(w))
    least, most = F.min(col).over(w), F.max(col).over(w)
    return low + F.try_divide((x - least) * (high - low), most - least)


def cum_scale(df: DataFrame, order: Order, col: str, kind: str = "maxmin", low: float = 0.0, high: float = 1.0, out: str = "scaled") -> DataFrame:
    """Scaling by the values so far: to [low, high] or to standard scores; null while they are all alike."""
    return df.withColumn(out, _scaled(F.col(col), col, order.to_here(), kind, low, high))


def rolling_scale(df: DataFrame, order: Order, col: str, lag: int, kind: str = "maxmin", low: float = 0.0, high: float = 1.0, out: str = "scaled") -> DataFrame:
    """As cum_scale over the last ``lag`` rows; null until there are as many values."""
    w = order.last(lag)
    return df.withColumn(out, F.when(F.count(col).over(w) == lag, _scaled(F.col(col), col, w, kind, low, high)))


# ---- ranks


def quantiles(df: DataFrame, key: list[str], col: str, method: str = "dense", out: str = "quantile") -> DataFrame:
    """Each value's place in its group: dense rank over the highest dense rank, or mean rank over the number of rows.

    Values are counted first and run through in ranges, so no task holds a group.
    """
    values = df.groupBy(*key, col).agg(F.count(F.lit(1)).alias("__n"))
    run = running(values.where(F.col(col).isNotNull()), list(key), [col], __upto=F.lit(1) if method == "dense" else F.col("__n"))
    counted = F.count(col) if method == "dense" else F.sum("__n")
    whole = values.groupBy(*[F.col(k).alias(f"__w_{k}") for k in key]).agg(counted.alias("__whole"))
    q = F.col("__upto") / F.col("__whole") if method == "dense" else (F.col("__upto") - (F.col("__n") - 1) / 2.0) / F.col("__whole")
    ranked = run.join(whole, same(list(key), [f"__w_{k}" for k in key])).select(*[F.col(c).alias(f"__k_{c}") for c in [*key, col]], q.alias(out))
    return df.join(ranked, same([*key, col], [f"__k_{c}" for c in [*key, col]]), "left").select(*df.columns, out)


def cum_unique(df: DataFrame, order: Order, col: str, skipna: bool = True, out: str = "n_unique") -> DataFrame:
    """Number of different values so far; skipna: null rows have none, else null is a value."""
    first = (F.row_number().over(order.window(col)) == 1).cast("int")
    first = F.when(F.col(col).isNull(), 0).otherwise(first) if skipna else first
    seen = df.withColumn("__f", first).withColumn(out, F.sum("__f").over(order.to_here()).cast("long"))
    return (seen.withColumn(out, F.when(F.col(col).isNotNull(), F.col(out))) if skipna else seen).drop("__f")


def cum_pct_loc(df: DataFrame, order: Order, col: str, method: str = "dense", out: str = "pct") -> DataFrame:
    """Running rank over the number of different values (dense) or of rows (average) so far."""
    ranked = cum_rank(df, order, col, method, out="__r")
    if method == "dense":
        return cum_unique(ranked, order, col, out="__u").withColumn(out, F.try_divide("__r", "__u")).drop("__r", "__u")
    return ranked.withColumn(out, F.col("__r") / order.row()).drop("__r")


def pct_loc(value: Column, sample: Column, method: str = "dense", new: bool = True) -> Column:
    """Place of a value in an array of values; new: the value joins the sample first."""
    a = F.array_compact(F.when(F.lit(new), F.array_append(sample, value)).otherwise(sample))
    if method == "dense":
        kinds = F.array_distinct(a)
        return F.try_divide(F.size(F.filter(kinds, lambda e: e <= value)).cast("double"), F.size(kinds))
    less, same = F.size(F.filter(a, lambda e: e < value)), F.size(F.filter(a, lambda e: e == value))
    return F.try_divide(less + (same + 1) / 2.0, F.size(a))


def rolling_pct_loc(df: DataFrame, order: Order, col: str, lag: int, method: str = "dense", out: str = "pct") -> DataFrame:
    """Place of the row's value among the last ``lag`` values; null until there are as many."""
    frame = F.collect_list(col).over(order.last(lag))
    return df.withColumn("__a", frame).withColumn(out, F.when((F.size("__a") == lag) & F.col(col).isNotNull(), pct_loc(F.col(col), F.col("__a"), method, new=False))).drop("__a")


# ---- tests


def ks_test(df: DataFrame, col: str, name: str, params: tuple[float, ...]) -> DataFrame:
    """(n, statistic, p_value) of Kolmogorov and Smirnov's test of a column against a distribution.

    Values are ranked in ranges by value; only the ranges' sizes are added up on one task.
    """
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    part = counts.repartitionByRange(F.col("x")).withColumn("__p", F.spark_partition_id())
    sizes = part.groupBy("__p").agg(F.sum("n").alias("size"))
    w = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("__p", F.coalesce(F.sum("size").over(w), F.lit(0)).alias("before"), F.sum("size").over(Window.partitionBy()).alias("total"))
    own = F.sum("n").over(Window.partitionBy("__p").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    ranked = part.withColumn("upto", own).join(sizes, "__p").withColumn("upto", F.col("upto") + F.col("before"))
    cdf = cdf_column(name, F.col("x"), params)
    gap = F.greatest(F.abs(F.col("upto") / F.col("total") - F.col("c")), F.abs(F.col("c") - (F.col("upto") - F.col("n")) / F.col("total")))
    stat = ranked.withColumn("c", cdf).agg(F.max("total").alias("n"), F.max(gap).alias("statistic"))
    lam = F.col("statistic") * F.sqrt("n")
    # Kolmogorov's series, of which 100 terms are enough for any lambda above 0.05
    terms = reduce(lambda a, k: a + (-1.0) ** (k - 1) * F.exp(-2.0 * k * k * lam * lam), range(1, 101), F.lit(0.0))
    return stat.withColumn("p_value", F.when(lam < 0.05, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * terms))))


def t_test_independent(df: DataFrame, col: str, group: str, a, b, equal: bool = True) -> DataFrame:
    """(t, df, p_value) of two groups' means: with the pooled variance, or Welch's."""
    m = df.agg(*[f(F.when(F.col(group) == g, F.col(col))).alias(f"{n}{s}") for g, s in ((a, "0"), (b, "1")) for f, n in ((F.count, "n"), (F.avg, "m"), (F.var_samp, "v"))])
    if equal:
        free = F.col("n0") + F.col("n1") - 2
        pooled = (F.col("v0") * (F.col("n0") - 1) + F.col("v1") * (F.col("n1") - 1)) / free
        scale = F.sqrt(pooled * (1 / F.col("n0") + 1 / F.col("n1")))
    else:
        s0, s1 = F.col("v0") / F.col("n0"), F.col("v1") / F.col("n1")
        free = F.pow(s0 + s1, 2) / (F.pow(s0, 2) / (F.col("n0") - 1) + F.pow(s1, 2) / (F.col("n1") - 1))
        scale = F.sqrt(s0 + s1)
    out = m.select(F.try_divide(F.col("m0") - F.col("m1"), scale).alias("t"), free.cast("double").alias("df"))
    return out.withColumn("p_value", 2 * (1 - cdf_column("t", F.abs("t"), (F.col("df"),))))


def t_test_paired(df: DataFrame, a: str, b: str) -> DataFrame:
    d = F.col(a) - F.col(b)
    m = df.agg(F.count(d).alias("n"), F.avg(d).alias("m"), F.stddev_samp(d).alias("s"))
    out = m.select(F.try_divide(F.col("m") * F.sqrt("n"), F.col("s")).alias("t"), (F.col("n") - 1).cast("double").alias("df"))
    return out.withColumn("p_value", 2 * (1 - cdf_column("t", F.abs("t"), (F.col("df"),))))


def anova(df: DataFrame, col: str, group: str) -> DataFrame:
    """(f, df_between, df_within, p_value) of one-way analysis of variance, from one row a group."""
    g = df.where(F.col(col).isNotNull() & F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(col).alias("m"), F.var_pop(col).alias("v"))
    s = g.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("v")).alias("within"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"))
    between = F.col("q") - F.col("s") * F.col("s") / F.col("n")
    d1, d2 = (F.col("k") - 1).cast("double"), (F.col("n") - F.col("k")).cast("double")
    out = s.select(F.try_divide(F.try_divide(between, d1), F.try_divide(F.col("within"), d2)).alias("f"), d1.alias("df_between"), d2.alias("df_within"))
    return out.withColumn("p_value", 1 - cdf_column("f", F.col("f"), (F.col("df_between"), F.col("df_within"))))


def variance_test(df: DataFrame, col: str, group: str) -> DataFrame:
    """Levene's test of equal variances: one-way analysis of variance of the distances to the groups' means."""
    means = df.groupBy(group).agg(F.avg(col).alias("__m"))
    return anova(df.join(means, group).withColumn("__d", F.abs(F.col(col) - F.col("__m"))), "__d", group)


def pooled_variance(n0, m0, v0, n1, m1, v1):
    """Population variance of two samples together, from their sizes, means and population variances."""
    n = n0 + n1
    m = F.try_divide(n0 * m0 + n1 * m1, n)
    return F.try_divide(n0 * (v0 + (m - m0) * (m - m0)) + n1 * (v1 + (m - m1) * (m - m1)), n)


def roc_points(df: DataFrame, y: str, score: str) -> DataFrame:
    """(threshold, tpr, fpr) at every distinct score; the scores are counted first, and only the counts are run through, in ranges."""
    each = df.groupBy(F.col(score).alias("threshold")).agg(F.sum(y).alias("__p"), F.sum(1 - F.col(y)).alias("__n"))
    total = each.agg(F.sum("__p").alias("__tp"), F.sum("__n").alias("__tn"))
    run = running(each, [], [F.col("threshold").desc()], __cp=F.col("__p"), __cn=F.col("__n"))
    return run.join(F.broadcast(total)).select("threshold", F.try_divide(F.col("__cp"), F.col("__tp")).alias("tpr"), F.try_divide(F.col("__cn"), F.col("__tn")).alias("fpr"))


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """(bin, n) over ``bins`` equal ranges from the least to the largest value."""
    edge = df.agg(F.min(col).alias("__a"), F.max(col).alias("__b"))
    at = F.least(F.floor(F.try_divide(F.col(col) - F.col("__a"), F.col("__b") - F.col("__a")) * bins), F.lit(bins - 1))
    return df.join(F.broadcast(edge)).groupBy(at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
