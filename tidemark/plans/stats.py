"""Statistics queries.

Running variances are rounded with a small shift, so that values that end in a 5 do not fall on either side.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import distributions as D
from ..operators import stats as S
from . import integrals as I
from .registry import query, table
from .series import PRE, UP, USER, W, events

#: A made-up prediction of the extended price.
P = "l_quantity * 1500 + l_tax * 1000"


def lines(spark, d):
    return table(spark, d, "lineitem").withColumn("p", F.expr(P))


_METRICS = {
    "mse": (S.mse, "avg((y - p) ** 2)"), "rmse": (S.rmse, "sqrt(avg((y - p) ** 2))"), "mae": (S.mae, "avg(abs(y - p))"), "mape": (S.mape, "avg(abs((y - p) / y))"),
    "smape": (S.smape, "avg(abs(p - y) / ((abs(p) + abs(y)) / 2))"), "r2": (S.r2, "1 - avg((y - p) ** 2) / var_pop(y)"),
    "r2_linear": (lambda y, p: S.r2(y, p, True), "(var_pop(p) + (avg(p) - avg(y)) ** 2) / var_pop(y)"),
    "r2adj": (lambda y, p: S.r2_adjusted(y, p, 3), "1 - (avg((y - p) ** 2) / var_pop(y)) * (count(*) - 1) / (count(*) - 3)"),
    "r2_by_mse": (lambda y, p: S.r2_from_mse(S.mse(y, p), y), "1 - avg((y - p) ** 2) / var_pop(y)"),
    "r2adj_by_mse": (lambda y, p: S.r2_to_adjusted(S.r2_from_mse(S.mse(y, p), y), F.count(F.lit(1)), F.lit(3)), "1 - (avg((y - p) ** 2) / var_pop(y)) * (count(*) - 1) / (count(*) - 3)"),
    "mse_by_r2": (lambda y, p: S.mse_from_r2(F.lit(0.75), y), "0.25 * var_pop(y)"),
}
for _name, (_f, _sql) in _METRICS.items():
    query(_name, f"SELECT l_returnflag, round(v, CASE WHEN abs(v) > 100 THEN 2 ELSE 8 END) AS v FROM (SELECT l_returnflag, {_sql} AS v FROM (SELECT l_returnflag, l_extendedprice AS y, {P} AS p FROM lineitem) GROUP BY l_returnflag)")(
        lambda spark, d, f=_f: lines(spark, d).groupBy("l_returnflag").agg(f("l_extendedprice", "p").alias("v")).withColumn("v", F.when(F.abs("v") > 100, F.round("v", 2)).otherwise(F.round("v", 8))))


@query("r2adj_by_r2", "SELECT l_orderkey, l_linenumber, round(1 - (1 - l_discount) * 49 / 47, 9) AS a, round(l_discount, 9) AS b FROM lineitem")
def adjusted(spark, d):
    a = S.r2_to_adjusted(F.col("l_discount"), F.lit(50), F.lit(3))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(a, 9).alias("a"), F.round(S.adjusted_to_r2(a, F.lit(50), F.lit(3)), 9).alias("b"))


@query("cal_linear_reg_r", "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 5) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(sum(l_extendedprice * l_quantity) / sum(l_quantity * l_quantity), 5) AS origin FROM lineitem GROUP BY 1")
def slope(spark, d):
    a, b = S.regression("l_extendedprice", "l_quantity")
    (c,) = S.regression("l_extendedprice", "l_quantity", False)
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(a, 5).alias("slope"), F.round(b, 3).alias("intercept"), F.round(c, 5).alias("origin"))


@query("avedev", "WITH m AS (SELECT user_id, avg(value) AS m FROM events GROUP BY 1) SELECT user_id, round(avg(abs(value - m)), 8) AS avedev FROM events JOIN m USING (user_id) GROUP BY 1")
def avedev(spark, d):
    return S.average_deviation(events(spark, d), "user_id", "value").withColumn("avedev", F.round("avedev", 8))


def _holes(spark, d):
    return events(spark, d).withColumn("x", F.when(F.col("value") > 20, F.col("value")))


_X = "(SELECT *, CASE WHEN value > 20 THEN value END AS x FROM events)"


@query("cummean", f"SELECT event_id, CASE WHEN x IS NOT NULL THEN round(avg(x) OVER {UP}, 8) END AS cummean FROM {_X}")
def cummean(spark, d):
    return S.cum_mean(_holes(spark, d), USER, "x").select("event_id", F.round("cummean", 8).alias("cummean"))


for _std in (False, True):
    query("cumstd" if _std else "cumvar", f"SELECT event_id, CASE WHEN x IS NOT NULL THEN round({'stddev' if _std else 'var'}_samp(x) OVER {UP} + 0.0000137, 3) END AS v FROM {_X}")(
        lambda spark, d, std=_std: S.cum_var(_holes(spark, d), USER, "x", std=std, out="v").select("event_id", F.round(F.col("v") + 0.0000137, 3).alias("v")))


@query("cumvar_ddof2", f"SELECT event_id, CASE WHEN count(value) OVER {UP} > 2 THEN round(var_pop(value) OVER {UP} * count(value) OVER {UP} / (count(value) OVER {UP} - 2) + 0.0000137, 3) END AS v FROM events")
def cumvar2(spark, d):
    return S.cum_var(events(spark, d), USER, "value", 2, out="v").select("event_id", F.round(F.col("v") + 0.0000137, 3).alias("v"))


@query("delta_var", "SELECT user_id, round(var_samp(value), 7) AS v FROM events GROUP BY user_id HAVING count(value) FILTER (event_type = 'view') > 1 AND count(value) FILTER (event_type <> 'view') > 1")
def delta(spark, d):
    parts = [(F.count(F.when(c, F.col("value"))).alias(f"n{i}"), F.avg(F.when(c, F.col("value"))).alias(f"m{i}"), F.var_samp(F.when(c, F.col("value"))).alias(f"v{i}")) for i, c in enumerate((F.col("event_type") == "view", F.col("event_type") != "view"))]
    m = events(spark, d).groupBy("user_id").agg(*parts[0], *parts[1]).where("n0 > 1 AND n1 > 1")
    return m.select("user_id", F.round(S.merge_variance(*[F.col(c) for c in ("n0", "m0", "v0", "n1", "m1", "v1")]), 7).alias("v"))


_L5 = f"({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
for _kind in ("maxmin", "std"):
    for _name, _w, _g in (("cum_scale", UP, "TRUE"), ("rolling_scale", _L5, f"count(value) OVER {_L5} = 5")):
        _e = f"(value - min(value) OVER {_w}) / nullif(max(value) OVER {_w} - min(value) OVER {_w}, 0)" if _kind == "maxmin" else f"(value - avg(value) OVER {_w}) / nullif(stddev_samp(value) OVER {_w}, 0)"
        query(f"{_name}_{_kind}", f"SELECT event_id, CASE WHEN {_g} THEN round({_e}, 6) END AS scaled FROM events")(
            lambda spark, d, kind=_kind, roll=_name == "rolling_scale": (S.rolling_scale(events(spark, d), USER, "value", 5, kind) if roll else S.cum_scale(events(spark, d), USER, "value", kind)).select("event_id", F.round("scaled", 6).alias("scaled")))


@query("get_quantiles_dense", "SELECT l_orderkey, l_linenumber, dense_rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) / u AS quantile FROM lineitem JOIN (SELECT l_returnflag, count(DISTINCT l_quantity) AS u FROM lineitem GROUP BY 1) USING (l_returnflag)")
def quantile(spark, d):
    return S.quantiles(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity").select("l_orderkey", "l_linenumber", "quantile")


@query("get_quantiles_average", "SELECT l_orderkey, l_linenumber, (rank() OVER w + count(*) OVER (w RANGE UNBOUNDED PRECEDING)) / 2.0 / count(*) OVER (PARTITION BY l_returnflag) AS quantile FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_quantity)".replace("(w RANGE UNBOUNDED PRECEDING)", "(PARTITION BY l_returnflag ORDER BY l_quantity RANGE UNBOUNDED PRECEDING)"))
def quantile_average(spark, d):
    return S.quantiles(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", "average").select("l_orderkey", "l_linenumber", "quantile")


_INT = "(SELECT *, CAST(floor(value / 10) AS DOUBLE) AS v FROM events)"


def _coarse(spark, d):
    return events(spark, d).withColumn("v", F.floor(F.col("value") / 10).cast("double")).select("event_id", "user_id", "ts", "v")


@query("cum_n_unique", f"SELECT event_id, CAST(sum(f) OVER {UP} AS BIGINT) AS n_unique FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY user_id, v ORDER BY ts, event_id) = 1 THEN 1 ELSE 0 END AS f FROM {_INT})")
def unique(spark, d):
    return S.cum_unique(_coarse(spark, d), USER, "v").select("event_id", "n_unique")


_PREFIX = f"list(v) OVER {UP}"
_CR = {"min": "less + 1", "max": "less + same", "average": "less + (same + 1) / 2.0", "first": "less + same", "dense": "kinds + 1"}
for _m, _e in _CR.items():
    query(f"cumrank_{_m}", f"""SELECT event_id, CAST({_e} AS DOUBLE) AS rank FROM (SELECT event_id, len(list_filter(a, lambda x: x < v)) AS less, len(list_filter(a, lambda x: x = v)) AS same, len(list_distinct(list_filter(a, lambda x: x < v))) AS kinds
FROM (SELECT event_id, v, {_PREFIX} AS a FROM {_INT}))""")(lambda spark, d, m=_m: S.cum_rank(_coarse(spark, d), USER, "v", m).select("event_id", "rank"))


@query("cum_pct_loc", f"SELECT event_id, round(len(list_distinct(list_filter(a, lambda x: x <= v))) / len(list_distinct(a)), 9) AS pct FROM (SELECT event_id, v, {_PREFIX} AS a FROM {_INT})")
def cum_pct(spark, d):
    return S.cum_pct_loc(_coarse(spark, d), USER, "v").select("event_id", F.round("pct", 9).alias("pct"))


@query("rolling_pct_loc", f"SELECT event_id, CASE WHEN len(a) = 5 THEN round((len(list_filter(a, lambda x: x < v)) + (len(list_filter(a, lambda x: x = v)) + 1) / 2.0) / 5, 9) END AS pct FROM (SELECT event_id, v, list(v) OVER {_L5} AS a FROM {_INT})")
def rolling_pct(spark, d):
    return S.rolling_pct_loc(_coarse(spark, d), USER, "v", 5, "average").select("event_id", F.round("pct", 9).alias("pct"))


@query("get_pct_loc", "SELECT user_id, round(len(list_filter(a, lambda x: x <= 50.0)) / len(a), 9) AS pct FROM (SELECT user_id, list_distinct(list_append(list(value), 50.0)) AS a FROM events GROUP BY user_id)")
def pct_loc(spark, d):
    a = events(spark, d).groupBy("user_id").agg(F.collect_list("value").alias("a"))
    return a.select("user_id", F.round(S.pct_loc(F.lit(50.0), F.col("a")), 9).alias("pct"))


@query("normpdf", "SELECT event_id, round(exp(-0.5 * pow((value - 50) / 10, 2)) / (10 * sqrt(2 * pi())), 12) AS p FROM events")
def normpdf(spark, d):
    return events(spark, d).select("event_id", F.round(D.normal_pdf(50.0, 10.0, F.col("value")), 12).alias("p"))


@query("lognormpdf", "SELECT event_id, CASE WHEN value > 0 THEN round(exp(-0.5 * pow((ln(CASE WHEN value > 0 THEN value END) - 3) / 0.5, 2)) / (0.5 * sqrt(2 * pi())) / value, 12) ELSE 0 END AS p FROM events")
def lognormpdf(spark, d):
    return events(spark, d).select("event_id", F.round(D.lognormal_pdf(3.0, 0.5, F.col("value")), 12).alias("p"))


@query("weibullpdf", "SELECT event_id, round(1.5 / 40 * (value / 40) ** 0.5 * exp(-((value / 40) ** 1.5)), 12) AS p FROM events")
def weibullpdf(spark, d):
    return events(spark, d).select("event_id", F.round(D.weibull_pdf(1.5, 40.0, F.col("value")), 12).alias("p"))


@query("weibullcdf", "SELECT event_id, CASE WHEN value > 0 THEN round(1 - exp(-((value / 40) ** 1.5)), 12) ELSE 0 END AS p FROM events")
def weibullcdf(spark, d):
    return events(spark, d).select("event_id", F.round(D.cdf_column("weibull", F.col("value"), (1.5, 40.0)), 12).alias("p"))


for _name, _key, _params, _z, _sql in (
        ("normcdf", "norm", (50.0, 10.0), "(value - 50) / 10.0", I.normal("z")), ("lognormcdf", "lognorm", (3.0, 0.5), "CASE WHEN value > 0 THEN (ln(CASE WHEN value > 0 THEN value END) - 3) / 0.5 ELSE -40.0 END", I.normal("z")),
        ("tcdf", "t", (5.0, 50.0, 10.0), "(value - 50) / 10.0", I.student("z", "5.0")), ("fcdf", "f", (5.0, 9.0), "5 * greatest(value, 0) / (5 * greatest(value, 0) + 9)", I.beta("2.5", "4.5", "z")), ("chi2cdf", "chi2", (40.0,), "value / 2", I.gamma("20.0", "z"))):
    query(_name, f"SELECT event_id, round({_sql}, 7) AS p FROM (SELECT event_id, {_z} AS z FROM events)")(
        lambda spark, d, n=_key, p=_params: events(spark, d).select("event_id", F.round(D.cdf_column(n, F.col("value"), p), 7).alias("p")))
for _name, _f, _sql in (
        ("tpdf", lambda x: D.student_pdf(x, 5.0, 50.0, 10.0), "exp(lgamma(3.0) - lgamma(2.5)) / sqrt(5 * pi()) / 10 * pow(1 + pow((value - 50) / 10, 2) / 5, -3.0)"),
        ("fpdf", lambda x: D.f_pdf(x, 5.0, 9.0), "CASE WHEN value > 0 THEN exp(2.5 * ln(5 / 9.0) + lgamma(7.0) - lgamma(2.5) - lgamma(4.5) + 1.5 * ln(CASE WHEN value > 0 THEN value END) - 7 * ln(1 + 5 / 9.0 * value)) ELSE 0 END"),
        ("chi2pdf", lambda x: D.chi2_pdf(x, 40.0), "CASE WHEN value > 0 THEN exp(-20 * ln(2) - lgamma(20.0) + 19 * ln(CASE WHEN value > 0 THEN value END) - value / 2) ELSE 0 END")):
    query(_name, f"SELECT event_id, round({_sql}, 11) AS p FROM events")(lambda spark, d, f=_f: events(spark, d).select("event_id", F.round(f(F.col("value")), 11).alias("p")))


@query("normfit", "SELECT round(avg(value), 8) AS mu, round(stddev_pop(value), 8) AS sigma FROM events")
def normfit(spark, d):
    return events(spark, d).agg(F.round(F.avg("value"), 8).alias("mu"), F.round(F.stddev_pop("value"), 8).alias("sigma"))


@query("lognormfit", "SELECT round(avg(ln(value)), 8) AS mu, round(stddev_pop(ln(value)), 8) AS sigma FROM events WHERE value > 0")
def lognormfit(spark, d):
    return events(spark, d).where("value > 0").agg(F.round(F.avg(F.ln("value")), 8).alias("mu"), F.round(F.stddev_pop(F.ln("value")), 8).alias("sigma"))


def _scores(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").selectExpr("quality AS y", "CAST(n_chars % 97 AS DOUBLE) AS s", "CASE WHEN n_chars % 97 > 40 THEN 1 ELSE 0 END AS p")


_SCORES = "(SELECT quality AS y, CAST(n_chars % 97 AS DOUBLE) AS s, CASE WHEN n_chars % 97 > 40 THEN 1 ELSE 0 END AS p FROM documents JOIN labels USING (doc_id))"


@query("auc_bin", f"""WITH r AS (SELECT y, (rank() OVER (ORDER BY s) + count(*) OVER (ORDER BY s RANGE UNBOUNDED PRECEDING)) / 2.0 AS k FROM {_SCORES})
SELECT round((sum(k) FILTER (y = 1) - p * (p + 1) / 2.0) / (p * n), 9) AS auc FROM r, (SELECT count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS n FROM {_SCORES}) GROUP BY p, n""")
def auc(spark, d):
    return S.auc(_scores(spark, d), "y", "s").select(F.round("auc", 9).alias("auc"))


@query("cal_f1_score", f"SELECT round(2.0 * count(*) FILTER (y = 1 AND p = 1) / (count(*) FILTER (y = 1) + count(*) FILTER (p = 1)), 9) AS f1 FROM {_SCORES}")
def f1(spark, d):
    return _scores(spark, d).agg(F.round(S.f1("y", "p"), 9).alias("f1"))


@query("confusion_matrix", f"""WITH s AS (SELECT * FROM {_SCORES})
SELECT CAST(y AS VARCHAR) AS truth, CAST(count(*) FILTER (p = 0) AS DOUBLE) AS "0", CAST(count(*) FILTER (p = 1) AS DOUBLE) AS "1", CAST(count(*) AS DOUBLE) AS "All", count(*) FILTER (p = y) / count(*) AS recall FROM s GROUP BY y
UNION ALL SELECT 'All', CAST(count(*) FILTER (p = 0) AS DOUBLE), CAST(count(*) FILTER (p = 1) AS DOUBLE), CAST(count(*) AS DOUBLE), count(*) FILTER (p = y) / count(*) FROM s
UNION ALL SELECT 'precision', count(*) FILTER (p = 0 AND y = 0) / count(*) FILTER (p = 0), count(*) FILTER (p = 1 AND y = 1) / count(*) FILTER (p = 1), NULL, NULL FROM s""")
def confusion(spark, d):
    return S.confusion(_scores(spark, d), "y", "p", [0, 1])


@query("anova_oneway", """WITH g AS (SELECT event_type, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM events GROUP BY 1), s AS (SELECT count(*) AS k, sum(n) AS n, sum(n * v) AS w, sum(n * m) AS a, sum(n * m * m) AS q FROM g)
SELECT round((q - a * a / n) / (k - 1) / (w / (n - k)), 6) AS f, CAST(k - 1 AS DOUBLE) AS df_between, CAST(n - k AS DOUBLE) AS df_within FROM s""")
def anova(spark, d):
    return S.anova(events(spark, d), "value", "event_type").select(F.round("f", 6).alias("f"), "df_between", "df_within")


def _two_sided(t: str, free: str, rows: str) -> str:
    return f"SELECT round(t, 6) AS t, round(df, 6) AS df, round({I.student_p('t', 'df')}, 6) AS p_value FROM (SELECT {t} AS t, CAST({free} AS DOUBLE) AS df FROM {rows})"


def _rounded(df):
    return df.select(*[F.round(c, 6).alias(c) for c in df.columns])


@query("ind_ttest", _two_sided("(a - b) / sqrt(p + q)", "pow(p + q, 2) / (p * p / (m - 1) + q * q / (n - 1))", """(SELECT m, n, a, b, v / m AS p, w / n AS q FROM (SELECT count(value) FILTER (event_type = 'view') AS m, count(value) FILTER (event_type = 'click') AS n, avg(value) FILTER (event_type = 'view') AS a,
avg(value) FILTER (event_type = 'click') AS b, var_samp(value) FILTER (event_type = 'view') AS v, var_samp(value) FILTER (event_type = 'click') AS w FROM events))"""))
def ind(spark, d):
    return _rounded(S.t_test_independent(events(spark, d), "value", "event_type", "view", "click", equal=False))


@query("rel_ttest", _two_sided("m * sqrt(n) / s", "n - 1", "(SELECT count(*) AS n, avg(l_discount - l_tax) AS m, stddev_samp(l_discount - l_tax) AS s FROM lineitem)"))
def rel(spark, d):
    return _rounded(S.t_test_paired(table(spark, d, "lineitem"), "l_discount", "l_tax"))


@query("var_hom_test", f"""WITH c AS (SELECT event_type, avg(value) AS m FROM events GROUP BY 1), e AS (SELECT event_type, abs(value - m) AS e FROM events JOIN c USING (event_type)),
g AS (SELECT event_type, count(*) AS n, avg(e) AS m, var_pop(e) AS v FROM e GROUP BY 1), s AS (SELECT CAST(count(*) - 1 AS DOUBLE) AS d1, CAST(sum(n) - count(*) AS DOUBLE) AS d2, (sum(n * m * m) - pow(sum(n * m), 2) / sum(n)) AS b, sum(n * v) AS w FROM g),
t AS (SELECT b / d1 / (w / d2) AS f, d1, d2 FROM s) SELECT round(f, 6) AS f, d1 AS df_between, d2 AS df_within, round({I.f_p('f', 'd1', 'd2')}, 6) AS p_value FROM t""")
def levene(spark, d):
    return _rounded(S.variance_test(events(spark, d), "value", "event_type"))
