"""Fitted distributions, error curves, combined judgements, and pages."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import distributions as D
from ..functions import scalars as C
from ..operators import scoring as S
from ..operators import stats as ST
from . import integrals as I
from .registry import query, table
from .series import events

_POS = "(SELECT event_id, value AS x FROM events WHERE value > 0)"


def _positive(spark, d):
    return events(spark, d).where("value > 0").select("event_id", F.col("value").alias("x"))


def _row(spark, names, values):
    return spark.createDataFrame([tuple(None if v is None else round(float(v), 5) for v in values)], ", ".join(f"{n} double" for n in names))


#: Moments: mean, variance, excess kurtosis and skewness of the population.
_M = f"m AS (SELECT avg(x) AS m, var_pop(x) AS v FROM {_POS}), k AS (SELECT avg(pow(x - m, 4)) / pow(max(v), 2) - 3 AS k, avg(pow(x - m, 3)) / pow(max(v), 1.5) AS g FROM {_POS}, m)"
_T = f"WITH {_M}, p AS (SELECT CASE WHEN k > 1e-3 THEN 4 + 6 / k ELSE 1000 END AS df, m AS loc, v FROM m, k), q AS (SELECT df, loc, sqrt(v * (df - 2) / df) AS scale FROM p)"
_C = f"WITH {_M}, p AS (SELECT CASE WHEN g > 1e-3 THEN 8 / (g * g) ELSE 10000 END AS df, m, v FROM m, k), q AS (SELECT df, m - df * sqrt(v) / sqrt(2 * df) AS loc, sqrt(v) / sqrt(2 * df) AS scale FROM p)"
_F = f"""WITH m AS (SELECT avg(x) AS m, var_pop(x) AS v FROM {_POS}), a AS (SELECT v, greatest(CASE WHEN m > 1 + 1e-6 THEN 2 * m / (m - 1) ELSE 10000 END, 4.01) AS d2 FROM m),
b AS (SELECT d2, v * pow(d2 - 2, 2) * (d2 - 4) - 2 * d2 * d2 AS u FROM a), q AS (SELECT CASE WHEN u > 0 THEN greatest(1.0, 2 * d2 * d2 * (d2 - 2) / u) ELSE 10000 END AS d1, d2 FROM b)"""

query("tfit", _T + " SELECT round(df, 5) AS df, round(loc, 5) AS loc, round(scale, 5) AS scale FROM q")(lambda spark, d: _row(spark, ("df", "loc", "scale"), D.fit_student(_positive(spark, d), "x")))
query("chi2fit", _C + " SELECT round(df, 5) AS df, round(loc, 5) AS loc, round(scale, 5) AS scale FROM q")(lambda spark, d: _row(spark, ("df", "loc", "scale"), D.fit_chi2(_positive(spark, d), "x")))
query("ffit", _F + " SELECT round(d1, 5) AS d1, round(d2, 5) AS d2 FROM q")(lambda spark, d: _row(spark, ("d1", "d2"), D.fit_f(_positive(spark, d), "x")))


_W = f"""WITH RECURSIVE x AS (SELECT x / (SELECT max(x) FROM {_POS}) AS x FROM {_POS}), c AS (SELECT avg(ln(x)) AS c FROM x),
b AS (SELECT 0 AS n, CAST(0.05 AS DOUBLE) AS lo, CAST(50 AS DOUBLE) AS hi UNION ALL SELECT n + 1, CASE WHEN s > 0 THEN lo ELSE sqrt(lo * hi) END, CASE WHEN s > 0 THEN sqrt(lo * hi) ELSE hi END
FROM (SELECT n, lo, hi, (SELECT sum(pow(x, sqrt(lo * hi)) * ln(x)) / sum(pow(x, sqrt(lo * hi))) FROM x) - 1 / sqrt(lo * hi) - (SELECT c FROM c) AS s FROM b WHERE n < 60)),
q AS (SELECT hi AS shape, (SELECT max(x) FROM {_POS}) * pow((SELECT avg(pow(x, hi)) FROM x), 1 / hi) AS scale FROM b WHERE n = 60)"""


@query("weibullfit", _W + " SELECT round(shape, 4) AS shape FROM q")
def weibull(spark, d):
    return spark.createDataFrame([(round(D.fit_weibull(_positive(spark, d), "x")[0], 4),)], "shape double")


def _pdf(name, fit, column, sql=None):
    query(f"fit_{name}_pdf", sql)(lambda spark, d: _positive(spark, d).select("event_id", F.round(column(F.col("x"), fit(_positive(spark, d), "x")), 9).alias("p")))


_pdf("norm", D.fit_normal, lambda x, p: D.normal_pdf(p[0], p[1], x), f"WITH q AS (SELECT avg(x) AS m, stddev_pop(x) AS s FROM {_POS}) SELECT event_id, round(exp(-0.5 * pow((x - m) / s, 2)) / (s * sqrt(2 * pi())), 9) AS p FROM {_POS}, q")
_pdf("lognorm", D.fit_lognormal, lambda x, p: D.lognormal_pdf(p[0], p[1], x), f"WITH q AS (SELECT avg(ln(x)) AS m, stddev_pop(ln(x)) AS s FROM {_POS}) SELECT event_id, round(exp(-0.5 * pow((ln(x) - m) / s, 2)) / (s * sqrt(2 * pi())) / x, 9) AS p FROM {_POS}, q")
_pdf("t", D.fit_student, lambda x, p: D.student_pdf(x, *p), _T + f" SELECT event_id, round(exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) / scale * pow(1 + pow((x - loc) / scale, 2) / df, -(df + 1) / 2), 9) AS p FROM {_POS}, q")
_pdf("chi2", D.fit_chi2, lambda x, p: D.chi2_pdf(x, *p), _C + f""" SELECT event_id, CASE WHEN z > 0 THEN round(exp(-(df / 2) * ln(2) - lgamma(df / 2) - ln(scale) + (df / 2 - 1) * ln(CASE WHEN z > 0 THEN z ELSE 1 END) - z / 2), 9) ELSE 0 END AS p
FROM (SELECT event_id, (x - loc) / scale AS z, df, scale FROM {_POS}, q)""")
_pdf("f", D.fit_f, lambda x, p: D.f_pdf(x, *p), _F + f" SELECT event_id, round(exp(d1 / 2 * ln(d1 / d2) + lgamma((d1 + d2) / 2) - lgamma(d1 / 2) - lgamma(d2 / 2) + (d1 / 2 - 1) * ln(x) - (d1 + d2) / 2 * ln(1 + d1 / d2 * x)), 9) AS p FROM {_POS}, q")
_pdf("weibull", D.fit_weibull, lambda x, p: D.weibull_pdf(p[0], p[1], x), _W + f" SELECT event_id, round(shape / scale * pow(x / scale, shape - 1) * exp(-pow(x / scale, shape)), 9) AS p FROM {_POS}, q")

#: Distribution functions of x under the parameters of q, and these parameters in order.
_FITS = {
    "norm": (D.fit_normal, f"WITH q AS (SELECT avg(x) AS mu, stddev_pop(x) AS sigma FROM {_POS})", ("mu", "sigma"), I.normal("((x - mu) / sigma)")),
    "lognorm": (D.fit_lognormal, f"WITH q AS (SELECT avg(ln(x)) AS mu, stddev_pop(ln(x)) AS sigma FROM {_POS})", ("mu", "sigma"), I.normal("((ln(x) - mu) / sigma)")),
    "t": (D.fit_student, _T, ("df", "loc", "scale"), I.student("((x - loc) / scale)", "df")), "chi2": (D.fit_chi2, _C, ("df", "loc", "scale"), I.gamma("(df / 2)", "((x - loc) / scale / 2)")),
    "f": (D.fit_f, _F, ("d1", "d2"), I.beta("(d1 / 2)", "(d2 / 2)", "(d1 * x / (d1 * x + d2))")), "weibull": (D.fit_weibull, _W, ("shape", "scale"), "1 - exp(-pow(x / scale, shape))"),
}


def _both(name, fit, head, names, cdf):
    digits = 5 if name == "weibull" else 7  # its shape is searched, not computed

    @query(f"fit_{name}_cdf", f"{head} SELECT event_id, round({cdf}, {digits}) AS p FROM {_POS}, q")
    def fitted(spark, d):
        return _positive(spark, d).select("event_id", F.round(D.cdf_column(name, F.col("x"), fit(_positive(spark, d), "x")), digits).alias("p"))

    values = ", ".join(f"round({n}, 4) AS p{k}" for k, n in enumerate(names))
    test = I.kolmogorov(f"(SELECT * FROM (SELECT x, count(*) AS n FROM {_POS} GROUP BY x), q)", cdf)

    @query(f"{name}test", f"{head} SELECT {values}, n, round(statistic, 7) AS statistic, round(p_value, 6) AS p_value FROM ({test}), q")
    def tested(spark, d):
        p = fit(_positive(spark, d), "x")
        done = ST.ks_test(_positive(spark, d), "x", name, p)
        return done.select(*[F.lit(round(float(v), 4)).alias(f"p{k}") for k, v in enumerate(p)], "n", F.round("statistic", 7).alias("statistic"), F.round("p_value", 6).alias("p_value"))


for _n, _parts in _FITS.items():
    _both(_n, *_parts)


@query("r2_by_r2adj", "SELECT l_orderkey, l_linenumber, round(1 - (1 - l_discount) * 47 / 49, 9) AS r2 FROM lineitem")
def unadjusted(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(ST.adjusted_to_r2(F.col("l_discount"), F.lit(50), F.lit(3)), 9).alias("r2"))


@query("plot_roc_bin", """WITH s AS (SELECT quality AS y, CAST(n_chars % 97 AS DOUBLE) AS s FROM documents JOIN labels USING (doc_id)), g AS (SELECT s, sum(y) AS p, count(*) - sum(y) AS n FROM s GROUP BY s)
SELECT s AS threshold, round(sum(p) OVER w / (SELECT sum(p) FROM g), 9) AS tpr, round(sum(n) OVER w / (SELECT sum(n) FROM g), 9) AS fpr FROM g WINDOW w AS (ORDER BY s DESC)""")
def roc(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").selectExpr("quality AS y", "CAST(n_chars % 97 AS DOUBLE) AS s")
    return ST.roc_points(rows, "y", "s").select("threshold", F.round("tpr", 9).alias("tpr"), F.round("fpr", 9).alias("fpr"))


@query("plot_histdist", "SELECT CAST(least(floor((value - a) / (b - a) * 20), 19) AS INTEGER) AS bin, count(*) AS n FROM events, (SELECT min(value) AS a, max(value) AS b FROM events) GROUP BY 1")
def histogram(spark, d):
    return ST.histogram(events(spark, d), "value", 20)


@query("cal_weights_mats")
def experts(spark, d):
    """Weights of three items by two experts who agree and one who is inconsistent and left out."""
    good = np.array([[1, 2, 4], [0.5, 1, 2], [0.25, 0.5, 1]])
    other = np.array([[1, 3, 5], [1 / 3, 1, 2], [1 / 5, 0.5, 1]])
    bad = np.array([[1, 9, 1 / 9], [1 / 9, 1, 9], [9, 1 / 9, 1]])
    return spark.createDataFrame([(k, round(float(w), 6)) for k, w in enumerate(S.combined_weights([good, other, bad], 0.1, 0.58))], "item int, weight double")


@query("sim_ri")
def simulated(spark, d):
    return S.random_indices(spark, range(4, 5), rounds=300, seed=1)


@query("html_to_soup", r"SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[ \t\n\r\f]+', ' ', 'g'))) AS digest FROM pages")
def text(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(C.html_text(F.col("html"))).alias("digest"))


@query("get_head_num", "SELECT page_id, len(regexp_extract_all(regexp_extract(html, '(?is)<head[^>]*>(.*?)</head>', 1), '<([A-Za-z])')) AS n FROM pages")
def head(spark, d):
    return table(spark, d, "pages").select("page_id", C.head_items(F.col("html")).cast("long").alias("n"))


@query("insert_src_head_end", "SELECT page_id, md5(replace(html, '</head>', '<script src=\"a.js\"></script></head>')) AS digest FROM pages")
def added(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(C.add_to_head(F.col("html"), '<script src="a.js"></script>')).alias("digest"))


@query("del_js_head_end", "SELECT page_id, md5(html) AS digest FROM pages")
def dropped(spark, d):
    both = C.drop_head_script(C.add_to_head(F.col("html"), '<script src="a.js"></script>'))
    return table(spark, d, "pages").select("page_id", F.md5(both).alias("digest"))


_TWO = "(SELECT user_id, count(value) FILTER (event_type = 'view') AS n0, avg(value) FILTER (event_type = 'view') AS m0, var_pop(value) FILTER (event_type = 'view') AS v0, count(value) FILTER (event_type <> 'view') AS n1, avg(value) FILTER (event_type <> 'view') AS m1, var_pop(value) FILTER (event_type <> 'view') AS v1 FROM events GROUP BY 1)"


def _two(spark, d):
    parts = [x for i, c in enumerate((F.col("event_type") == "view", F.col("event_type") != "view")) for x in (F.count(F.when(c, F.col("value"))).alias(f"n{i}"), F.avg(F.when(c, F.col("value"))).alias(f"m{i}"), F.var_pop(F.when(c, F.col("value"))).alias(f"v{i}"))]
    return events(spark, d).groupBy("user_id").agg(*parts)


@query("delta_var_d0", "SELECT user_id, round(var_pop(value), 7) AS v FROM events GROUP BY 1 HAVING count(value) FILTER (event_type = 'view') > 0 AND count(value) FILTER (event_type <> 'view') > 0")
def pooled(spark, d):
    return _two(spark, d).where("n0 > 0 AND n1 > 0").select("user_id", F.round(ST.pooled_variance(*[F.col(c) for c in ("n0", "m0", "v0", "n1", "m1", "v1")]), 7).alias("v"))


@query("delta_var_d", "SELECT user_id, round(var_pop(value) * count(value) / (count(value) - 2), 6) AS v FROM events GROUP BY 1 HAVING count(value) FILTER (event_type = 'view') > 2 AND count(value) FILTER (event_type <> 'view') > 2")
def pooled_free(spark, d):
    both = _two(spark, d).where("n0 > 2 AND n1 > 2")
    n = F.col("n0") + F.col("n1")
    return both.select("user_id", F.round(F.round(ST.pooled_variance(*[F.col(c) for c in ("n0", "m0", "v0", "n1", "m1", "v1")]) * n / (n - 2), 9), 6).alias("v"))  # exact halves stay halves
