"""Scoring queries over parts and suppliers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import scoring as S
from .registry import query, table

_UNIT = "(p_size - a) / CAST(b - a AS DOUBLE) AS u, (d - p_retailprice) / (d - c) AS v"


def parts(spark, d):
    return table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")


_W = f"""WITH e AS (SELECT min(p_size) AS a, max(p_size) AS b, min(p_retailprice) AS c, max(p_retailprice) AS d, count(*) AS n FROM part), x AS (SELECT n, {_UNIT} FROM part, e),
s AS (SELECT max(n) AS n, sum(u) AS su, sum(v) AS sv FROM x), h AS (SELECT 1 + sum(CASE WHEN u > 0 THEN u / su * ln(CASE WHEN u > 0 THEN u ELSE 1 END / su) ELSE 0 END) / ln(max(s.n)) AS hu, 1 + sum(CASE WHEN v > 0 THEN v / sv * ln(CASE WHEN v > 0 THEN v ELSE 1 END / sv) ELSE 0 END) / ln(max(s.n)) AS hv FROM x, s)"""


@query("entropy_weight", _W + " SELECT 'p_size' AS name, round(hu / (hu + hv), 7) AS weight FROM h UNION ALL SELECT 'p_retailprice', round(hv / (hu + hv), 7) FROM h")
def entropy(spark, d):
    return S.entropy_weights(parts(spark, d), ["p_size", "p_retailprice"], ["p_retailprice"]).withColumn("weight", F.round("weight", 7))


@query("entropy_weight_score", _W + f" SELECT p_partkey, round((hu * u + hv * v) / (hu + hv), 7) AS score FROM (SELECT p_partkey, {_UNIT} FROM part, e), h")
def entropy_score(spark, d):
    return S.entropy_scores(parts(spark, d), ["p_size", "p_retailprice"], ["p_retailprice"]).select("p_partkey", F.round("score", 7).alias("score"))


@query("topsis", """WITH e AS (SELECT sqrt(sum(CAST(p_size AS DOUBLE) * p_size)) AS n, max(p_size) AS b, min(p_size) AS a, sqrt(sum(p_retailprice * p_retailprice)) AS m, max(p_retailprice) AS d, min(p_retailprice) AS c FROM part),
x AS (SELECT p_partkey, sqrt(0.7 * ((p_size - b) / n) ** 2 + 0.3 * ((p_retailprice - d) / m) ** 2) AS best, sqrt(0.7 * ((p_size - a) / n) ** 2 + 0.3 * ((p_retailprice - c) / m) ** 2) AS worst FROM part, e),
y AS (SELECT p_partkey, round(worst / (best + worst), 9) AS score FROM x) SELECT p_partkey, score, rank() OVER (ORDER BY score DESC) AS place FROM y""")
def topsis(spark, d):
    scored = S.topsis(parts(spark, d), ["p_size", "p_retailprice"], {"p_size": 0.7, "p_retailprice": 0.3}).select("p_partkey", F.round("score", 9).alias("score"))
    return S.with_place(scored, "score")


def _judged(spark, d):
    regions = table(spark, d, "nation").join(table(spark, d, "customer"), F.col("n_nationkey") == F.col("c_nationkey")).groupBy("n_regionkey").agg((F.sum("c_acctbal") / 1000).alias("s"))
    return S.judgement_matrix(regions.where("s > 0"), "n_regionkey", "s")


_J = """WITH r AS (SELECT n_regionkey AS k, sum(c_acctbal) / 1000 AS s FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY 1 HAVING sum(c_acctbal) > 0),
j AS (SELECT x.k AS a, y.k AS b, CASE WHEN x.s >= y.s THEN greatest(1.0, least(9.0, round(greatest(x.s, y.s) / least(x.s, y.s)))) ELSE 1 / greatest(1.0, least(9.0, round(greatest(x.s, y.s) / least(x.s, y.s)))) END AS value FROM r x, r y)"""


@query("score2JM", _J + " SELECT a, b, value FROM j")
def judged(spark, d):
    return _judged(spark, d)


@query("check_JM", _J + " SELECT max(abs(x.value * y.value - 1)) <= 0.001 AS good FROM j x JOIN j y ON x.a = y.b AND x.b = y.a")
def reciprocal(spark, d):
    return S.is_reciprocal(_judged(spark, d))


@query("cal_weights_sim", _J + ", s AS (SELECT b, sum(value) AS s FROM j GROUP BY 1) SELECT a AS name, round(avg(value / s), 9) AS weight FROM j JOIN s USING (b) GROUP BY 1")
def column_weights(spark, d):
    return S.column_weights(_judged(spark, d)).withColumn("weight", F.round("weight", 9))


#: The principal eigenvector by repeated products, and the largest eigenvalue as the sum of the next product.
_E = _J.replace("WITH r AS", "WITH RECURSIVE r AS") + """, m AS (SELECT list(a ORDER BY a) AS names, list(row ORDER BY a) AS m FROM (SELECT a, list(value ORDER BY b) AS row FROM j GROUP BY a)),
p AS (SELECT 0 AS step, names, m, list_transform(m, lambda row: 1.0 / len(m)) AS v FROM m UNION ALL SELECT step + 1, names, m, list_transform(y, lambda z: z / list_sum(y)) FROM (SELECT step, names, m, list_transform(m, lambda row: list_dot_product(row, v)) AS y FROM p WHERE step < 200))"""


def _matrix(spark, d):
    """The judgements of the five regions as a matrix."""
    rows = _judged(spark, d).collect()
    items = sorted({r.a for r in rows})
    m = np.ones((len(items), len(items)))
    for r in rows:
        m[items.index(r.a), items.index(r.b)] = r.value
    return items, m


@query("cal_weights", _E + " SELECT unnest(names) AS name, unnest(list_transform(v, lambda x: round(x, 7))) AS weight FROM p WHERE step = 200")
def eigen(spark, d):
    items, m = _matrix(spark, d)
    return spark.createDataFrame([(int(k), round(float(w), 7)) for k, w in zip(items, S.eigen_weights(m)[0])], "name int, weight double")


@query("cal_CI", _E + " SELECT round((list_sum(list_transform(m, lambda row: list_dot_product(row, v))) - len(m)) / (len(m) - 1), 7) + 0.0 AS ci FROM p WHERE step = 200")
def consistency(spark, d):
    return spark.createDataFrame([(round(float(S.eigen_weights(_matrix(spark, d)[1])[1]), 7) + 0.0,)], "ci double")


@query("cal_CI_sim", _J + """, s AS (SELECT b, sum(value) AS s FROM j GROUP BY 1), w AS (SELECT a, avg(value / s) AS w FROM j JOIN s USING (b) GROUP BY 1), p AS (SELECT j.a, sum(value * w) AS y FROM j JOIN w ON j.b = w.a GROUP BY 1)
SELECT round((avg(y / w) - count(*)) / (count(*) - 1), 7) AS ci FROM p JOIN w USING (a)""")
def consistency_by_columns(spark, d):
    return S.column_consistency(_judged(spark, d)).select(F.round("ci", 7).alias("ci"))


@query("get_RIs")
def indices(spark, d):
    return S.random_indices(spark, range(3, 8), rounds=200)
