"""Cleaning and scaling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import scale as S
from .registry import query, table
from .series import USER, W, events


def _bounds(center: str, width: str) -> str:
    return f"""SELECT event_id, round(CASE WHEN value > c + w THEN c + w WHEN value < c - w THEN c - w ELSE value END, 8) AS value FROM events JOIN
(SELECT event_type, {center} AS c, {width} AS w FROM events GROUP BY 1) USING (event_type)"""


@query("cut_mad", """WITH a AS (SELECT event_type, median(value) AS c FROM events GROUP BY 1), b AS (SELECT event_type, any_value(c) AS c, median(abs(value - c)) * 1.483 AS w FROM events JOIN a USING (event_type) GROUP BY 1)
SELECT event_id, round(CASE WHEN value > c + w THEN c + w WHEN value < c - w THEN c - w ELSE value END, 8) AS value FROM events JOIN b USING (event_type)""")
def mad(spark, d):
    return S.cut_mad(events(spark, d), "value", 1, ["event_type"]).select("event_id", F.round("value", 8).alias("value"))


@query("cut_nstd", _bounds("avg(value)", "stddev_samp(value)"))
def nstd(spark, d):
    return S.cut_nstd(events(spark, d), "value", 1, ["event_type"]).select("event_id", F.round("value", 8).alias("value"))


@query("norm_std", "SELECT event_id, round((value - c) / w, 8) AS value FROM events JOIN (SELECT event_type, avg(value) AS c, stddev_samp(value) AS w FROM events GROUP BY 1) USING (event_type)")
def std(spark, d):
    return S.standard(events(spark, d), "value", ["event_type"]).select("event_id", F.round("value", 8).alias("value"))


@query("series_norm_linear", "SELECT event_id, round(1 + (b - value) / (b - a) * 4, 8) AS value FROM events JOIN (SELECT event_type, min(value) AS a, max(value) AS b FROM events GROUP BY 1) USING (event_type)")
def linear(spark, d):
    return S.series_linear(events(spark, d), "value", ["event_type"], 1, 5, reverse=True).select("event_id", F.round("value", 8).alias("value"))


def _v():
    return F.col("value")


for _name, _col, _sql in (
        ("norm_linear", lambda: S.linear(_v(), -1000.0, 1000.0, 0, 10), "(value + 1000) / 2000 * 10"),
        ("norm_mid", lambda: S.middle(_v(), 10.0, 90.0, 1, 5, 40.0), "CASE WHEN value <= 10 OR value >= 90 THEN 1 WHEN value <= 40 THEN 1 + 4 * (value - 10) / 30 ELSE 1 + 4 * (90 - value) / 50 END"),
        ("norm01_mid", lambda: S.middle(_v(), 10.0, 90.0), "CASE WHEN value <= 10 OR value >= 90 THEN 0 WHEN value <= 50 THEN (value - 10) / 40 ELSE (90 - value) / 40 END"),
        ("norm_side", lambda: S.sides(_v(), 10.0, 90.0, 1, 5, 40.0, 7), "CASE WHEN value < 10 OR value > 90 THEN 7 WHEN value <= 40 THEN 1 + 4 * (40 - value) / 30 ELSE 1 + 4 * (value - 40) / 50 END"),
        ("norm01_side", lambda: S.sides(_v(), 10.0, 90.0), "CASE WHEN value < 10 OR value > 90 THEN 1 WHEN value <= 50 THEN (50 - value) / 40 ELSE (value - 50) / 40 END"),
        ("norm_range", lambda: S.in_range(_v(), 30.0, 60.0, 10.0, 90.0, 1, 5), "CASE WHEN value BETWEEN 30 AND 60 THEN 5 WHEN value <= 10 OR value >= 90 THEN 1 WHEN value < 30 THEN 1 + 4 * (value - 10) / 20 ELSE 1 + 4 * (90 - value) / 30 END"),
        ("norm01_range", lambda: S.in_range(_v(), 30.0, 60.0, 10.0, 90.0), "CASE WHEN value BETWEEN 30 AND 60 THEN 1 WHEN value <= 10 OR value >= 90 THEN 0 WHEN value < 30 THEN (value - 10) / 20 ELSE (90 - value) / 30 END"),
        ("sigmoid", lambda: X.sigmoid(_v() / 50), "1 / (1 + exp(-value / 50))"), ("softplus", lambda: X.softplus(_v() / 50), "ln(1 + exp(value / 50))"), ("tanh", lambda: F.tanh(_v() / 50), "(exp(value / 25) - 1) / (exp(value / 25) + 1)")):
    query(_name, f"SELECT event_id, round(CAST({_sql} AS DOUBLE), 8) AS y FROM events")(lambda spark, d, c=_col: events(spark, d).select("event_id", F.round(c().cast("double"), 8).alias("y")))


@query("softmax", "SELECT event_id, round(exp(value - m) / t, 10) AS softmax FROM events JOIN (SELECT user_id, m, sum(exp(value - m)) AS t FROM events JOIN (SELECT user_id, max(value) AS m FROM events GROUP BY 1) USING (user_id) GROUP BY 1, 2) USING (user_id)")
def softmax(spark, d):
    return S.softmax(events(spark, d), ["user_id"], "value").select("event_id", F.round("softmax", 10).alias("softmax"))


@query("softmax2d", """WITH a AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a FROM embeddings), e AS (SELECT vec_id, list_transform(a, lambda x: exp(x - list_max(a))) AS e FROM a)
SELECT vec_id, unnest(range(len(e))) AS place, unnest(list_transform(e, lambda x: round(x / list_sum(e), 10))) AS softmax FROM e""")
def softmax2d(spark, d):
    """One row for each element of each vector."""
    rows = table(spark, d, "embeddings").select("vec_id", F.posexplode(X.softmax_array(F.col("embedding"))).alias("place", "softmax"))
    return rows.select("vec_id", F.col("place").cast("long").alias("place"), F.round("softmax", 10).alias("softmax"))


@query("scale_skl_std", "SELECT l_orderkey, l_linenumber, round((l_quantity - a) / b, 8) AS l_quantity FROM lineitem, (SELECT avg(l_quantity) AS a, stddev_pop(l_quantity) AS b FROM lineitem)")
def skl(spark, d):
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return S.Scaler(df, "l_quantity").transform(df).withColumn("l_quantity", F.round("l_quantity", 8))


@query("scale_skl_inverse", "SELECT l_orderkey, l_linenumber, l_tax FROM lineitem")
def inverse(spark, d):
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_tax")
    fitted = S.Scaler(df, "l_tax", "minmax")
    return fitted.inverse(fitted.transform(df)).withColumn("l_tax", F.round("l_tax", 9))


_SP = "(SELECT event_id, CASE WHEN value > 80 THEN value END AS a, CASE WHEN value > 30 THEN value END AS b FROM events)"


def _sparse(spark, d):
    return events(spark, d).select("event_id", F.when(_v() > 80, _v()).alias("a"), F.when(_v() > 30, _v()).alias("b"))


@query("get_miss_rate", f"SELECT 'event_id' AS name, 0.0 AS rate UNION ALL SELECT 'a', avg(CASE WHEN a IS NULL THEN 1.0 ELSE 0 END) FROM {_SP} UNION ALL SELECT 'b', avg(CASE WHEN b IS NULL THEN 1.0 ELSE 0 END) FROM {_SP}")
def miss(spark, d):
    return S.miss_rate(_sparse(spark, d))


@query("drop_miss_feature", f"SELECT event_id, b FROM {_SP}")
def drop_cols(spark, d):
    return S.drop_sparse_columns(_sparse(spark, d), limit=0.6)


@query("drop_miss_sample", f"SELECT * FROM {_SP} WHERE (CASE WHEN a IS NULL THEN 1 ELSE 0 END + CASE WHEN b IS NULL THEN 1 ELSE 0 END) <= 1.5")
def drop_rows(spark, d):
    return S.drop_sparse_rows(_sparse(spark, d))


@query("fillna_ma", f"SELECT event_id, round(coalesce(x, CASE WHEN count(x) OVER w >= 2 THEN avg(x) OVER w END), 8) AS x FROM (SELECT *, CASE WHEN value > 30 THEN value END AS x FROM events) WINDOW w AS ({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def ma(spark, d):
    return S.fill_moving_average(events(spark, d).withColumn("x", F.when(_v() > 30, _v())), USER, "x", 5).select("event_id", F.round("x", 8).alias("x"))


for _how, _f in (("mean", "avg"), ("median", "median")):
    query(f"fillna_by_{_how}", f"SELECT event_id, round(coalesce(a, (SELECT {_f}(a) FROM {_SP})), 8) AS a, round(coalesce(b, (SELECT {_f}(b) FROM {_SP})), 8) AS b FROM {_SP}")(
        lambda spark, d, how=_how: S.fill_center(_sparse(spark, d), ["a", "b"], how).select("event_id", F.round("a", 8).alias("a"), F.round("b", 8).alias("b")))
