"""Texts converted by tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import convert as C
from .registry import query, table

_NAMES = """n AS (SELECT list(s ORDER BY length(s) DESC, s) AS names FROM (SELECT n_name AS s FROM nation UNION SELECT r_name FROM region UNION SELECT left(n_name, 3) FROM nation)),
t AS (SELECT c_custkey, c_name || ' ' || n_name || '/' || r_name || '/' || left(n_name, 3) AS text FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)"""


def _names(spark, d):
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    held = nation.select(F.col("n_name").alias("source")).union(region.select("r_name")).union(nation.select(F.substring("n_name", 1, 3))).distinct()
    return held.withColumn("target", F.lower("source"))


def _texts(spark, d):
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    joined = table(spark, d, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select("c_custkey", F.concat("c_name", F.lit(" "), "n_name", F.lit("/"), "r_name", F.lit("/"), F.substring("n_name", 1, 3)).alias("text"))


@query("traditional2simplified", f"WITH {_NAMES} SELECT c_custkey, list_reduce(list_prepend(text, names), lambda x, s: replace(x, s, lower(s))) AS text FROM t, n")
def converted(spark, d):
    """Names and beginnings of names in a text by a table of them, the longest first."""
    return C.convert_text(_texts(spark, d), "text", _names(spark, d))


@query("simplified2traditional", f"WITH {_NAMES} SELECT c_custkey, text FROM t")
def back(spark, d):
    names = _names(spark, d)
    return C.convert_text(C.convert_text(_texts(spark, d), "text", names), "text", C.inverted(names))
