"""Table queries."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..operators import frame as T
from .registry import plain, query, table


@query("df_na2value", "SELECT event_id, coalesce(CASE WHEN value > 50 THEN value END, -1.0) AS x FROM events")
def na(spark, d):
    df = table(spark, d, "events").select("event_id", F.when(F.col("value") > 50, F.col("value")).when(F.col("value") > 25, F.lit(float("nan"))).alias("x"))
    return T.na_to_value(df, -1.0)


@query("copy_df_structure", "SELECT * FROM customer LIMIT 0")
def structure(spark, d):
    return T.same_structure(table(spark, d, "customer"))


for _how, _sql in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("outer", "FULL JOIN")):
    query(f"merge_df_{_how}", f"""
WITH a AS (SELECT c_custkey AS k, c_name, c_acctbal AS bal FROM customer WHERE c_custkey % 3 <> 0), b AS (SELECT o_custkey AS k, o_orderkey, o_totalprice AS bal FROM orders)
SELECT coalesce(a.k, b.k) AS k, c_name, a.bal, o_orderkey FROM a {_sql} b ON a.k = b.k""")(
        lambda spark, d, how=_how: T.merge(
            table(spark, d, "customer").where("c_custkey % 3 <> 0").selectExpr("c_custkey AS k", "c_name", "c_acctbal AS bal"),
            table(spark, d, "orders").selectExpr("o_custkey AS k", "o_orderkey", "o_totalprice AS bal"), "k", how))


def _sides(spark, d):
    o = table(spark, d, "orders")
    old = o.where("o_orderkey % 4 <> 0").selectExpr("o_orderkey AS k", "o_totalprice AS price", "o_orderstatus AS status")
    new = o.where("o_orderkey % 3 = 0").selectExpr("o_orderkey AS k", "CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice * 2 END AS price", "o_orderpriority AS prio")
    return old, new


_SIDES = """WITH o AS (SELECT o_orderkey AS k, o_totalprice AS price, o_orderstatus AS status FROM orders WHERE o_orderkey % 4 <> 0),
n AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice * 2 END AS price, o_orderpriority AS prio FROM orders WHERE o_orderkey % 3 = 0)
SELECT coalesce(o.k, n.k) AS k, {} AS price, status, prio FROM o FULL JOIN n ON o.k = n.k"""


@query("update_df", _SIDES.format("CASE WHEN n.k IS NOT NULL THEN n.price ELSE o.price END"))
def upsert(spark, d):
    return T.upsert(*_sides(spark, d), "k")


@query("update_df_keep_old", _SIDES.format("CASE WHEN o.k IS NOT NULL THEN o.price ELSE n.price END"))
def upsert_old(spark, d):
    return T.upsert(*_sides(spark, d), "k", keep="old")


@query("merge_into2", _SIDES.format("coalesce(n.price, o.price)"))
def upsert_coalesce(spark, d):
    return T.upsert(*_sides(spark, d), "k", null_overwrites=False)


@query("update_df_no_keys", "SELECT c_nationkey, c_mktsegment FROM customer WHERE c_custkey % 2 = 0 UNION SELECT c_nationkey, c_mktsegment FROM customer WHERE c_custkey % 3 = 0")
def upsert_rows(spark, d):
    c = table(spark, d, "customer")
    return T.upsert_rows(c.where("c_custkey % 2 = 0").select("c_nationkey", "c_mktsegment"), c.where("c_custkey % 3 = 0").select("c_nationkey", "c_mktsegment"))


@query("dfs_concat_axis1", """
WITH a AS (SELECT n_nationkey AS k, n_name FROM nation WHERE n_nationkey < 15), b AS (SELECT c_nationkey AS k, count(*) AS customers FROM customer GROUP BY 1), c AS (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier WHERE s_nationkey > 5 GROUP BY 1)
SELECT k, n_name, customers, suppliers FROM a FULL JOIN b USING (k) FULL JOIN c USING (k)""")
def concat(spark, d):
    a = table(spark, d, "nation").where("n_nationkey < 15").selectExpr("n_nationkey AS k", "n_name")
    b = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    c = table(spark, d, "supplier").where("s_nationkey > 5").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    return T.side_by_side([a, b, c], "k")


@query("get_func_df_concat", "SELECT event_type, count(*) AS n, 50 AS cut FROM events WHERE value > 50 GROUP BY 1 UNION ALL SELECT event_type, count(*), 80 FROM events WHERE value > 80 GROUP BY 1")
def stack(spark, d):
    def one(cut):
        return table(spark, d, "events").where(F.col("value") > cut).groupBy("event_type").agg(F.count("*").alias("n")).withColumn("cut", F.lit(cut))

    return T.stack(one, [((50,), {}), ((80,), {})])


@query("df_groupby_func", "SELECT user_id, round(max(value) - min(value), 6) AS spread, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY user_id")
def grouped(spark, d):
    def run(frame):
        import pandas as pd

        return pd.DataFrame({"user_id": [frame.user_id.iloc[0]], "spread": [round(frame.value.max() - frame.value.min(), 6)], "n": [len(frame)]})

    return T.per_group(table(spark, d, "events").select("user_id", "value"), "user_id", run, "user_id long, spread double, n long")


@query("check_exist_data", "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS \"exists\" FROM customer")
def exists(spark, d):
    return T.exists_flag(table(spark, d, "customer").selectExpr("c_custkey", "c_custkey AS o_custkey"), table(spark, d, "orders"), "o_custkey").select("c_custkey", "exists")


_LONG = "SELECT user_id, event_type, max(value) AS v FROM events GROUP BY 1, 2"
_KINDS = ["click", "error", "purchase", "signup", "view"]


@query("df_rows2cols", "SELECT user_id, " + ", ".join(f"coalesce(max(v) FILTER (event_type = '{k}'), -1.0) AS {k}" for k in _KINDS) + f" FROM ({_LONG}) GROUP BY user_id")
def wide(spark, d):
    long = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("v"))
    return T.rows_to_cols(long, "user_id", "event_type", "v", _KINDS, -1.0)


@query("df_cols2rows", "SELECT l_orderkey, l_linenumber, 'l_quantity' AS name, l_quantity AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem")
def long(spark, d):
    return T.cols_to_rows(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax"), ["l_quantity", "l_tax"])


@query("pivot_table", """
WITH c AS (SELECT coalesce(l_returnflag, 'All') AS l_returnflag, coalesce(l_linestatus, 'All') AS s, max(l_quantity) AS v FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus))
SELECT l_returnflag, max(v) FILTER (s = 'F') AS "F", max(v) FILTER (s = 'O') AS "O", max(v) FILTER (s = 'All') AS "All" FROM c GROUP BY 1""")
def pivot(spark, d):
    return T.pivot_table(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", "l_quantity", F.max, ["F", "O"], margins=True)


@query("crosstab", """
WITH c AS (SELECT coalesce(l_returnflag, 'All') AS l_returnflag, coalesce(l_linestatus, 'All') AS s, count(*) AS v FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus))
SELECT l_returnflag, coalesce(max(v) FILTER (s = 'F'), 0) AS "F", coalesce(max(v) FILTER (s = 'O'), 0) AS "O", max(v) FILTER (s = 'All') AS "All" FROM c GROUP BY 1""")
def cross(spark, d):
    return T.crosstab(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", ["F", "O"], margins=True)


@query("crosstab_normalized", """
SELECT l_returnflag, round(count(*) FILTER (l_linestatus = 'F') / (SELECT count(*) FROM lineitem), 9) AS "F", round(count(*) FILTER (l_linestatus = 'O') / (SELECT count(*) FROM lineitem), 9) AS "O" FROM lineitem GROUP BY 1""")
def cross_share(spark, d):
    done = T.crosstab(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", ["F", "O"], normalize="all")
    return done.select("l_returnflag", F.round("F", 9).alias("F"), F.round("O", 9).alias("O"))


_DAILY = "SELECT user_id, CAST(ts AS DATE) AS day, max(value) AS v FROM events GROUP BY 1, 2"
_GRID = f"WITH x AS ({_DAILY}), g AS (SELECT user_id, day FROM (SELECT DISTINCT user_id FROM x) CROSS JOIN (SELECT DISTINCT day FROM x)), f AS (SELECT user_id, day, v FROM g LEFT JOIN x USING (user_id, day)) "
_BY = "PARTITION BY user_id ORDER BY day"
for _fill, _sql in ((None, "v"), ("ffill", f"last_value(v IGNORE NULLS) OVER ({_BY} ROWS UNBOUNDED PRECEDING)"),
                    ("both", f"coalesce(last_value(v IGNORE NULLS) OVER ({_BY} ROWS UNBOUNDED PRECEDING), first_value(v IGNORE NULLS) OVER ({_BY} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))")):
    def _dense(spark, d, fill=_fill):
        daily = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.max("value").alias("v"))
        return plain(T.densify(daily, "day", daily.select("day"), "user_id", "v", fill, method="pivot" if fill else "product"))

    query(f"get_full_df{'_' + _fill if _fill else ''}", _GRID + f"SELECT user_id, CAST(day AS VARCHAR) AS day, {_sql} AS v FROM f")(_dense)


@query("get_full_components_df", """
WITH m AS (SELECT o_custkey % 10 AS idx, o_orderkey AS item, CAST(o_orderdate AS DATE) AS tin, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderdate AS DATE) + 90 END AS tout FROM orders),
t AS (SELECT CAST(DATE '1995-01-01' + CAST(i * 61 AS INTEGER) AS DATE) AS "time" FROM range(20) r(i))
SELECT CAST("time" AS VARCHAR) AS "time", idx, item, CAST(tin AS VARCHAR) AS tin, CAST(tout AS VARCHAR) AS tout FROM t JOIN m ON tin <= "time" AND "time" <= coalesce(tout, DATE '1997-01-01')""")
def components(spark, d):
    m = table(spark, d, "orders").selectExpr("o_custkey % 10 AS idx", "o_orderkey AS item", "CAST(o_orderdate AS DATE) AS tin", "CASE WHEN o_orderkey % 5 <> 0 THEN date_add(CAST(o_orderdate AS DATE), 90) END AS tout")
    dates = spark.range(20).selectExpr("date_add(DATE '1995-01-01', CAST(id * 61 AS INT)) AS day")
    return plain(T.members_at(m, "idx", "item", "tin", "tout", dates, "day", datetime.date(1997, 1, 1)))


@query("get_topn_names", """
SELECT l_orderkey, l_linenumber, array_to_string(list_transform(list_slice(list_sort([{'v': -l_quantity, 'k': 0, 'c': 'l_quantity'}, {'v': -l_tax * 300, 'k': 1, 'c': 'tax'}, {'v': -l_discount * 300, 'k': 2, 'c': 'discount'}]), 1, 2), lambda x: x.c), ',') AS top FROM lineitem""")
def top(spark, d):
    df = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_quantity", "l_tax * 300 AS tax", "l_discount * 300 AS discount")
    return T.top_names(df, ["l_quantity", "tax", "discount"], 2).select("l_orderkey", "l_linenumber", F.array_join("top", ",").alias("top"))


@query("get_topn_names_rows", """
SELECT * FROM (SELECT name, p_partkey, value, row_number() OVER (PARTITION BY name ORDER BY value DESC, p_partkey) AS place FROM (SELECT 'p_size' AS name, p_partkey, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT 'p_retailprice', p_partkey, p_retailprice FROM part)) WHERE place <= 3""")
def top_rows(spark, d):
    return T.top_rows(table(spark, d, "part").selectExpr("p_partkey", "CAST(p_size AS DOUBLE) AS p_size", "p_retailprice"), "p_partkey", ["p_size", "p_retailprice"], 3)


@query("bootstrapping")
def boot(spark, d):
    return T.bootstrap(table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), 3, 7)
