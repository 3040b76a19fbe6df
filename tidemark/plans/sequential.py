"""Queries whose rules follow each key's rows one by one, and forecasting."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extrema as E
from ..operators import lags as L
from ..operators import solve, subsets
from .registry import query, table
from .series import PRE, USER, W, events


def _extrema(spark, d):
    return E.find_extrema(events(spark, d), USER, "value", E.Limits(t_min=3, min_val=10.0))


@query("find_maxmin")
def extrema(spark, d):
    return _extrema(spark, d).select("event_id", "extremum")


@query("find_maxmin_rolling")
def rolling(spark, d):
    return E.last_labels(events(spark, d), USER, "value", 12, limits=E.Limits(t_min=2)).select("event_id", "extremum")


@query("find_maxmin_cum")
def cumulative(spark, d):
    return E.last_labels(events(spark, d), USER, "value", None, 5, E.Limits(t_min=2)).select("event_id", "extremum")


@query("del_tooclose_maxmin")
def apart(spark, d):
    return E.drop_close(_extrema(spark, d), USER, "value", "extremum", 0.2).select("event_id", "extremum")


_PEAKS = f"""e AS (SELECT user_id, value, row_number() OVER ({W}) AS rn, CASE WHEN value > lag(value) OVER ({W}) AND value > lead(value) OVER ({W}) THEN 1 WHEN value < lag(value) OVER ({W}) AND value < lead(value) OVER ({W}) THEN -1 ELSE 0 END AS m FROM events),
e2 AS (SELECT user_id, value, rn, CASE WHEN user_id % 3 = 0 AND rn > 8 THEN 0 WHEN user_id % 5 = 0 AND rn <> 3 THEN 0 ELSE m END AS m FROM e)"""


@query("check_maxmins", f"""WITH {_PEAKS},
l AS (SELECT *, row_number() OVER v AS k, lead(rn) OVER v AS rn2, lead(value) OVER v AS value2, lead(m) OVER v AS m2 FROM e2 WHERE m <> 0 WINDOW v AS (PARTITION BY user_id ORDER BY rn)),
u AS (SELECT user_id, max(value) AS hi, min(value) AS lo FROM e2 GROUP BY user_id),
n AS (SELECT user_id, count(*) AS n, count(*) FILTER (m = 1) AS ups, max(value) AS most, min(value) AS least, min(rn) AS first, max(rn) AS last FROM l GROUP BY user_id),
b AS (SELECT l.user_id, bool_or(l.m = l.m2 OR l.value = l.value2 OR e2.value > greatest(l.value, l.value2) OR e2.value < least(l.value, l.value2) OR (l.value - l.value2) * l.m < 0) AS bad FROM l JOIN e2 ON e2.user_id = l.user_id AND e2.rn BETWEEN l.rn AND l.rn2 WHERE l.rn2 IS NOT NULL GROUP BY 1),
o AS (SELECT l.user_id, bool_or((e2.value - l.value) * l.m > 0) AS bad FROM l JOIN n USING (user_id) JOIN e2 ON e2.user_id = l.user_id AND (l.rn = n.first AND e2.rn < n.first OR l.rn = n.last AND e2.rn > n.last) GROUP BY 1)
SELECT u.user_id, CASE WHEN n.n IS NULL THEN FALSE WHEN n.n = 1 THEN most IN (hi, lo) WHEN n.n = 2 THEN ups = 1 AND most > least AND most = hi AND least = lo AND NOT b.bad ELSE NOT b.bad AND NOT coalesce(o.bad, FALSE) END AS good
FROM u LEFT JOIN n USING (user_id) LEFT JOIN b USING (user_id) LEFT JOIN o USING (user_id)""")
def checked(spark, d):
    """Strict local extremes as labels, of some users only the first rows or one row: some are in order, some are not."""
    w = USER.window()
    before, behind = F.lag("value").over(w), F.lead("value").over(w)
    label = F.when((F.col("value") > before) & (F.col("value") > behind), 1).when((F.col("value") < before) & (F.col("value") < behind), -1).otherwise(0)
    rows = events(spark, d).withColumns({"label": label, "rn": USER.row()})
    few = F.when((F.col("user_id") % 3 == 0) & (F.col("rn") > 8), 0).when((F.col("user_id") % 5 == 0) & (F.col("rn") != 3), 0).otherwise(F.col("label"))
    return E.check_extrema(rows.withColumn("label", few), USER, "value", "label")


@query("get_his_maxmin_info")
def steps(spark, d):
    return E.extremum_steps(_extrema(spark, d), USER, "value", "extremum").select("event_id", "extremum", "diff", "pct", "gap")


_TURN = f"""WITH a AS (SELECT event_id, user_id, ts, value, sign(value - lag(value) OVER ({W})) AS s FROM events),
b AS (SELECT *, first_value(CASE WHEN s <> 0 THEN s END IGNORE NULLS) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS n FROM a),
t AS (SELECT event_id, user_id, ts, value, CAST(CASE WHEN s IS NULL THEN coalesce(-n, 0) WHEN s <> 0 AND (n IS NULL OR n <> s) THEN s ELSE 0 END AS INTEGER) AS turn FROM b)"""


@query("get_maxmin_neighbor_label", _TURN + f"""
SELECT event_id, coalesce(CASE WHEN turn <> 0 THEN turn END, CASE WHEN lag(turn) OVER w <> 0 AND abs((value - lag(value) OVER w) / nullif(lag(value) OVER w, 0)) <= 0.2 THEN lag(turn) OVER w END,
CASE WHEN lead(turn) OVER w <> 0 AND abs((value - lead(value) OVER w) / nullif(lead(value) OVER w, 0)) <= 0.2 THEN lead(turn) OVER w END, 0) AS near FROM t WINDOW w AS ({W})""")
def near(spark, d):
    from ..operators.series import turns

    return E.near_extrema(turns(events(spark, d), USER, "value"), USER, "value", "turn", 1, 0.2).select("event_id", "near")


@query("get_maxmin_records", _TURN + f" SELECT user_id, turn, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, value FROM t WHERE turn <> 0")
def records(spark, d):
    from ..operators.series import turns

    hits = turns(events(spark, d), USER, "value").where("turn <> 0")
    return hits.select("user_id", "turn", USER.row().alias("k"), "value")


@query("get_last_sure_maxmin_info", _TURN + f""", r AS (SELECT *, row_number() OVER ({W}) AS rn, count(*) OVER (PARTITION BY user_id) AS n, last_value(value) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM t)
SELECT user_id, max_by(turn, rn) AS label, max_by(value, rn) AS value, min(n - rn) AS since FROM r WHERE turn <> 0 AND n - rn >= 5 AND abs((l - value) / nullif(value, 0)) >= 0.001 GROUP BY user_id""")
def last_sure(spark, d):
    from ..operators.series import turns

    return E.last_extremum(turns(events(spark, d), USER, "value"), USER, "value", "turn")


_POS = _TURN + f""", r AS (SELECT *, row_number() OVER ({W}) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM t), l AS (SELECT *, CASE WHEN n - rn >= 2 THEN turn ELSE 0 END AS l FROM r),
p AS (SELECT *, last_value(CASE WHEN l = 1 THEN value END IGNORE NULLS) OVER b AS vmax, last_value(CASE WHEN l = 1 THEN rn END IGNORE NULLS) OVER b AS rmax, last_value(CASE WHEN l = -1 THEN value END IGNORE NULLS) OVER b AS vmin, last_value(CASE WHEN l = -1 THEN rn END IGNORE NULLS) OVER b AS rmin
FROM l WINDOW b AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT user_id, max(CASE WHEN rn = n THEN rn - rmin END) AS gap_min2now, max(CASE WHEN rn = n THEN rn - rmax END) AS gap_max2now, round(max(CASE WHEN rn = n THEN value - vmin END), 6) AS dif_min2now, round(max(CASE WHEN rn = n THEN vmax - value END), 6) AS dif_max2now,
round((max(CASE WHEN rn = n THEN rn - rmin END) - min(CASE WHEN l = 1 THEN rn - rmin END)) / nullif(CAST(max(CASE WHEN l = 1 THEN rn - rmin END) - min(CASE WHEN l = 1 THEN rn - rmin END) AS DOUBLE), 0), 6) AS pos_gap_min2now,
round((max(CASE WHEN rn = n THEN vmax - value END) - min(CASE WHEN l = -1 THEN vmax - value END)) / nullif(max(CASE WHEN l = -1 THEN vmax - value END) - min(CASE WHEN l = -1 THEN vmax - value END), 0), 6) AS pos_dif_max2now, max(CASE WHEN rn = n THEN vmax END) AS pre_max,
max_by(l, CASE WHEN l <> 0 THEN rn END) FILTER (l <> 0) AS last_label FROM p GROUP BY user_id"""


@query("get_last_pos_info", _POS)
def position(spark, d):
    from ..operators.series import turns

    found = E.last_position(turns(events(spark, d), USER, "value"), USER, "value", "turn")
    return found.select("user_id", "gap_min2now", "gap_max2now", *[F.round(c, 6).alias(c) for c in ("dif_min2now", "dif_max2now", "pos_gap_min2now", "pos_dif_max2now")], "pre_max", "last_label")


_SNAPS = "(SELECT user_id, event_id, CAST(floor(value / 10) AS INTEGER) AS place, CASE WHEN event_id % 7 < 5 THEN 1 ELSE -1 END AS label, ts FROM events)"


def _snapshots(spark, d):
    return events(spark, d).selectExpr("user_id", "event_id", "ts", "CAST(floor(value / 10) AS INT) AS place", "CASE WHEN event_id % 7 < 5 THEN 1 ELSE -1 END AS label")


@query("get_continue_maxmin_info", f"""WITH a AS (SELECT *, CASE WHEN coalesce(place - lag(place) OVER ({W}) <> 1 OR lag(label) OVER ({W}) <> label, TRUE) THEN 1 ELSE 0 END AS b FROM {_SNAPS}), s AS (SELECT *, sum(b) OVER ({W}) AS s FROM a),
g AS (SELECT user_id, s, count(*) AS n, max(label) AS label FROM s GROUP BY 1, 2) SELECT user_id, max_by(n, s) AS n, max_by(label, s) AS label FROM g GROUP BY 1""")
def streak(spark, d):
    return E.streak_of_signals(_snapshots(spark, d), USER, "place", "label")


@query("disaper", f"""WITH a AS (SELECT *, place BETWEEN 3 AND 5 AS s FROM {_SNAPS}), c AS (SELECT *, max(CASE WHEN s THEN 1 ELSE 0 END) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a FROM a) SELECT user_id, bool_or(a = 1 AND NOT s) AS vanished FROM c GROUP BY 1""")
def gone(spark, d):
    return E.vanished(_snapshots(spark, d), USER, "place", 4, 1)


_XY = ", ".join(f"{move}({c}, 3) OVER w AS {c}{k}" for k, move in ((0, "lag"), (2, "lead")) for c in "xy")


@query("rolling_curvature_3point", f"""WITH a AS (SELECT event_id, user_id, ts, floor(epoch(ts)) / 3600.0 AS x, value AS y FROM events), p AS (SELECT event_id, x, y, {_XY} FROM a WINDOW w AS ({W})),
s AS (SELECT *, sqrt(pow(x - x0, 2) + pow(y - y0, 2)) AS a, sqrt(pow(x2 - x, 2) + pow(y2 - y, 2)) AS b FROM p), t AS (SELECT event_id, a, b, (x - x0) / nullif(a, 0) AS p, (x2 - x) / nullif(b, 0) AS q, (y - y0) / nullif(a, 0) AS r, (y2 - y) / nullif(b, 0) AS s FROM s),
u AS (SELECT event_id, (p * b + q * a) / (a + b) AS dx, (q - p) / (a + b) * 2 AS ex, (r * b + s * a) / (a + b) AS dy, (s - r) / (a + b) * 2 AS ey FROM t)
SELECT event_id, round((ex * dy - ey * dx) / nullif(pow(dx * dx + dy * dy, 1.5), 0), 7) AS curvature FROM u""")
def curve(spark, d):
    df = events(spark, d).withColumn("x", F.unix_seconds(F.col("ts").cast("timestamp")) / 3600.0)
    return E.rolling_curvature(df, USER, "x", "value").select("event_id", F.round("curvature", 7).alias("curvature"))


@query("backpack01_float_dy")
def knapsack(spark, d):
    parts = table(spark, d, "part").select("p_brand", F.col("p_size").cast("double").alias("w"), "p_retailprice", "p_partkey")
    return solve.knapsack_by(parts, "p_brand", "p_retailprice", "w", 120.0, "p_partkey")


@query("find_addends_bigfirst")
def addends(spark, d):
    return solve.subset_sum_by(table(spark, d, "lineitem").select("l_suppkey", "l_quantity", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k")), "l_suppkey", "l_quantity", 137.0, "k")


def _parts(spark, d):
    return table(spark, d, "part").select("p_brand", "p_size", "p_retailprice", "p_partkey")


def _loads(capacity: int) -> str:
    """The best value of every capacity, one part after another, as all sizes are whole."""
    return f"""WITH RECURSIVE a AS (SELECT p_brand, CAST(p_size AS INTEGER) AS w, p_retailprice AS v, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part),
s AS (SELECT p_brand, CAST(0 AS BIGINT) AS r, list_transform(range({capacity} + 1), lambda c: CAST(0 AS DOUBLE)) AS best FROM a GROUP BY 1
UNION ALL SELECT s.p_brand, s.r + 1, list_transform(range({capacity} + 1), lambda c: CASE WHEN c >= a.w THEN greatest(s.best[c + 1], s.best[c - a.w + 1] + a.v) ELSE s.best[c + 1] END) FROM s JOIN a ON a.p_brand = s.p_brand AND a.r = s.r + 1)
SELECT p_brand, round(max(best[{capacity} + 1]), 4) AS total FROM s GROUP BY 1"""


@query("backpack01_int_dy", _loads(120))
def knapsack_whole(spark, d):
    """Whole weights; the capacity is that of the other knapsack query, and so are the totals."""
    return solve.knapsack_value_by(_parts(spark, d), "p_brand", "p_retailprice", "p_size", 120).withColumn("total", F.round("total", 4))


@query("backpack01_float_dy_smp", _loads(60))
def knapsack_value(spark, d):
    return solve.knapsack_value_by(_parts(spark, d), "p_brand", "p_retailprice", "p_size", 60.0, whole=False).withColumn("total", F.round("total", 4))


#: Sums of whole quantities within a target, by supplier: every sum that some of its orders' first lines reach.
_SUMS = """WITH RECURSIVE a AS (SELECT l_suppkey, CAST(l_quantity AS INTEGER) AS q, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS r FROM lineitem),
s AS (SELECT l_suppkey, 0 AS r, [0] AS reach FROM a GROUP BY 1 UNION ALL SELECT s.l_suppkey, s.r + 1, list_distinct(list_concat(s.reach, list_filter(list_transform(s.reach, lambda x: x + a.q), lambda x: x <= 137))) FROM s JOIN a ON a.l_suppkey = s.l_suppkey AND a.r = s.r + 1)
SELECT l_suppkey, CAST(max(list_max(reach)) AS DOUBLE) AS total FROM s GROUP BY 1"""


@query("find_addends_backpack01int", _SUMS)
def nearest(spark, d):
    return solve.nearest_sum_by(table(spark, d, "lineitem").select("l_suppkey", "l_quantity"), "l_suppkey", "l_quantity", 137.0)


@query("find_addends_backpack01float", _SUMS.replace("CAST(l_quantity AS INTEGER)", "CAST(round(l_tax * 100) AS INTEGER)").replace("137", "55").replace("CAST(max(list_max(reach)) AS DOUBLE)", "max(list_max(reach)) / 100"))
def nearest_broken(spark, d):
    return solve.nearest_sum_by(table(spark, d, "lineitem").select("l_suppkey", "l_tax"), "l_suppkey", "l_tax", 0.55).withColumn("total", F.round("total", 6))


_BAND = """WITH RECURSIVE a AS (SELECT l_orderkey, l_orderkey * 10 + l_linenumber AS k, CAST(round((l_quantity - 25.5) * 10) AS BIGINT) AS x, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) AS r FROM lineitem),
s AS (SELECT l_orderkey, r, x, [k] AS items FROM a UNION ALL SELECT a.l_orderkey, a.r, s.x + a.x, list_append(s.items, a.k) FROM s JOIN a ON a.l_orderkey = s.l_orderkey AND a.r > s.r)"""


def _lines(spark, d):
    """Quantities about their middle: with decimals, half of them negative."""
    return table(spark, d, "lineitem").select("l_orderkey", (F.col("l_quantity") - 25.5).alias("x"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"))


@query("find_addends_recu", _BAND + " SELECT l_orderkey, array_to_string(items, ',') AS items FROM s WHERE x BETWEEN 75 AND 115")
def addend_sets(spark, d):
    """Every set of an order's lines whose quantities add up to 10 more or less."""
    sets = subsets.sums_by(_lines(spark, d), "l_orderkey", "x", 10.0, "k", below=2.5, above=1.5)
    return sets.select("l_orderkey", F.array_join("items", ",").alias("items"))


@query("find_addends_recu_count", """WITH RECURSIVE a AS (SELECT l_partkey, CAST(l_quantity AS INTEGER) AS q, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS r FROM lineitem),
s AS (SELECT l_partkey, CAST(0 AS BIGINT) AS r, list_transform(range(101), lambda c: CASE WHEN c = 0 THEN 1::HUGEINT ELSE 0::HUGEINT END) AS ways FROM a GROUP BY 1
UNION ALL SELECT s.l_partkey, s.r + 1, list_transform(range(101), lambda c: CASE WHEN c >= a.q THEN s.ways[c + 1] + s.ways[c - a.q + 1] ELSE s.ways[c + 1] END) FROM s JOIN a ON a.l_partkey = s.l_partkey AND a.r = s.r + 1)
SELECT l_partkey, CAST(max(ways[101]) AS DOUBLE) AS sets FROM s GROUP BY 1""")
def addend_counts(spark, d):
    """How many sets of a part's lines add up to 100; there may be very many."""
    rows = table(spark, d, "lineitem").select("l_partkey", "l_quantity", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"))
    return subsets.count_sums_by(rows, "l_partkey", "l_quantity", 100.0, "k").select("l_partkey", F.col("sets").cast("double").alias("sets"))


@query("backfind_sml1st_index", "SELECT l_orderkey, CAST(coalesce(list_max(list_filter(range(len(a)), lambda k: a[k + 1] <= 20.5)), 0) AS INTEGER) AS place FROM (SELECT l_orderkey, list(l_quantity ORDER BY l_quantity) AS a FROM lineitem GROUP BY 1)")
def last_fitting(spark, d):
    held = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_quantity")).alias("a"))
    return held.select("l_orderkey", subsets.last_fitting(F.col("a"), 20.0, 0.5).alias("place"))


@query("find_addends_smlfirst")
def addends_small_first(spark, d):
    """Values that add up to the target, within a tolerance, a given number of them; the search begins with the smallest."""
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_quantity", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"))
    return solve.subset_sum_by(rows, "l_suppkey", "l_quantity", 60.0, "k", below=1.0, above=1.0, count=3, smallest=True)


@query("get_alts_sml", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity <= 20.5")
def alternatives(spark, d):
    return solve.candidates(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity", 20.0, 0.5)


@query("valid_test_predict_X2d_y1d1step", f"""SELECT event_id, split, round(2 + 0.6 * l1 + 0.3 * l2, 8) AS pred FROM (SELECT event_id, CASE WHEN event_id % 10 < 7 THEN 'train' WHEN event_id % 10 < 9 THEN 'valid' ELSE 'test' END AS split, lag(value) OVER ({W}) AS l1, lag(value, 2) OVER ({W}) AS l2 FROM events) WHERE l2 IS NOT NULL""")
def splits(spark, d):
    m = L.lag_matrix(events(spark, d), USER, "value", {"value": 2})
    parts = {"train": m.where("event_id % 10 < 7"), "valid": m.where("event_id % 10 BETWEEN 7 AND 8"), "test": m.where("event_id % 10 = 9")}
    done = L.split_predict(parts, L.linear_predictor({"value_lag1": 0.6, "value_lag2": 0.3}, 2.0))
    return done.select("event_id", "split", F.round("pred", 8).alias("pred"))


@query("forward_valid_test_predict_X2d_y1d1step", f"""WITH RECURSIVE h AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events),
s AS (SELECT user_id, 0 AS step, max(value) FILTER (r = n - 7) AS a, max(value) FILTER (r = n - 6) AS b FROM h WHERE n > 8 GROUP BY 1), f AS (SELECT * FROM s UNION ALL SELECT user_id, step + 1, b, 2 + 0.6 * b + 0.3 * a FROM f WHERE step < 6)
SELECT user_id, step, CASE WHEN step <= 3 THEN 'valid' ELSE 'test' END AS split, round(b, 8) AS forecast FROM f WHERE step > 0""")
def forward_splits(spark, d):
    """The last three rows of each user are the test, the three before them the validation; both are forecast from what is before."""
    rows = events(spark, d).withColumns({"__r": USER.row(), "__n": F.count(F.lit(1)).over(USER.whole())}).where("__n > 8 AND __r <= __n - 6")
    done = L.recursive_forecast(rows.select("user_id", "ts", "event_id", "value"), USER, "value", 2, 6, lambda x: 2 + 0.6 * x[1] + 0.3 * x[0])
    return done.select("user_id", "step", F.when(F.col("step") <= 3, "valid").otherwise("test").alias("split"), F.round("forecast", 8).alias("forecast"))


#: Two values a block from the last three, (a, b, c): their mean and c; the next block starts from c, the mean and c.
_BLOCKS = """f AS (SELECT * FROM s UNION ALL SELECT user_id, k + 1, c, (a + b + c) / 3, c FROM f WHERE k < 3), g AS (SELECT user_id, 2 * k - 1 AS step, b AS forecast FROM f WHERE k > 0 UNION ALL SELECT user_id, 2 * k, c FROM f WHERE k > 0)"""


@query("forward_valid_test_predict_X2d_y1dsteps", f"""WITH RECURSIVE h AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events),
s AS (SELECT user_id, 0 AS k, max(value) FILTER (r = n - 8) AS a, max(value) FILTER (r = n - 7) AS b, max(value) FILTER (r = n - 6) AS c FROM h WHERE n > 9 GROUP BY 1), {_BLOCKS}
SELECT user_id, step, round(forecast, 8) AS forecast, CASE WHEN step <= 3 THEN 'valid' ELSE 'test' END AS split FROM g""")
def forward_split_steps(spark, d):
    rows = events(spark, d).withColumns({"__r": USER.row(), "__n": F.count(F.lit(1)).over(USER.whole())}).where("__n > 9 AND __r <= __n - 6")
    done = L.recursive_forecast(rows.select("user_id", "ts", "event_id", "value"), USER, "value", 3, 6, lambda x: [x.mean(), x[-1]], steps=2)
    return done.select("user_id", "step", F.round("forecast", 8).alias("forecast"), F.when(F.col("step") <= 3, "valid").otherwise("test").alias("split"))


@query("genXy_X2d_y1d1step", f"""SELECT * FROM (SELECT user_id, CAST(ts AS VARCHAR) AS ts, event_id, lag(value, 4) OVER ({W}) AS value_lag4, lag(value, 3) OVER ({W}) AS value_lag3, lag(value, 2) OVER ({W}) AS value_lag2, event_id AS x_event_id, value AS y0, row_number() OVER ({W}) AS rn FROM events) WHERE rn > 4""".replace("SELECT * FROM (", "SELECT * EXCLUDE (rn) FROM ("))
def lag_matrix(spark, d):
    return L.lag_matrix(events(spark, d), USER, "value", {"value": 3}, ["event_id"], gap=1).withColumn("ts", F.col("ts").cast("string"))


@query("genXy_X2d_y1dsteps", f"""SELECT * EXCLUDE (rn, n) FROM (SELECT user_id, CAST(ts AS VARCHAR) AS ts, event_id, lag(value, 2) OVER ({W}) AS value_lag2, lag(value, 1) OVER ({W}) AS value_lag1, value AS y0, lead(value) OVER ({W}) AS y1, row_number() OVER ({W}) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE rn > 2 AND rn < n""")
def lag_matrix_steps(spark, d):
    return L.lag_matrix(events(spark, d), USER, "value", {"value": 2}, steps=2).withColumn("ts", F.col("ts").cast("string"))


@query("get_directional_accuracy_1step", f"""WITH a AS (SELECT user_id, value, value * 0.9 + 5 AS p, lag(value) OVER ({W}) AS l FROM events)
SELECT user_id, round(avg(CASE WHEN coalesce(sign(value - l), 0) = coalesce(sign(p - l), 0) THEN 1.0 ELSE 0 END), 9) AS accuracy FROM a GROUP BY 1""")
def direction(spark, d):
    df = events(spark, d).withColumn("p", F.col("value") * 0.9 + 5)
    return L.directional_accuracy(df, USER, "value", "p").withColumn("accuracy", F.round("accuracy", 9))


@query("predict_X2d_y1d1step", f"SELECT event_id, round(2 + 0.6 * l1 + 0.3 * l2, 8) AS pred FROM (SELECT event_id, lag(value) OVER ({W}) AS l1, lag(value, 2) OVER ({W}) AS l2 FROM events) WHERE l2 IS NOT NULL")
def static(spark, d):
    m = L.lag_matrix(events(spark, d), USER, "value", {"value": 2})
    return m.select("event_id", F.round(L.linear_predictor({"value_lag1": 0.6, "value_lag2": 0.3}, 2.0), 8).alias("pred"))


@query("forward_predict_X2d_y1d1step", f"""WITH RECURSIVE h AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events),
s AS (SELECT user_id, 0 AS step, max(value) FILTER (r = 2) AS a, max(value) FILTER (r = 1) AS b FROM h GROUP BY 1), f AS (SELECT * FROM s UNION ALL SELECT user_id, step + 1, b, 2 + 0.6 * b + 0.3 * a FROM f WHERE step < 5)
SELECT user_id, step, round(b, 8) AS forecast FROM f WHERE step > 0""")
def recursive(spark, d):
    return L.recursive_forecast(events(spark, d), USER, "value", 2, 5, lambda x: 2 + 0.6 * x[1] + 0.3 * x[0]).withColumn("forecast", F.round("forecast", 8))


@query("forward_predict_X2d_y1dsteps", f"""WITH RECURSIVE h AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events),
s AS (SELECT user_id, 0 AS k, max(value) FILTER (r = 3) AS a, max(value) FILTER (r = 2) AS b, max(value) FILTER (r = 1) AS c FROM h GROUP BY 1), {_BLOCKS}
SELECT user_id, step, CASE WHEN (SELECT count(*) FROM h WHERE h.user_id = g.user_id) > 2 THEN round(forecast, 8) END AS forecast FROM g""")
def recursive_steps(spark, d):
    return L.recursive_forecast(events(spark, d), USER, "value", 3, 6, lambda x: [x.mean(), x[-1]], steps=2).withColumn("forecast", F.round("forecast", 8))
