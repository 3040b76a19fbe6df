"""Ordered-series queries: events of a user in time, lines of an order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import series as S
from ..operators.order import Order
from .registry import query, table

USER = Order("user_id", ("ts", "event_id"))
LINE = Order("l_orderkey", ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
W = "PARTITION BY user_id ORDER BY ts, event_id"
UP = f"({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
PRE = f"({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def events(spark, d):
    return table(spark, d, "events")


def high():
    return F.col("value") > 50


@query("con_count", f"""
WITH a AS (SELECT event_id, user_id, ts, CASE WHEN value > 50 THEN 1 ELSE 0 END AS c FROM events),
b AS (SELECT *, sum(1 - c) OVER {UP} AS g FROM a)
SELECT event_id, user_id, CAST(CASE WHEN c = 1 THEN sum(c) OVER (PARTITION BY user_id, g ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) ELSE 0 END AS BIGINT) AS con_count FROM b""")
def con_count(spark, d):
    return S.con_count(events(spark, d), USER, high()).select("event_id", "user_id", "con_count")


@query("con_count_ignore", f"""
WITH a AS (SELECT event_id, user_id, ts, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS i, CASE WHEN value > 50 AND event_type <> 'error' THEN 1 ELSE 0 END AS c FROM events),
b AS (SELECT *, sum((1 - c) * (1 - i)) OVER {UP} AS g FROM a)
SELECT event_id, CAST(CASE WHEN c = 1 THEN sum(c) OVER (PARTITION BY user_id, g ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) ELSE 0 END AS BIGINT) AS con_count FROM b""")
def con_count_ignore(spark, d):
    return S.con_count_ignore(events(spark, d), USER, high(), F.col("event_type") == "error").select("event_id", "con_count")


@query("get_preval_func_cond", f"SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER {PRE} AS preval FROM events")
def previous(spark, d):
    return S.previous_match(events(spark, d), USER, "value", F.col("event_type") == "purchase").select("event_id", "preval")


@query("gap_count", f"""
WITH a AS (SELECT event_id, user_id, ts, value, row_number() OVER ({W}) AS rn FROM events)
SELECT event_id, coalesce(rn - last_value(CASE WHEN value > 50 THEN rn END IGNORE NULLS) OVER {PRE}, 0) AS gap FROM a""")
def gap(spark, d):
    return S.gap_count(events(spark, d), USER, high()).select("event_id", "gap")


def _between_sql(now_gap: bool, now: bool) -> str:
    b2 = "CASE WHEN g = 1 AND seg > 1 THEN CASE WHEN p = 1 THEN n ELSE lag(b) OVER w + n END ELSE b END" if now_gap else "b"
    last = "b2" if now else f"CASE WHEN {'p' if now_gap else 'g'} = 1 THEN 0 ELSE coalesce(lag(b2) OVER w, 0) END"
    return f"""
WITH a AS (SELECT event_id, user_id, ts, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS g, CASE WHEN value > 50 THEN 1 ELSE 0 END AS n FROM events),
s AS (SELECT *, sum(g) OVER {UP} AS seg FROM a),
t AS (SELECT *, CASE WHEN g = 1 OR seg = 0 THEN 0 ELSE sum(n * (1 - g)) OVER (PARTITION BY user_id, seg ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) END AS b, coalesce(lag(g) OVER ({W}), 0) AS p FROM s),
u AS (SELECT *, {b2} AS b2 FROM t WINDOW w AS ({W}))
SELECT event_id, CAST({last} AS BIGINT) AS count FROM u WINDOW w AS ({W})"""


def _between(now_gap: bool, now: bool):
    def run(spark, d):
        return S.count_between_gap(events(spark, d), USER, F.col("event_type") == "purchase", high(), now_gap, now).select("event_id", "count")

    return run


for _g in (False, True):
    for _n in (False, True):
        query(f"count_between_gap_{'gap' if _g else 'nogap'}_{'now' if _n else 'before'}", _between_sql(_g, _n))(_between(_g, _n))

for _name, _agg in (("max", F.max), ("min", F.min), ("count", F.count)):
    for _first in (False, True):
        _run = f"{_name}(value) OVER (PARTITION BY user_id, g ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"
        _open = {"max": f"greatest({_run}, o)", "min": f"least({_run}, o)", "count": f"{_run} + CASE WHEN o IS NULL THEN 0 ELSE 1 END"}[_name]
        query(f"val_gap_cond_{_name}{'_contain_first' if _first else ''}", f"""
WITH a AS (SELECT event_id, user_id, ts, value, coalesce(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER {PRE}, 0) AS g,
last_value(CASE WHEN event_type = 'signup' THEN value END IGNORE NULLS) OVER {PRE} AS o FROM events)
SELECT event_id, CASE WHEN g > 0 THEN {_open if _first else _run} END AS val_gap FROM a""")(
            lambda spark, d, agg=_agg, first=_first: S.val_gap_cond(events(spark, d), USER, F.col("value"), F.col("event_type") == "signup", agg, contain_first=first).select("event_id", "val_gap"))


def _repeat_sql(direction: str) -> str:
    return f"""
WITH a AS (SELECT event_id, user_id, ts, CASE WHEN value > 50 THEN 1 WHEN value > 25 THEN 0 ELSE -1 END AS x FROM events),
b AS (SELECT *, last_value(CASE WHEN x <> 0 THEN x END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts {direction}, event_id {direction} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM a)
SELECT event_id, CASE WHEN x = 1 AND p = 1 THEN 0 ELSE x END AS x FROM b"""


def _signal(spark, d):
    return events(spark, d).withColumn("x", F.when(high(), 1).when(F.col("value") > 25, 0).otherwise(-1))


for _last in (False, True):
    query(f"replace_repeat{'_keep_last' if _last else ''}", _repeat_sql("DESC" if _last else "ASC"))(
        lambda spark, d, last=_last: S.replace_repeat(_signal(spark, d), USER, "x", F.col("x") == 1, F.lit(0), F.col("x") == 0, keep_last=last).select("event_id", "x"))


#: Rows of each user in order, for rules that look back at what they kept.
_ROWS = f"a AS (SELECT event_id, user_id, value, CASE WHEN value > 50 THEN 1 WHEN value > 25 THEN 0 ELSE -1 END AS x, row_number() OVER ({W}) AS rn FROM events)"


@query("replace_repeat_gap", f"""WITH RECURSIVE {_ROWS}, r AS (SELECT user_id, rn, event_id, x, CASE WHEN x = 1 THEN rn END AS kept FROM a WHERE rn = 1
UNION ALL SELECT a.user_id, a.rn, a.event_id, CASE WHEN a.x = 1 AND a.rn - r.kept < 3 THEN 0 ELSE a.x END, CASE WHEN a.x = -1 THEN NULL WHEN a.x = 0 OR a.rn - r.kept < 3 THEN r.kept ELSE a.rn END FROM r JOIN a ON a.user_id = r.user_id AND a.rn = r.rn + 1)
SELECT event_id, x FROM r""")
def replace_gap(spark, d):
    return S.replace_repeat_gap(_signal(spark, d), USER, "x", 1, 0, gap=3).select("event_id", "x")


@query("replace_repeat_func_iter", f"""WITH RECURSIVE {_ROWS}, r AS (SELECT user_id, rn, event_id, value AS v, CASE WHEN value > 50 THEN rn END AS kept FROM a WHERE rn = 1
UNION ALL SELECT a.user_id, a.rn, a.event_id, CASE WHEN a.value > 50 AND a.rn - r.kept < 4 THEN 30 ELSE a.value END, CASE WHEN a.value > 30 AND a.value <= 50 THEN NULL WHEN a.value <= 30 OR a.rn - r.kept < 4 THEN r.kept ELSE a.rn END FROM r JOIN a ON a.user_id = r.user_id AND a.rn = r.rn + 1)
SELECT event_id, v FROM r""")
def replace_gap_by_rule(spark, d):
    """Values over 50 that come less than 4 rows behind one that stays become 30; those from 30 to 50 begin anew."""
    done = S.replace_repeat_gap(events(spark, d), USER, "value", lambda x: x > 50, lambda x: min(x, 30.0), gap=4)
    return done.select("event_id", F.col("value").alias("v"))


@query("replace_repeat_func_pd", f"""WITH a AS (SELECT event_id, value, last_value(CASE WHEN value > 30 THEN value > 50 END IGNORE NULLS) OVER {PRE} AS p FROM events) SELECT event_id, CASE WHEN value > 50 AND p THEN 30 ELSE value END AS v FROM a""")
def replace_by_rule(spark, d):
    low = F.lit(30.0)
    done = S.replace_repeat(events(spark, d), USER, "value", high(), F.least("value", low), F.col("value") <= low)
    return done.select("event_id", F.col("value").alias("v"))


@query("cut_df_by_con_val", f"""
WITH a AS (SELECT *, lag(event_type) OVER ({W}) AS l, row_number() OVER ({W}) AS rn FROM events)
SELECT event_id, CAST(sum(CASE WHEN rn = 1 OR l IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END) OVER {UP} AS BIGINT) AS segment FROM a""")
def segment(spark, d):
    return S.segments(events(spark, d), USER, "event_type").select("event_id", "segment")


@query("get_con_start_end", f"""
WITH a AS (SELECT user_id, ts, event_id, CASE WHEN value > 50 THEN 1 ELSE 0 END AS c, row_number() OVER ({W}) - 1 AS rn FROM events),
b AS (SELECT *, sum(1 - c) OVER {UP} AS g FROM a)
SELECT user_id, min(rn) AS "start", max(rn) AS "end" FROM b WHERE c = 1 GROUP BY user_id, g""")
def bounds(spark, d):
    return S.run_bounds(events(spark, d), USER, high())


for _rev in (False, True):
    query(f"get_first_appear{'_reverse' if _rev else ''}", f"""
WITH a AS (SELECT user_id, value, event_type, row_number() OVER ({W}) - 1 AS rn FROM events)
SELECT user_id, {'max' if _rev else 'min'}_by(value, rn) AS value, {'max' if _rev else 'min'}(rn) AS position FROM a WHERE event_type = 'error' GROUP BY user_id""")(
        lambda spark, d, rev=_rev: S.first_match(events(spark, d), USER, F.col("event_type") == "error", "value", reverse=rev))
    query(f"get_appear_order{'_descending' if _rev else ''}", f"SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts {'DESC' if _rev else ''}, event_id {'DESC' if _rev else ''}) AS nth FROM events")(
        lambda spark, d, rev=_rev: S.appear_order(events(spark, d), USER, "event_type", ascending=not rev).select("event_id", "nth"))


@query("label_rep_index_str", """
WITH a AS (SELECT l_orderkey, l_linenumber, l_returnflag, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN n > 1 THEN l_returnflag || '_' || n ELSE l_returnflag END AS label FROM a""")
def label(spark, d):
    return S.label_repeats(table(spark, d, "lineitem"), LINE, "l_returnflag", "label").select("l_orderkey", "l_linenumber", "label")


for _keep, _cond in (("first", "a = 1"), ("last", "b = 1"), ("none", "n = 1")):
    query(f"drop_index_duplicates_{_keep}", f"""
SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS a, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS b,
count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events) WHERE {_cond}""")(
        lambda spark, d, keep=_keep: S.drop_repeats(events(spark, d), USER, ["event_type"], keep).select("event_id"))


@query("count_values", "SELECT event_id, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events")
def count_values(spark, d):
    return S.count_values(events(spark, d), ["user_id", "event_type"]).select("event_id", "n")


@query("count_index", "SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem")
def count_index(spark, d):
    return S.count_values(table(spark, d, "lineitem"), ["l_orderkey"]).select("l_orderkey", "l_linenumber", "n")


@query("get_all_turns", f"""
WITH a AS (SELECT event_id, user_id, ts, CAST(sign(value - lag(value) OVER ({W})) AS INTEGER) AS s FROM events),
b AS (SELECT *, first_value(CASE WHEN s <> 0 THEN s END IGNORE NULLS) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS n FROM a)
SELECT event_id, CAST(CASE WHEN s IS NULL THEN coalesce(-n, 0) WHEN s <> 0 AND (n IS NULL OR n <> s) THEN s ELSE 0 END AS INTEGER) AS turn FROM b""")
def turn(spark, d):
    return S.turns(events(spark, d), USER, "value").select("event_id", "turn")


@query("filter_by_func_prenext_series", f"""WITH RECURSIVE {_ROWS}, r AS (SELECT user_id, rn, event_id, value AS kept, value AS last FROM a WHERE rn = 1
UNION ALL SELECT a.user_id, a.rn, a.event_id, CASE WHEN a.value >= r.last + 5 THEN a.value END, CASE WHEN a.value >= r.last + 5 THEN a.value ELSE r.last END FROM r JOIN a ON a.user_id = r.user_id AND a.rn = r.rn + 1)
SELECT event_id, kept FROM r""")
def chain(spark, d):
    return S.chain_filter(events(spark, d), USER, "value", lambda a, b: b >= a + 5).select("event_id", "kept")


@query("group_shift", f"SELECT event_id, lag(value, 2) OVER ({W}) AS shifted FROM events")
def shifted(spark, d):
    return S.shift(events(spark, d), USER, "value", 2).select("event_id", "shifted")


_HOLES = "CASE WHEN value > 30 THEN value END"
for _how, _sql in (
        ("ffill", f"last_value(x IGNORE NULLS) OVER {UP}"), ("bfill", f"first_value(x IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"),
        ("both", f"coalesce(last_value(x IGNORE NULLS) OVER {UP}, first_value(x IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"), ("value", "coalesce(x, -1)")):
    query(f"group_fillna_{_how}", f"SELECT event_id, {_sql} AS filled FROM (SELECT *, {_HOLES} AS x FROM events)")(
        lambda spark, d, how=_how: S.fill(events(spark, d).withColumn("x", F.when(F.col("value") > 30, F.col("value"))), USER, "x", how, -1.0, "filled").select("event_id", "filled"))

_RANK = "PARTITION BY l_returnflag, l_quantity IS NULL ORDER BY l_quantity"
for _m, _sql in (("min", f"rank() OVER ({_RANK})"), ("max", f"count(*) OVER ({_RANK} RANGE UNBOUNDED PRECEDING)"), ("dense", f"dense_rank() OVER ({_RANK})"),
                 ("average", f"(rank() OVER ({_RANK}) + count(*) OVER ({_RANK} RANGE UNBOUNDED PRECEDING)) / 2.0"), ("first", f"row_number() OVER ({_RANK}, l_orderkey, l_linenumber, l_partkey, l_suppkey)")):
    query(f"group_rank_{_m}", f"SELECT l_orderkey, l_linenumber, CAST({_sql} AS DOUBLE) AS rank FROM lineitem")(
        lambda spark, d, m=_m: S.group_rank(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", m, tie=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "rank"))


@query("pct_change", f"SELECT event_id, round((value - l) / nullif(abs(l), 0), 6) AS pct FROM (SELECT event_id, value, lag(value) OVER ({W}) AS l FROM events)")
def pct(spark, d):
    return S.pct_change(events(spark, d), USER, "value").select("event_id", F.round("pct", 6).alias("pct"))


@query("rolling_corr", f"SELECT event_id, CASE WHEN count(*) OVER w = 5 THEN round(corr(value, event_id) OVER w, 5) END AS corr FROM events WINDOW w AS ({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def corr(spark, d):
    return S.rolling_corr(events(spark, d), USER, "value", "event_id", 5).select("event_id", F.round("corr", 5).alias("corr"))


@query("groupby_rolling_func", f"SELECT event_id, CASE WHEN count(value) OVER w >= 2 THEN max(value) OVER w END AS rolled FROM events WINDOW w AS ({W} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)")
def rolled(spark, d):
    return S.group_rolling(events(spark, d), USER, "value", 4, F.max, 2).select("event_id", "rolled")
