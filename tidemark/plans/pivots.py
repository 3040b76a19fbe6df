"""Queries of pivots and of labels found row by row, with recursive SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pivots as P
from ..operators import signals as G
from ..operators.extrema import Limits
from .registry import query
from .series import USER, W, events

UP, DOWN = P.Leg(min_pct=0.5, max_pct=3.0, t_min=2), P.Leg(min_val=25.0, t_max=9)
PLAIN = P.Leg(min_val=30.0)


def _size(a: str, b: str, share: bool) -> str:
    return f"(CASE WHEN {a} = 0 THEN sign({b}) ELSE ({b} - ({a})) / abs({a}) END)" if share else f"({b} - ({a}))"


def _sure(leg: P.Leg, least: str, most: str, rows: str) -> str:
    late = "TRUE" if leg.t_min is None else f"{rows} > {leg.t_min}"
    out = [f"({late} AND {least} >= {leg.min_val if leg.min_pct is None else leg.min_pct})"]
    if leg.t_max < float("inf"):
        out.append(f"{rows} >= {leg.t_max}")
    top = leg.max_val if leg.max_pct is None else leg.max_pct
    if top is not None:
        out.append(f"({'TRUE' if leg.t_min is None else f'{rows} <= {leg.t_min}'} AND {most} >= {top})")
    return f"({' OR '.join(out)})"


def _by_kind(use) -> str:
    """A value for a search of a high (kind -1) and of a low, which goes over the mirrored series with the legs exchanged."""
    return lambda up, down: f"CASE WHEN kind = -1 THEN {use(up, down)} ELSE {use(down, up)} END"


def _walk(name: str, rows: str, starts: str, up: P.Leg, down: P.Leg) -> str:
    """A recursive table of the search: each step looks at row k, or at the end of the series; ``label`` is what it finds."""
    pick = lambda use: _by_kind(use)(up, down)
    least = lambda a, b, leg: _size(a, b, leg.min_pct is not None)
    most = lambda a, b, leg: _size(a, b, leg.max_pct is not None)
    return f"""
{name}(u, n, kind, a, v0, k, top, peak, rl, rm, rr, fl, fm, fr, spot, label) AS (
  SELECT u, n, kind, a, v0, a + 2, a + 1, -1e308::DOUBLE, -1e308::DOUBLE, -1e308::DOUBLE, 0::BIGINT, -1e308::DOUBLE, -1e308::DOUBLE, 0::BIGINT, NULL::BIGINT, NULL::DOUBLE FROM {starts}
  UNION ALL
  SELECT u, n, CASE WHEN found THEN -kind ELSE kind END, CASE WHEN found THEN spot ELSE a END, CASE WHEN found THEN CASE WHEN kind = -1 THEN -sh ELSE sl END ELSE v0 END,
    CASE WHEN found THEN spot + 2 WHEN over THEN n + 9 ELSE k + 1 END, CASE WHEN found THEN spot + 1 ELSE top END, CASE WHEN found THEN -1e308 ELSE peak END, CASE WHEN found THEN -1e308 ELSE rl END,
    CASE WHEN found THEN -1e308 ELSE rm END, CASE WHEN found THEN 0 ELSE rr END, CASE WHEN found THEN -1e308 ELSE fl END, CASE WHEN found THEN -1e308 ELSE fm END, CASE WHEN found THEN 0 ELSE fr END,
    CASE WHEN found OR half THEN spot END, CASE WHEN found THEN -kind WHEN half THEN -kind * 0.5 END
  FROM (SELECT e.*, s.h AS sh, s.l AS sl FROM (
    SELECT *, through OR (CASE WHEN over THEN ers AND efs ELSE rs AND fs END) AS found, NOT through AND over AND ers AND NOT efs AS half, CASE WHEN through THEN tspot WHEN over AND last THEN n - 1 ELSE top END AS spot FROM (
    SELECT *, CASE WHEN last THEN {pick(lambda g, b: _sure(g, least('v0', 'hk', g), most('v0', 'hk', g), '(n - 1 - a)'))} ELSE rs END AS ers, CASE WHEN last THEN {pick(lambda g, b: _sure(b, '0', '0', '0'))} ELSE fs END AS efs FROM (
    SELECT *, {pick(lambda g, b: _sure(g, 'rl', 'rm', 'rr'))} AS rs, {pick(lambda g, b: _sure(b, 'fl', 'fm', 'fr'))} AS fs, k >= n - 1 AS over, hk > peak AND k >= n - 1 AS last FROM (
    SELECT u, n, kind, a, v0, k, hk, through, tspot, top, peak, rl, rm, rr, CASE WHEN deeper THEN fn ELSE fl END AS fl, CASE WHEN deeper THEN fx ELSE fm END AS fm, CASE WHEN deeper THEN k - top ELSE fr END AS fr FROM (
    SELECT *, k < n AND fn > fl AS deeper FROM (
    SELECT *, {pick(lambda g, b: least('-peak', '-lk', b))} AS fn, {pick(lambda g, b: most('-peak', '-lk', b))} AS fx FROM (
    SELECT u, n, kind, a, v0, k, hk, lk, through, tspot, fm, fr, CASE WHEN up THEN k - 1 ELSE top END AS top, CASE WHEN up THEN hp ELSE peak END AS peak, CASE WHEN up THEN {pick(lambda g, b: least('v0', 'hp', g))} ELSE rl END AS rl,
      CASE WHEN up THEN {pick(lambda g, b: most('v0', 'hp', g))} ELSE rm END AS rm, CASE WHEN up THEN k - 1 - a ELSE rr END AS rr, CASE WHEN up THEN -1e308 ELSE fl END AS fl FROM (
    SELECT *, k < n AND lk < v0 AS through, k < n AND hp > peak AS up, CASE WHEN hk > greatest(hp, peak) THEN k WHEN hp > peak THEN k - 1 ELSE top END AS tspot FROM (
    SELECT w.*, CASE WHEN kind = -1 THEN r.h ELSE -r.l END AS hk, CASE WHEN kind = -1 THEN r.l ELSE -r.h END AS lk, CASE WHEN kind = -1 THEN r.ph ELSE -r.pl END AS hp
    FROM {name} w JOIN {rows} r ON r.u = w.u AND r.i = least(w.k, w.n - 1) WHERE w.k <= w.n))))))))
  ) e JOIN {rows} s ON s.u = e.u AND s.i = CASE WHEN e.spot < e.n THEN e.spot ELSE e.n - 1 END))"""


def zigzag_sql(low: str, up: P.Leg, down: P.Leg) -> str:
    return f"""WITH RECURSIVE
s AS (SELECT event_id, user_id AS u, row_number() OVER ({W}) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n, value AS h, {low} AS l, lag(value) OVER ({W}) AS ph, lag({low}) OVER ({W}) AS pl FROM events),
x AS (SELECT u, max(n) AS n, arg_max(i, (h, -i)) AS top, arg_min(i, (l, i)) AS bottom FROM s GROUP BY u),
c AS (SELECT u, greatest(top, bottom) AS z, CASE WHEN top > bottom THEN 1 ELSE -1 END AS kind FROM x),
b AS (SELECT u, z - i AS i, z + 1 AS n, h, l, lead(h) OVER (PARTITION BY u ORDER BY i) AS ph, lead(l) OVER (PARTITION BY u ORDER BY i) AS pl FROM s JOIN c USING (u) WHERE i <= z),
b0 AS (SELECT u, n, c.kind, 0::BIGINT AS a, CASE WHEN c.kind = -1 THEN l ELSE -h END AS v0 FROM b JOIN c USING (u) WHERE i = 0),
{_walk("back", "b", "b0", up, down)},
f AS (SELECT u, z - max(spot) AS a, arg_max(label, spot) AS kind FROM back JOIN c USING (u) WHERE abs(label) = 1 GROUP BY u, z),
f0 AS (SELECT u, n, f.kind::INT AS kind, a, CASE WHEN f.kind = -1 THEN l ELSE -h END AS v0 FROM s JOIN f USING (u) WHERE i = a),
{_walk("forth", "s", "f0", up, down)},
m AS (SELECT u, z - spot AS i, label FROM back JOIN c USING (u) JOIN f USING (u) WHERE label IS NOT NULL AND z - spot <= f.a UNION ALL SELECT u, spot, label FROM forth WHERE label IS NOT NULL)
SELECT event_id, coalesce(label, 0.0)::DOUBLE AS zigzag FROM s LEFT JOIN m USING (u, i)"""


def _low(spark, d):
    return events(spark, d).withColumn("low", F.col("value") * 0.9)


@query("zigzag", zigzag_sql("value * 0.9", PLAIN, PLAIN))
def zigzag(spark, d):
    return P.zigzag(_low(spark, d), USER, "value", "low", PLAIN).select("event_id", "zigzag")


@query("zigzag_limits", zigzag_sql("value * 0.9", UP, DOWN))
def zigzag_limits(spark, d):
    return P.zigzag(_low(spark, d), USER, "value", "low", UP, DOWN).select("event_id", "zigzag")


@query("zigzag_resumed", zigzag_sql("value * 0.9", PLAIN, PLAIN))
def zigzag_resumed(spark, d):
    """The labels of each user's first two thirds of rows, resumed when the rest has come: the same as in one pass."""
    rows = _low(spark, d).withColumns({"rn": USER.row(), "n": F.count(F.lit(1)).over(USER.whole())})
    early = P.zigzag(rows.where("rn * 3 <= n * 2"), USER, "value", "low", PLAIN)
    came = rows.where("rn * 3 > n * 2").withColumn("zigzag", F.lit(None).cast("double"))
    return P.zigzag(early.unionByName(came), USER, "value", "low", PLAIN, label="zigzag").select("event_id", "zigzag")


@query("find_maxmin_dy")
def signals(spark, d):
    """Troughs and peaks as they are called: at least 5 away, or a tenth of the value with the last opposite one 20 away."""
    rules = G.Rules(Limits(t_min=2), G.Called(dif=(5.0, 90.0), pct=None), G.Called(pct=(0.1, 9.0), other_dif=20.0), start=6)
    return G.call(events(spark, d), USER, "value", rules).select("event_id", "signal", "signal_kind")
