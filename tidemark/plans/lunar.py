"""Lunar dates, names in the cycle of sixty and solar terms of the orders' dates; SQL from the same series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import lunar as L
from .registry import plain, query, table

FIRST, LAST = 1991, 2002


def _values(rows) -> str:
    return "(VALUES " + ", ".join(f"({', '.join(f'{x:.12f}::DOUBLE' for x in r)})" for r in rows) + ")"


#: Seconds of clock_lag for the years of the orders.
_LAG = "(63.86 + 0.3345 * t - 0.060374 * t * t + 0.0017275 * t * t * t + 0.000651814 * t * t * t * t + 0.00002373599 * t * t * t * t * t)"
_SERIES = f"""WITH tm(c, p, a, b, f) AS {_values(L.MOON_TERMS)}, tp(c, a, b) AS {_values(L.PLANET_TERMS)}, ts(x, a, b) AS {_values(L.SUN_TERMS)}, tn(x, a, b) AS {_values(L.SUN_SHIFTS)},
k0 AS (SELECT range::DOUBLE AS k, range / 1236.85 AS c, 2451550.09766 + 29.530588861 * range + pow(range / 1236.85, 2) * (0.00015437 + range / 1236.85 * (-0.00000015 + 0.00000000073 * range / 1236.85)) AS mean FROM range(-135, 50)),
k1 AS (SELECT *, 1 - 0.002516 * c - 0.0000074 * c * c AS e, 2.5534 + 29.1053567 * k - c * c * (0.0000014 + 0.00000011 * c) AS su, 201.5643 + 385.81693528 * k + c * c * (0.0107582 + 0.00001238 * c) AS mo, 160.7108 + 390.67050284 * k - c * c * (0.0016118 + 0.00000227 * c) AS nd, (mean - 2451545.0) / 365.25 AS t FROM k0),
k2 AS (SELECT k1.k, sum(tm.c * pow(e, p) * sin(radians(a * su + b * mo + f * nd))) AS main FROM k1, tm GROUP BY 1), k3 AS (SELECT k1.k, sum(tp.c * sin(radians(a + b * k1.k))) AS rest FROM k1, tp GROUP BY 1),
nm AS (SELECT k, DATE '2000-01-01' + CAST(floor(mean + main + rest - {_LAG} / 86400 + 8 / 24.0 - 2451544.5) AS INTEGER) AS begin FROM k1 JOIN k2 USING (k) JOIN k3 USING (k)),
dy AS (SELECT DATE '1990-01-01' + CAST(range AS INTEGER) AS day, range - 3652 + 2451544.5 - 8 / 24.0 AS jd FROM range(5000)),
dc AS (SELECT day, (jd - 2451545.0 + {_LAG.replace('t', '((jd - 2451545.0) / 365.25)')} / 86400) / 36525 AS c FROM dy),
d1 AS (SELECT day, c, sum(x * sin(radians(a + b * c))) AS s FROM dc, ts GROUP BY 1, 2), d2 AS (SELECT day, sum(x * sin(radians(a + b * c))) AS s FROM dc, tn GROUP BY 1),
sn AS (SELECT day, v - 360 * floor(v / 360) AS lon FROM (SELECT day, 282.7771834 + 36000.76953744 * c + 0.000005729577951308232 * d1.s - 0.005575 + d2.s AS v FROM d1 JOIN d2 USING (day))),
ms AS (SELECT k, begin, lead(begin) OVER w AS stop, CAST(floor(lon / 30) AS INTEGER) AS sign, CAST(lead(floor(lon / 30)) OVER w AS INTEGER) AS nx FROM nm JOIN sn ON sn.day = nm.begin WINDOW w AS (ORDER BY k)),
mp AS (SELECT *, (nx - sign + 12) % 12 AS passes, (9 - sign + 12) % 12 AS ahead FROM ms WHERE stop IS NOT NULL),
su AS (SELECT *, sum(CASE WHEN ahead > 0 AND ahead <= passes THEN 1 ELSE 0 END) OVER (ORDER BY k) AS sui FROM mp),
pl AS (SELECT *, row_number() OVER (PARTITION BY sui ORDER BY k) - 1 AS ix, count(*) OVER (PARTITION BY sui) AS n, min(year(begin)) OVER (PARTITION BY sui) AS sy FROM su WHERE sui > 0),
sk AS (SELECT *, CASE WHEN n = 13 THEN min(CASE WHEN passes = 0 AND ix > 0 THEN ix END) OVER (PARTITION BY sui) END AS skip FROM pl),
nu AS (SELECT *, ix - CASE WHEN ix >= skip THEN 1 ELSE 0 END AS num FROM sk),
mo AS (SELECT begin, stop, CAST(sy + CASE WHEN num >= 2 THEN 1 ELSE 0 END AS INTEGER) AS ly, CAST((num + 10) % 12 + 1 AS INTEGER) AS lm, coalesce(ix = skip, FALSE) AS leap FROM nu),
lu AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, ly AS lunar_year, lm AS lunar_month, leap, CAST(CAST(o_orderdate AS DATE) - begin + 1 AS INTEGER) AS lunar_day FROM orders ASOF JOIN mo ON CAST(o_orderdate AS DATE) >= mo.begin)"""


def _orders(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"))


def _lunar(spark, d):
    return L.to_lunar(_orders(spark, d), "date", L.lunar_calendar(spark, FIRST, LAST))


@query("gen2lun", _SERIES + " SELECT o_orderkey, lunar_year, lunar_month, leap, lunar_day FROM lu")
def to_lunar(spark, d):
    return _lunar(spark, d).drop("date")


@query("lun2gen", _SERIES + " SELECT o_orderkey, CAST(day AS VARCHAR) AS day FROM lu WHERE NOT leap")
def from_lunar(spark, d):
    """The dates of orders, from their lunar ones."""
    told = _lunar(spark, d).where("NOT leap").drop("date")
    return plain(L.from_lunar(told, L.lunar_calendar(spark, FIRST, LAST)).select("o_orderkey", "day"))


def _cycle(at: str) -> str:
    return f"substr('{D.STEMS}', CAST((({at}) % 10 + 10) % 10 AS INTEGER) + 1, 1) || substr('{D.BRANCHES}', CAST((({at}) % 12 + 12) % 12 AS INTEGER) + 1, 1)"


_PILLARS = f"""pi AS (SELECT o_orderkey, lu.day, lunar_year, CAST(floor((lon - 315 + 360 * CASE WHEN lon < 315 THEN 1 ELSE 0 END) / 30) AS INTEGER) AS m FROM lu JOIN sn ON sn.day = lu.day + 1),
pn AS (SELECT o_orderkey, {_cycle('lunar_year - 1984')} || '[' || substr('{D.ANIMALS}', CAST(((lunar_year - 1984) % 12 + 12) % 12 AS INTEGER) + 1, 1) || ']年,' || {_cycle("(year(day) - CASE WHEN m >= 10 AND month(day) < 3 THEN 1 ELSE 0 END - 1984) * 12 + m + 2")} || '月,' || {_cycle("day - DATE '1949-10-01'")} || '日' AS pillars FROM pi)"""


@query("gen2gz", f"{_SERIES}, {_PILLARS} SELECT o_orderkey, pillars FROM pn")
def pillars(spark, d):
    return _lunar(spark, d).select("o_orderkey", L.pillars(F.col("date"), F.col("lunar_year")).alias("pillars"))


@query("get_wuxing", f"{_SERIES}, {_PILLARS} SELECT o_orderkey, translate(translate(substr(pillars, length(pillars) - 2, 2), '{D.STEMS}', '{L.STEM_ELEMENTS}'), '{D.BRANCHES}', '{L.BRANCH_ELEMENTS}') AS elements FROM pn")
def elements(spark, d):
    """The elements of the day's name."""
    named = _lunar(spark, d).withColumn("p", L.pillars(F.col("date"), F.col("lunar_year")))
    return named.select("o_orderkey", L.elements(F.substring(F.element_at(F.split("p", ","), 3), 1, 2)).alias("elements"))


@query("get_solar_terms", _SERIES + """ SELECT o_orderkey, CAST(CASE WHEN floor(a.lon / 15) <> floor(b.lon / 15) THEN floor(b.lon / 15) END AS INTEGER) AS term
FROM orders JOIN sn a ON a.day = CAST(o_orderdate AS DATE) JOIN sn b ON b.day = CAST(o_orderdate AS DATE) + 1""")
def terms(spark, d):
    return _orders(spark, d).select("o_orderkey", L.term_of(F.col("date")).alias("term"))


_EIGHT = f"""{_PILLARS},
e8 AS (SELECT o_orderkey, pillars || ',' || {_cycle("(CAST(o_orderdate AS DATE) - DATE '1949-10-01') * 12 + (hour(o_orderdate) + 1) // 2")} || '时' AS eight FROM pn JOIN orders USING (o_orderkey))"""


def _eight(date, year, time):
    """The names of year, month, day and two hours."""
    return F.concat(L.pillars(date, year), F.lit(","), D.cycle_hour(time), F.lit("时"))


def _times(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("time"))


@query("get_bazi", f"{_SERIES}, {_EIGHT} SELECT o_orderkey, eight FROM e8")
def eight(spark, d):
    named = _lunar(spark, d).join(_times(spark, d), "o_orderkey")
    return named.select("o_orderkey", _eight(F.col("date"), F.col("lunar_year"), F.col("time")).alias("eight"))


def _from_lunar_times(spark, d):
    """Orders known by their lunar dates, in no leap month, and their time of day."""
    told = _lunar(spark, d).where("NOT leap").drop("date").join(_times(spark, d), "o_orderkey")
    return L.from_lunar(told, L.lunar_calendar(spark, FIRST, LAST)).select("o_orderkey", _eight(F.col("day"), F.col("lunar_year"), F.col("time")).alias("eight"))


@query("get_bazi_lunar", f"{_SERIES}, {_EIGHT} SELECT o_orderkey, eight FROM e8 JOIN lu USING (o_orderkey) WHERE NOT leap")
def eight_from_lunar(spark, d):
    return _from_lunar_times(spark, d)


@query("get_wuxing_lunar", f"{_SERIES}, {_EIGHT} SELECT o_orderkey, array_to_string(list_transform(string_split(eight, ','), lambda x: translate(translate(left(x, 2), '{D.STEMS}', '{L.STEM_ELEMENTS}'), '{D.BRANCHES}', '{L.BRANCH_ELEMENTS}')), ',') AS elements FROM e8 JOIN lu USING (o_orderkey) WHERE NOT leap")
def elements_from_lunar(spark, d):
    return _from_lunar_times(spark, d).select("o_orderkey", F.array_join(F.transform(F.split("eight", ","), lambda x: L.elements(F.substring(x, 1, 2))), ",").alias("elements"))
