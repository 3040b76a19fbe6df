"""Date queries over order dates, and the working-day calendar."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..functions import dates as D
from .registry import plain, query, table

S = "CAST(o_orderdate AS DATE)"


def O():  # noqa: E743
    return F.to_date("o_orderdate")


def orders(spark, d):
    return table(spark, d, "orders")


def _date(name, col, sql):
    query(name, f"SELECT o_orderkey, CAST({sql} AS VARCHAR) AS y FROM orders")(lambda spark, d: orders(spark, d).select("o_orderkey", col().cast("string").alias("y")))


_T = "o_orderdate"
_QS = f"CAST(date_trunc('quarter', {S}) AS DATE)"
_MS = f"CAST(date_trunc('month', {S}) AS DATE)"
for _name, _col, _sql in (
        ("pd_str2datetime", lambda: D.parse(F.date_format(_T, "yyyyMMdd")), f"CAST({S} AS TIMESTAMP)"),
        ("str2datetime", lambda: D.parse(F.date_format(_T, "yyyy/MM/dd HH:mm:ss")), "date_trunc('second', o_orderdate)"),
        ("x2datetime", lambda: D.from_epoch(F.unix_millis(F.col(_T).cast("timestamp"))), "date_trunc('millisecond', o_orderdate)"),
        ("str2timestamp", lambda: D.to_epoch(D.parse(F.date_format(_T, "yyyy-MM-dd HH:mm:ss"))).cast("long"), "CAST(epoch(date_trunc('second', o_orderdate)) AS BIGINT)"),
        ("timestamp2str", lambda: F.date_format(D.from_epoch(F.unix_seconds(F.col(_T).cast("timestamp"))), "yyyy-MM-dd HH:mm:ss"), "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')"),
        ("datetime2str", lambda: D.text(F.col(_T)), "strftime(o_orderdate, '%Y-%m-%d')"), ("dtseries2str", lambda: D.text(F.col(_T), "."), "strftime(o_orderdate, '%Y.%m.%d')"),
        ("get_datetime_strformat", lambda: D.date_format_of(F.date_format(_T, "yyyy.MM.dd HH:mm")), "'yyyy.MM.dd HH:mm'"),
        ("time_add", lambda: D.add(F.col(_T), seconds=5, minutes=4, hours=3, days=2), "o_orderdate + INTERVAL 2 DAY + INTERVAL 3 HOUR + INTERVAL 4 MINUTE + INTERVAL 5 SECOND"),
        ("date_add_nday", lambda: F.date_add(O(), 17), f"{S} + 17"), ("is_month_end", lambda: O() == F.last_day(O()), f"{S} = last_day({S})"), ("is_month_start", lambda: F.dayofmonth(O()) == 1, f"day({S}) = 1"),
        ("is_quarter_end", lambda: O() == D.quarter_end(O()), f"{S} = CAST({_QS} + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE)"), ("is_quarter_start", lambda: O() == D.quarter_start(O()), f"{S} = {_QS}"),
        ("get_quarter", lambda: D.quarter_name(O()), f"year({S}) || 'Q' || quarter({S})"),
        ("get_quarter_start_end_by_date", lambda: F.concat_ws("/", D.quarter_start(O()), D.quarter_end(O())), f"{_QS} || '/' || CAST({_QS} + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE)"),
        ("get_quarter_start_end_by_yq", lambda: D.quarter_end(F.make_date(F.year(O()), F.quarter(O()) * 3 - 2, F.lit(1))), f"CAST({_QS} + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE)"),
        ("get_pre_quarter", lambda: D.quarter_name(F.add_months(O(), -6)), f"year({S} - INTERVAL 6 MONTH) || 'Q' || quarter({S} - INTERVAL 6 MONTH)"),
        ("get_2part_next", lambda: F.concat_ws("-", *D.carry(F.year(O()), F.month(O()), 12, -8)), f"year({_MS} - INTERVAL 8 MONTH) || '-' || month({_MS} - INTERVAL 8 MONTH)"),
        ("get_dayofweek", lambda: D.day_of_week(O()), f"CAST(isodow({S}) AS INTEGER)"), ("get_dayofyear", lambda: F.dayofyear(O()), f"CAST(dayofyear({S}) AS INTEGER)"), ("get_month_end", lambda: D.month_end(O()), f"last_day({S})"),
        ("get_next_nmonth_start_end", lambda: F.concat_ws("/", D.month_start(O(), 2), D.month_end(O(), 2)), f"CAST({_MS} + INTERVAL 2 MONTH AS DATE) || '/' || last_day(CAST({_MS} + INTERVAL 2 MONTH AS DATE))"),
        ("get_next_nquarter_start_end", lambda: F.concat_ws("/", D.quarter_start(O(), 1), D.quarter_end(O(), 1)), f"CAST({_QS} + INTERVAL 3 MONTH AS DATE) || '/' || CAST({_QS} + INTERVAL 6 MONTH - INTERVAL 1 DAY AS DATE)"),
        ("date_reformat", lambda: D.reformat(F.date_format(_T, "yyyyMMdd"), "/"), "strftime(o_orderdate, '%Y/%m/%d')"), ("date_reformat_chn", lambda: D.reformat(F.date_format(_T, "yyyy年MM月dd日")), "strftime(o_orderdate, '%Y-%m-%d')"),
        ("date8_to_date10", lambda: D.date8_to_10(F.date_format(_T, "yyyyMMdd")), "strftime(o_orderdate, '%Y-%m-%d')"), ("date10_to_date8", lambda: D.date10_to_8(D.text(F.col(_T))), "strftime(o_orderdate, '%Y%m%d')"),
        ("diff_time_second", lambda: F.timestamp_diff("SECOND", F.lit("1990-01-01").cast("timestamp"), F.col(_T).cast("timestamp")), "CAST(floor(epoch(o_orderdate) - epoch(TIMESTAMP '1990-01-01')) AS BIGINT)"),
        ("diff_days_date", lambda: F.datediff(O(), F.lit("1990-01-01").cast("date")), f"CAST(datediff('day', DATE '1990-01-01', {S}) AS INTEGER)"),
        ("get_date_weekday", lambda: D.weekday_date(O(), 3, -1), f"CAST(date_trunc('week', {S}) AS DATE) - 5"),
        ("get_recent_inweekday", lambda: D.onto_weekday(O()), f"{S} + CASE isodow({S}) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END"), ("get_recent_inweekday_pre", lambda: D.onto_weekday(O(), False), f"{S} - CASE isodow({S}) WHEN 6 THEN 1 WHEN 7 THEN 2 ELSE 0 END"),
        ("get_tgdz_year", lambda: D.cycle_year(F.year(O())), f"substr('甲乙丙丁戊己庚辛壬癸', CAST((year({S}) + 6) % 10 + 1 AS BIGINT), 1) || substr('子丑寅卯辰巳午未申酉戌亥', CAST((year({S}) + 8) % 12 + 1 AS BIGINT), 1)"),
        ("get_tgdz_date", lambda: D.cycle_day(O()), f"substr('甲乙丙丁戊己庚辛壬癸', CAST(datediff('day', DATE '1949-10-01', {S}) % 10 + 1 AS BIGINT), 1) || substr('子丑寅卯辰巳午未申酉戌亥', CAST(datediff('day', DATE '1949-10-01', {S}) % 12 + 1 AS BIGINT), 1)"),
        ("get_shuxiang", lambda: D.animal(F.year(O())), f"substr('鼠牛虎兔龙蛇马羊猴鸡狗猪', CAST((year({S}) + 8) % 12 + 1 AS BIGINT), 1)")):
    _date(_name, _col, _sql)

_BASE = f"({S} - CASE isodow({S}) WHEN 6 THEN 1 WHEN 7 THEN 2 ELSE 0 END)"
_date("get_next_nth_inweekday", lambda: D.nth_weekday_day(O(), 7), f"CAST({_BASE} + CAST(((isodow({_BASE}) - 1 + 7) // 5) * 7 + (isodow({_BASE}) - 1 + 7) % 5 - (isodow({_BASE}) - 1) AS INTEGER) AS DATE)")
_date("get_xingzuo", lambda: D.western_sign(O()), f"['Capricorn', 'Aquarius', 'Pisces', 'Aries', 'Taurus', 'Gemini', 'Cancer', 'Leo', 'Virgo', 'Libra', 'Scorpio', 'Sagittarius'][(month({S}) - 1 + CASE WHEN day({S}) > [19, 18, 20, 19, 20, 21, 22, 22, 22, 23, 22, 21][month({S})] THEN 1 ELSE 0 END) % 12 + 1]")
_HOURS = f"(datediff('day', DATE '1949-10-01', {S}) * 12 + (hour(o_orderdate) + 1) // 2)"
_date("get_tgdz_hour", lambda: D.cycle_hour(F.col(_T)), f"substr('甲乙丙丁戊己庚辛壬癸', CAST({_HOURS} % 10 + 1 AS BIGINT), 1) || substr('子丑寅卯辰巳午未申酉戌亥', CAST({_HOURS} % 12 + 1 AS BIGINT), 1)")


@query("cut_date", f"SELECT o_orderkey, CAST(b AS VARCHAR) AS begin, CAST(least(b + 9, e) AS VARCHAR) AS \"end\" FROM (SELECT o_orderkey, unnest(generate_series({S}, {S} + 25, INTERVAL 10 DAY))::DATE AS b, {S} + 25 AS e FROM orders)")
def cut(spark, d):
    return plain(orders(spark, d).select("o_orderkey", F.explode(D.chunks(O(), F.date_add(O(), 25), 10)).alias("c")).select("o_orderkey", "c.begin", "c.end"))


@query("get_dates_between", f"SELECT o_orderkey, CAST(x AS VARCHAR) AS day FROM (SELECT o_orderkey, unnest(generate_series({S}, {S} + 9, INTERVAL 1 DAY))::DATE AS x, row_number() OVER (PARTITION BY o_orderkey) AS k FROM orders) WHERE isodow(x) < 6 QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY x) > 1")
def between(spark, d):
    return plain(orders(spark, d).select("o_orderkey", F.explode(D.between(O(), F.date_add(O(), 9), weekdays=True)).alias("day")))


#: Off: the first day of each month, if a weekday; worked: the second Saturday of each January.
_NUM = """cal AS (SELECT day, (isodow(day) = 6 AND month(day) = 1 AND day(day) BETWEEN 8 AND 14) OR (isodow(day) < 6 AND day(day) > 1) AS is_workday, CASE WHEN day(day) = 1 THEN 'first' END AS name FROM days),
num AS (SELECT *, CAST(sum(CASE WHEN is_workday THEN 1 ELSE 0 END) OVER (ORDER BY day) AS BIGINT) AS ordinal FROM cal)"""
#: The same calendar over the time of the orders, with a margin.
_WIDE = f"WITH lim AS (SELECT min({S}) AS a, max({S}) AS b FROM orders), days AS (SELECT CAST(unnest(generate_series(a - 60, b + 60, INTERVAL 1 DAY)) AS DATE) AS day FROM lim), {_NUM}"


def _calendar(spark, begin=datetime.date(1992, 1, 1), end=datetime.date(2000, 12, 31)):
    days = spark.range((end - begin).days + 1).select(F.date_add(F.lit(begin), F.col("id").cast("int")).alias("day"))
    off = days.where("day(day) = 1").withColumn("name", F.lit("first"))
    worked = days.where("weekday(day) = 5 AND month(day) = 1 AND day(day) BETWEEN 8 AND 14")
    return D.calendar(spark, begin, end, off, worked)


def _shifted(spark, d, n, forth):
    """Each order date and its working day, by a calendar of the orders' time and a margin on both sides."""
    dates = orders(spark, d).select(O().alias("day")).distinct()
    begin, end = dates.agg(F.min("day"), F.max("day")).first()
    margin = datetime.timedelta(days=31 + 2 * abs(n))
    cal = _calendar(spark, begin - margin, end + margin) if begin else _calendar(spark)
    return plain(D.shift_workdays(dates, "day", cal, n, forth=forth))


for _name, _n, _forth, _sql in (
        ("get_recent_workday", 0, True, "(SELECT min(day) FROM num WHERE is_workday AND day >= o)"), ("get_recent_workday_pre", 0, False, "(SELECT max(day) FROM num WHERE is_workday AND day <= o)"),
        ("get_next_nth_workday", 5, True, "(SELECT day FROM num w WHERE is_workday AND w.ordinal = (SELECT ordinal FROM num WHERE day = o) + 5)"),
        ("get_next_nth_workday_back", -3, True, "(SELECT day FROM num w WHERE is_workday AND w.ordinal = (SELECT ordinal + CASE WHEN is_workday THEN 0 ELSE 1 END FROM num WHERE day = o) - 3)")):
    query(_name, _WIDE + f", o AS (SELECT DISTINCT {S} AS o FROM orders) SELECT CAST(o AS VARCHAR) AS day, CAST({_sql} AS VARCHAR) AS workday FROM o")(
        lambda spark, d, n=_n, forth=_forth: _shifted(spark, d, n, forth))


#: Trading days: weekdays worked since the market opened.
_OPEN = datetime.date(1993, 6, 1)
_TRADE = _WIDE.replace("num AS (SELECT *, CAST(sum(CASE WHEN is_workday", "trade AS (SELECT day, is_workday AND isodow(day) < 6 AND day >= DATE '1993-06-01' AS is_workday, name FROM cal),\nnum AS (SELECT *, CAST(sum(CASE WHEN is_workday").replace("AS ordinal FROM cal)", "AS ordinal FROM trade)")


def _order_days(spark, d):
    """(distinct order dates, a calendar of their time with a margin)."""
    dates = orders(spark, d).select(O().alias("day")).distinct()
    begin, end = dates.agg(F.min("day"), F.max("day")).first()
    margin = datetime.timedelta(days=60)
    return dates, _calendar(spark, begin - margin, end + margin) if begin else _calendar(spark)


def _on_calendar(name, sql, make):
    """A query of each order and its day in the calendar of the orders' time."""

    def run(spark, d):
        begin, end = orders(spark, d).agg(F.min(O()), F.max(O())).first()
        margin = datetime.timedelta(days=60)
        cal = F.broadcast(_calendar(spark, begin - margin, end + margin) if begin else _calendar(spark))  # one row a day
        return plain(make(orders(spark, d).select("o_orderkey", O().alias("o")), cal))

    query(name, f"{_WIDE}, o AS (SELECT o_orderkey, {S} AS o FROM orders) {sql}")(run)


def _here(*cols):
    return lambda x, cal: x.join(cal, F.col("o") == F.col("day")).selectExpr("o_orderkey", *cols)


def _ahead(days: int, worked: bool):
    def make(x, cal):
        each = x.select("o_orderkey", F.explode(F.sequence("o", F.date_add("o", days))).alias("day"))
        return each.join(cal.where(F.col("is_workday") == worked).select("day"), "day").select("o_orderkey", "day")

    return make


_OFF = "NOT is_workday AS off"
_on_calendar("is_workday", "SELECT o_orderkey, is_workday, name, ordinal - (SELECT ordinal FROM num WHERE day = (SELECT min(o) FROM o)) AS place FROM o JOIN num ON o = day",
             lambda x, cal: x.join(cal, F.col("o") == F.col("day")).select("o_orderkey", "is_workday", "name", (F.col("ordinal") - cal.where(F.col("day") == x.agg(F.min("o")).first()[0]).first()["ordinal"]).alias("place")))
_on_calendar("is_holiday", "SELECT o_orderkey, NOT is_workday AS off FROM o JOIN num ON o = day", _here(_OFF))
_on_calendar("get_holiday_detail", "SELECT o_orderkey, NOT is_workday AS off, name FROM o JOIN num ON o = day", _here(_OFF, "name"))
_on_calendar("is_in_lieu", "SELECT o_orderkey, name IS NOT NULL AND isodow(day) = 1 AS in_lieu FROM o JOIN num ON o = day", _here("name IS NOT NULL AND weekday(day) = 0 AS in_lieu"))
_on_calendar("get_holidays", "SELECT o_orderkey, CAST(day AS VARCHAR) AS day FROM o JOIN num ON day BETWEEN o AND o + 7 WHERE NOT is_workday", _ahead(7, False))
_on_calendar("get_workdays", "SELECT o_orderkey, CAST(day AS VARCHAR) AS day FROM o JOIN num ON day BETWEEN o AND o + 4 WHERE is_workday", _ahead(4, True))
_on_calendar("get_work_dates", "SELECT CAST(day AS VARCHAR) AS day, count(o_orderkey) AS orders FROM num LEFT JOIN o ON o = day WHERE is_workday AND day BETWEEN (SELECT min(o) FROM o) AND (SELECT max(o) FROM o) GROUP BY day",
             lambda x, cal: _worked(x, cal).groupBy("day").agg(F.count("o_orderkey").alias("orders")))
_on_calendar("get_work_dates_chncal", "SELECT CAST(date_trunc('month', day) AS DATE)::VARCHAR AS month, count(DISTINCT day) AS days, count(o_orderkey) AS orders FROM num LEFT JOIN o ON o = day WHERE is_workday AND day BETWEEN (SELECT min(o) FROM o) AND (SELECT max(o) FROM o) GROUP BY 1",
             lambda x, cal: _worked(x, cal).groupBy(F.trunc("day", "month").alias("month")).agg(F.count_distinct("day").alias("days"), F.count("o_orderkey").alias("orders")))


def _worked(x, cal):
    """The working days of the orders' time, with their orders."""
    begin, end = x.agg(F.min("o"), F.max("o")).first()
    return cal.where("is_workday").where(F.col("day").between(begin, end)).select("day").join(x, F.col("o") == F.col("day"), "left")


def _moved(name, sql, cal_sql, move, trading=False):
    def run(spark, d):
        dates, cal = _order_days(spark, d)
        return plain(move(dates, D.trading_calendar(cal, _OPEN) if trading else cal))

    query(name, cal_sql + f", o AS (SELECT DISTINCT {S} AS o FROM orders) SELECT CAST(o AS VARCHAR) AS day, {sql} FROM o")(run)


_NEXT = "CAST((SELECT min(day) FROM num WHERE is_workday AND day >= o) AS VARCHAR) AS workday"
_moved("find_workday", "CAST((SELECT day FROM num w WHERE is_workday AND w.ordinal = (SELECT ordinal + CASE WHEN is_workday THEN 0 ELSE 1 END FROM num WHERE day = o) + 2) AS VARCHAR) AS workday", _WIDE, lambda x, cal: D.find_workday(x, "day", cal, 2))
_moved("get_recent_workday_chncal", _NEXT, _WIDE, lambda x, cal: D.onto_workday(x, "day", cal))
_moved("get_next_nth_workday_chncal", "CAST((SELECT day FROM num w WHERE is_workday AND w.ordinal = (SELECT ordinal FROM num WHERE day = o) + 9) AS VARCHAR) AS workday", _WIDE, lambda x, cal: D.shift_workdays(x, "day", cal, 9))
_moved("is_tradeday", "(SELECT is_workday FROM num WHERE day = o) AS trading", _TRADE, lambda x, cal: x.join(F.broadcast(cal), "day").select("day", F.col("is_workday").alias("trading")), True)
_moved("get_recent_tradeday", _NEXT, _TRADE, lambda x, cal: D.onto_workday(x, "day", cal), True)
_moved("get_next_nth_tradeday", "CAST((SELECT day FROM num w WHERE is_workday AND w.ordinal = (SELECT ordinal FROM num WHERE day = o) + 3) AS VARCHAR) AS workday", _TRADE, lambda x, cal: D.shift_workdays(x, "day", cal, 3), True)


@query("get_trade_dates", _TRADE + " SELECT CAST(day AS VARCHAR) AS day FROM num WHERE is_workday AND day BETWEEN DATE '1993-01-01' AND DATE '1995-12-31'")
def trading_days(spark, d):
    cal = D.trading_calendar(_order_days(spark, d)[1], _OPEN)
    return plain(cal.where("is_workday AND day BETWEEN DATE '1993-01-01' AND DATE '1995-12-31'").select("day"))


@query("get_dates", f"SELECT o_orderkey, CAST(unnest(generate_series({S}, {S} + 6, INTERVAL 1 DAY))::DATE AS VARCHAR) AS day FROM orders")
def all_days(spark, d):
    return plain(orders(spark, d).select("o_orderkey", F.explode(D.between(O(), F.date_add(O(), 6), keep_a=True)).alias("day")))


for _name, _col, _sql in (
        ("get_date_format", lambda: F.concat_ws("|", D.joiner_of(F.date_format(_T, "yyyy/MM/dd"))["size"], D.joiner_of(F.date_format(_T, "yyyy/MM/dd"))["joiner"], D.joiner_of(F.date_format(_T, "yyyyMMdd"))["size"]), "'10|/|8'"),
        ("date_reformat_simple", lambda: D.rejoin(F.concat_ws(".", F.year(_T), F.month(_T), F.dayofmonth(_T)), ".", "/"), "strftime(o_orderdate, '%Y/%m/%d')"),
        ("is_datetime", lambda: D.is_date(F.when(F.col("o_orderkey") % 3 == 0, "no date").otherwise(F.date_format(_T, "yyyy-MM-dd HH:mm:ss"))), "CASE WHEN o_orderkey % 3 = 0 THEN 'false' ELSE 'true' END"),
        ("get_datetime_format", lambda: F.concat_ws("|", D.kind_of(F.date_format(_T, "yyyyMMdd")), D.kind_of(F.lit("1600000000"))), "'yyyyMMdd|timestamp'"),
        ("copy_format", lambda: D.written_like(F.col(_T), F.lit("2001.02.03 04:05")), "strftime(o_orderdate, '%Y.%m.%d %H:%M')"),
        ("copy_format0", lambda: D.written_like(F.col(_T), F.lit("20010203")), "strftime(o_orderdate, '%Y%m%d')")):
    _date(_name, _col, _sql)


@query("datetime_now", "SELECT TRUE AS good")
def now(spark, d):
    """The parts of the time now agree with each other."""
    parts = spark.range(1).select(*[c.alias(n) for n, c in D.now_parts().items()])
    return parts.select((F.col("now").startswith(F.col("date")) & (F.replace(F.substring("date", 1, 7), F.lit("-"), F.lit("")) == F.col("month")) & F.col("quarter").rlike(r"^\d{4}Q[1-4]$")).alias("good"))


for _name, _part, _size in (("today_date", "date", 10), ("today_month", "month", 6), ("today_quarter", "quarter", 6)):
    query(_name, f"SELECT {_size} AS size")(lambda spark, d, p=_part: spark.range(1).select(F.length(D.now_parts()[p]).alias("size")))


@query("get_age_by_shuxiang", """WITH c AS (SELECT c_custkey, substr('鼠牛虎兔龙蛇马羊猴鸡狗猪', CAST(c_custkey % 12 + 1 AS BIGINT), 1) AS sign FROM customer), y AS (SELECT CAST(y AS INTEGER) AS year, substr('鼠牛虎兔龙蛇马羊猴鸡狗猪', CAST((y + 8) % 12 + 1 AS BIGINT), 1) AS sign FROM range(1987, 2023) t(y))
SELECT c_custkey, year, 2022 - year AS age FROM c JOIN y USING (sign)""")
def ages(spark, d):
    """The three latest years up to 2022 of a sign of each customer."""
    sign = F.substring(F.lit(D.ANIMALS), (F.col("c_custkey") % 12).cast("int") + 1, F.lit(1))
    rows = table(spark, d, "customer").select("c_custkey", F.explode(D.years_of_animal(sign, 2022, 3)).alias("year"))
    return rows.select("c_custkey", F.col("year").cast("int").alias("year"), (2022 - F.col("year")).cast("int").alias("age"))
