"""Date and time functions as Columns, and the calendar dimension for working days.

Text dates are read by a ladder of formats.  Working days come from a calendar table (one row a day) that is made from
a rule (weekdays) and a table of exceptions: days off on weekdays, and weekend days worked.
"""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FORMATS = tuple(f"yyyy{a}MM{a}dd{t}" for a in ("-", "", "/", ".") for t in ("", " HH:mm:ss", " HH:mm:ss.SSSSSS", "'T'HH:mm:ss", " HH:mm", " HHmmss")) + ("yyyyMMddHHmmss",)


def parse(x: Column, formats: tuple[str, ...] = FORMATS) -> Column:
    """Text or number yyyymmdd (never seconds) to a timestamp; null if no format fits."""
    return F.coalesce(*[F.try_to_timestamp(x.cast("string"), F.lit(f)) for f in formats])


def date_format_of(x: Column) -> Column:
    """The format of a text date from the ladder that reads it."""
    s = x.cast("string")
    shape = F.regexp_replace(s, r"\d", "0")
    return reduce(lambda a, f: F.when((shape == f.replace("'", "").translate(str.maketrans("yMdHmsS", "0000000"))) & F.try_to_timestamp(s, F.lit(f)).isNotNull(), f).otherwise(a), reversed(FORMATS), F.lit(None).cast("string"))


def from_epoch(x: Column) -> Column:
    """Seconds, milli-, micro- or nanoseconds (10, 13, 16 or 19 digits) to a timestamp."""
    n = F.length(F.abs(x.cast("long")).cast("string"))
    return F.when(n <= 11, F.timestamp_seconds(x)).when(n <= 14, F.timestamp_millis(x.cast("long"))).when(n <= 17, F.timestamp_micros(x.cast("long"))).otherwise(F.timestamp_micros((x / 1000).cast("long")))


def to_epoch(t: Column) -> Column:
    return F.unix_micros(t) / 1000000


def text(t: Column, joiner: str = "-") -> Column:
    return F.date_format(t, f"yyyy{joiner}MM{joiner}dd")


def add(t: Column, seconds: float = 0, minutes: int = 0, hours: int = 0, days: int = 0) -> Column:
    return t + F.make_dt_interval(F.lit(days), F.lit(hours), F.lit(minutes), F.lit(seconds).cast("decimal(18,6)"))


def day_of_week(d: Column) -> Column:
    """1 is Monday."""
    return F.weekday(d) + 1


def quarter_name(d: Column, joiner: str = "Q") -> Column:
    return F.concat(F.year(d).cast("string"), F.lit(joiner), F.quarter(d).cast("string"))


def quarter_start(d: Column, ahead: int = 0) -> Column:
    return F.add_months(F.trunc(d, "quarter"), 3 * ahead)


def quarter_end(d: Column, ahead: int = 0) -> Column:
    return F.last_day(F.add_months(F.trunc(d, "quarter"), 3 * ahead + 2))


def month_start(d: Column, ahead: int = 0) -> Column:
    return F.add_months(F.trunc(d, "month"), ahead)


def month_end(d: Column, ahead: int = 0) -> Column:
    return F.last_day(month_start(d, ahead))


def carry(part1: Column, part2: Column, step: int, n: int = 1) -> tuple[Column, Column]:
    """(year, unit) ``n`` units on, with units 1..step."""
    at = part1 * step + part2 - 1 + n
    return F.floor(at / step).cast("int"), (F.pmod(at, F.lit(step)) + 1).cast("int")


def chunks(begin: Column, end: Column, n: int) -> Column:
    """Pieces of ``n`` days of [begin, end] as an array of (begin, end)."""
    starts = F.sequence(begin, end, F.expr(f"interval {n} days"))
    return F.transform(starts, lambda s: F.struct(s.alias("begin"), F.least(F.date_add(s, n - 1), end).alias("end")))


def between(a: Column, b: Column, keep_a: bool = False, keep_b: bool = True, weekdays: bool = False) -> Column:
    """Dates from a to b, weekends left out first if asked, then the first and the last if not kept."""
    days = F.sequence(a, b, F.expr("interval 1 day"))
    days = F.filter(days, lambda x: F.weekday(x) < 5) if weekdays else days
    first, size = (1 if keep_a else 2), F.size(days) - (0 if keep_a else 1) - (0 if keep_b else 1)
    return F.slice(days, F.lit(first), F.greatest(size, F.lit(0)))


def onto_weekday(d: Column, forth: bool = True) -> Column:
    """The date itself, or the Monday behind (Friday before) a weekend."""
    k = F.weekday(d)
    return F.date_add(d, F.when(k < 5, 0).otherwise(7 - k if forth else 4 - k))


def nth_weekday_day(d: Column, n: int) -> Column:
    """The n-th day from Monday to Friday behind (before, if negative) the date."""
    base = onto_weekday(d, forth=n < 0)
    k = F.weekday(base)
    steps = k + n
    moved = F.date_add(base, (F.floor(steps / 5) * 7 + F.pmod(steps, F.lit(5)) - k).cast("int"))
    return moved if n else onto_weekday(d)


def weekday_date(d: Column, weekday: int, weeks: int = 0) -> Column:
    """The date of a weekday (1 is Monday) in the date's week or ``weeks`` weeks off."""
    return F.date_add(d, (F.lit(weekday - 1 + 7 * weeks) - F.weekday(d)).cast("int"))


def reformat(x: Column, joiner: str = "-") -> Column:
    return F.date_format(parse(F.regexp_replace(F.regexp_replace(x, "[年月]", "-"), "日", "")), f"yyyy{joiner}MM{joiner}dd")


def date8_to_10(x: Column, joiner: str = "-") -> Column:
    return F.regexp_replace(x, r"^(\d{4})(\d{2})(\d{2})$", rf"$1{joiner}$2{joiner}$3")


def date10_to_8(x: Column) -> Column:
    return F.regexp_replace(x, r"\D", "")


def joiner_of(x: Column, joiners: str = " -/*#@._") -> Column:
    """(size, joiner): length of a text date and the mark between its parts; 8 and "" for eight digits; nulls for others."""
    found = F.when(x.rlike(r"^\d{8}$"), F.struct(F.length(x).alias("size"), F.lit("").alias("joiner")))
    for mark in reversed(joiners):
        part = "[" + (" " if mark == " " else "\\" + mark) + "]"
        found = F.when(x.rlike(rf"\d{{4}}{part}\d{{2}}{part}\d{{2}}"), F.struct(F.length(x).alias("size"), F.lit(mark).alias("joiner"))).otherwise(found)
    return found


def rejoin(x: Column, old: str, new: str = "-") -> Column:
    """Parts of a text date with another mark between them, each of two digits at least."""
    parts = F.split(x, "[" + "\\" + old + "]")
    return F.array_join(F.transform(parts, lambda p: F.when(F.length(p) < 2, F.lpad(p, 2, "0")).otherwise(p)), new)


def is_date(x: Column) -> Column:
    """Whether one of the formats reads the text."""
    return parse(x).isNotNull()


def kind_of(x: Column) -> Column:
    """The format of a text date, or 'timestamp' for a number of 10 to 19 characters; else null."""
    s = x.cast("string")
    return F.coalesce(date_format_of(s), F.when(s.rlike(r"^\d+(\.\d+)?$") & F.length(s).between(10, 19), "timestamp"))


def written_like(t: Column, sample: Column) -> Column:
    """A time as text in the format of a sample; as seconds, if the sample is a number of seconds."""
    fmt = kind_of(sample)
    out = F.when(fmt == "timestamp", F.unix_seconds(t.cast("timestamp")).cast("string"))
    for f in FORMATS:
        out = F.when(fmt == f, F.date_format(t, f)).otherwise(out)
    return out


def now_parts() -> dict[str, Column]:
    """The time now, and its date, month and quarter."""
    now = F.current_timestamp()
    return {"now": F.date_format(now, "yyyy-MM-dd HH:mm:ss"), "date": F.date_format(now, "yyyy-MM-dd"), "month": F.date_format(now, "yyyyMM"), "quarter": quarter_name(F.to_date(now))}


# ---- calendar


def calendar(spark: SparkSession, begin: datetime.date, end: datetime.date, off: DataFrame | None = None, worked: DataFrame | None = None) -> DataFrame:
    """(day, is_workday, name, ordinal): ordinal is the number of working days up to and with the day.

    off: (day, name) weekdays off; worked: (day) weekend days worked.  A calendar is some ten thousand rows at most, so
    it is numbered on one task and broadcast.
    """
    days = spark.range((end - begin).days + 1).select(F.date_add(F.lit(begin), F.col("id").cast("int")).alias("day"))
    name = F.lit(None).cast("string")
    if off is not None:
        days, name = days.join(F.broadcast(off.select(F.col("day"), F.col("name").alias("__off"))), "day", "left"), F.col("__off")
    extra = F.lit(False)
    if worked is not None:
        days, extra = days.join(F.broadcast(worked.select("day", F.lit(True).alias("__on"))), "day", "left"), F.coalesce("__on", F.lit(False))
    days = days.select("day", (extra | ((F.weekday("day") < 5) & name.isNull())).alias("is_workday"), name.alias("name"))
    return days.withColumn("ordinal", F.sum(F.col("is_workday").cast("int")).over(Window.orderBy("day")).cast("long"))


def onto_workday(df: DataFrame, date: str, cal: DataFrame, forth: bool = True, out: str = "workday") -> DataFrame:
    """The date itself if it is worked, else the next (last) working day."""
    return shift_workdays(df, date, cal, 0, out, forth)


def shift_workdays(df: DataFrame, date: str, cal: DataFrame, n: int = 1, out: str = "workday", forth: bool = True) -> DataFrame:
    """The n-th working day behind (before, if negative) the date; n = 0: the date, or the next (last) working day."""
    here = cal.select(F.col("day").alias("__d"), F.col("ordinal").alias("__o"), F.col("is_workday").alias("__w"))
    days = cal.where("is_workday").select(F.col("ordinal").alias("__t"), F.col("day").alias(out))
    # the ordinal counts the day itself if it is worked, so n = 0 on a day off is the next or the last one
    target = F.col("__o") + n + F.when(F.col("__w"), 0).otherwise(1 if (n == 0 and forth) or n < 0 else 0) if n <= 0 else F.col("__o") + n
    placed = df.join(F.broadcast(here), F.col(date) == F.col("__d"), "left").withColumn("__t0", target)
    return placed.join(F.broadcast(days), F.col("__t0") == F.col("__t"), "left").drop("__d", "__o", "__w", "__t", "__t0")


def find_workday(df: DataFrame, date: str, cal: DataFrame, n: int = 0, out: str = "workday") -> DataFrame:
    """The working day ``n`` behind the date or, on a day off, behind the next one; before the date, if n is negative."""
    moved = onto_workday(df, date, cal, out="__on")
    return shift_workdays(moved, "__on", cal, n, out).drop("__on") if n > 0 else shift_workdays(df, date, cal, n, out)


def trading_calendar(cal: DataFrame, first: datetime.date, known: DataFrame | None = None) -> DataFrame:
    """The calendar with trading days as working days: weekdays worked from ``first`` on, and what ``known`` (day, is_trading) says."""
    open_ = F.col("is_workday") & (F.weekday("day") < 5)
    days = cal
    if known is not None:
        days, open_ = cal.join(F.broadcast(known.select("day", F.col("is_trading").alias("__t"))), "day", "left"), F.coalesce("__t", open_)
    days = days.select("day", (open_ & (F.col("day") >= F.lit(first))).alias("is_workday"), "name")
    return days.withColumn("ordinal", F.sum(F.col("is_workday").cast("int")).over(Window.orderBy("day")).cast("long"))


STEMS, BRANCHES = "甲乙丙丁戊己庚辛壬癸", "子丑寅卯辰巳午未申酉戌亥"
ANIMALS = "鼠牛虎兔龙蛇马羊猴鸡狗猪"


def _cycle(at: Column) -> Column:
    """Name of a place (from 0) in the cycle of sixty."""
    return F.concat(F.substring(F.lit(STEMS), F.pmod(at, F.lit(10)).cast("int") + 1, F.lit(1)), F.substring(F.lit(BRANCHES), F.pmod(at, F.lit(12)).cast("int") + 1, F.lit(1)))


def cycle_year(year: Column) -> Column:
    """1984 began a cycle."""
    return _cycle(year - 1984)


def cycle_day(d: Column) -> Column:
    """1 October 1949 began a cycle of days."""
    return _cycle(F.datediff(d, F.lit(datetime.date(1949, 10, 1))))


def cycle_hour(t: Column) -> Column:
    """Two-hour name: the branch from the hour, the stem from the day's stem."""
    branch = F.floor((F.hour(t) + 1) / 2)
    day = F.datediff(F.to_date(t), F.lit(datetime.date(1949, 10, 1)))
    return _cycle(day * 12 + branch)


def animal(year: Column) -> Column:
    return F.substring(F.lit(ANIMALS), F.pmod(year - 1984, F.lit(12)).cast("int") + 1, F.lit(1))


def years_of_animal(sign: Column, until: int, n: int) -> Column:
    """The last ``n`` years of a sign up to a year, latest first; null for what is no sign."""
    place = F.instr(F.lit(ANIMALS), sign) - 1
    latest = F.lit(until) - F.pmod(F.lit(until - 1984) - place, F.lit(12))
    return F.when((place >= 0) & (F.length(sign) == 1), F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: latest - k * 12))


#: Last day of each western sign in its month, from January, and the signs in that order; fixed values.
SIGN_ENDS = (19, 18, 20, 19, 20, 21, 22, 22, 22, 23, 22, 21)
SIGNS = ("Capricorn", "Aquarius", "Pisces", "Aries", "Taurus", "Gemini", "Cancer", "Leo", "Virgo", "Libra", "Scorpio", "Sagittarius")


def western_sign(d: Column) -> Column:
    m = F.month(d)
    ends = F.array(*[F.lit(k) for k in SIGN_ENDS])
    at = F.pmod(m - 1 + F.when(F.dayofmonth(d) > F.element_at(ends, m), 1).otherwise(0), F.lit(12))
    return F.element_at(F.array(*[F.lit(s) for s in SIGNS]), at.cast("int") + 1)
