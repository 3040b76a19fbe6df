"""The Chinese lunar calendar from the series for the moon and the sun.

A month begins on the day of a new moon, by the clock of China (UTC+8; before 1929 that of Beijing, 7 h 45 min 40 s).  The
month in which the sun reaches 270 degrees is the 11th.  If 13 months begin from one 11th month to before the next, the
first of them in which the sun passes no multiple of 30 degrees is a leap month and has the number of the one before it.

Months and days are tables made from a range of years, some thousand rows a century, which are broadcast.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .dates import ANIMALS, _cycle

# Meeus, Astronomical Algorithms, chapter 49, the time of a new moon.
#: (days, power of the eccentricity, multiples of the sun's anomaly, the moon's anomaly and the argument of latitude).
MOON_TERMS = (
    (-0.40720, 0, 0, 1, 0), (0.17241, 1, 1, 0, 0), (0.01608, 0, 0, 2, 0), (0.01039, 0, 0, 0, 2), (0.00739, 1, -1, 1, 0), (-0.00514, 1, 1, 1, 0),
    (0.00208, 2, 2, 0, 0), (-0.00111, 0, 0, 1, -2), (-0.00057, 0, 0, 1, 2), (0.00056, 1, 1, 2, 0), (-0.00042, 0, 0, 3, 0), (0.00042, 1, 1, 0, 2),
    (0.00038, 1, 1, 0, -2), (-0.00024, 1, -1, 2, 0), (-0.00007, 0, 2, 1, 0), (0.00004, 0, 0, 2, -2), (0.00004, 0, 3, 0, 0), (0.00003, 0, 1, 1, -2),
    (0.00003, 0, 0, 2, 2), (-0.00003, 0, 1, 1, 2), (0.00003, 0, -1, 1, 2), (-0.00002, 0, -1, 1, -2), (-0.00002, 0, 1, 3, 0), (0.00002, 0, 0, 4, 0))
#: (days, degrees, degrees a month) of the planets' terms and the moon's node.
PLANET_TERMS = (
    (-0.00017, 124.7746, -1.56375588), (0.000325, 299.77, 0.107408), (0.000165, 251.88, 0.016321), (0.000164, 251.83, 26.651886), (0.000126, 349.42, 36.412478),
    (0.000110, 84.66, 18.206239), (0.000062, 141.74, 53.303771), (0.000060, 207.14, 2.453732), (0.000056, 154.84, 7.306860), (0.000047, 34.52, 27.261239),
    (0.000042, 207.19, 0.121824), (0.000040, 291.34, 1.844379), (0.000037, 161.72, 24.198154), (0.000035, 239.56, 25.513099), (0.000023, 331.55, 3.592518))
# Bretagnon and Simon, Planetary Programs and Tables, the sun's longitude: (10^-7 radians, degrees, degrees a century).
SUN_TERMS = (
    (403406, 270.54861, 0.9287892), (195207, 340.19128, 35999.1376958), (119433, 63.91854, 35999.4089666), (112392, 331.26220, 35998.7287385), (3891, 317.843, 71998.20261),
    (2819, 86.631, 71998.4403), (1721, 240.052, 36000.35726), (660, 310.26, 71997.4812), (350, 247.23, 32964.4678), (334, 260.87, -19.4410), (314, 297.82, 445267.1117),
    (268, 343.14, 45036.8840), (242, 166.79, 3.1008), (234, 81.53, 22518.4434), (158, 3.50, -19.9739), (132, 132.75, 65928.9345), (129, 182.95, 9038.0293),
    (114, 162.03, 3034.7684), (99, 29.8, 33718.148), (93, 266.4, 3034.448), (86, 249.2, -2280.773), (78, 157.6, 29929.992), (72, 257.8, 31556.493), (68, 185.1, 149.588),
    (64, 69.9, 9037.750), (46, 8.0, 107997.405), (38, 197.1, -4444.176), (37, 250.4, 151.771), (32, 65.3, 67555.316), (29, 162.7, 31556.080), (28, 341.5, -4561.540),
    (27, 291.6, 107996.706), (27, 98.5, 1221.655), (25, 146.7, 62894.167), (24, 110.0, 31437.369), (21, 5.2, 14578.298), (21, 342.6, -31931.757), (20, 230.9, 34777.243),
    (18, 256.1, 1221.999), (17, 45.3, 62894.511), (14, 242.9, -4442.039), (13, 115.2, 107997.909), (13, 151.8, 119.066), (13, 285.3, 16859.071), (12, 53.3, -4.578),
    (10, 126.6, 26895.292), (10, 205.7, -39.127), (10, 85.9, 12297.536), (10, 146.1, 90073.778))
#: Degrees of aberration and nutation: constant, and (degrees, degrees of the angle, degrees a century).
SUN_SHIFT, SUN_SHIFTS = -0.005575, ((0.0000974, 267.63, 35999.01848), (-0.004778, 124.90, -1934.134), (-0.0003667, 201.11, 72001.5377))

NOON_2000 = 2451545.0
MONTH_NAMES, TENS, DIGITS = "正二三四五六七八九十冬腊", ("初", "十", "廿", "三"), "一二三四五六七八九十"


def _sin(degrees: Column) -> Column:
    return F.sin(F.radians(degrees))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: as a lambda's variable it is not copied into every place."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _series(terms: tuple[tuple[float, ...], ...], use: Callable[..., Column]) -> Column:
    """The sum of ``use`` over the terms, which are one array of the plan."""
    table = F.array(*[F.array(*[F.lit(float(x)) for x in t]) for t in terms])
    return F.aggregate(table, F.lit(0.0), lambda s, t: s + use(*[F.get(t, F.lit(k)) for k in range(len(terms[0]))]))


def clock_lag(year: Column) -> Column:
    """Seconds by which the earth's clock is behind the uniform one, about: parabolas through the 20th and 21st century."""
    t = year - 2000
    u = (year - 1820) / 100
    return (F.when(year < 1920, -2.79 + 1.494119 * (year - 1900) - 0.0598939 * F.pow(year - 1900, F.lit(2)) + 0.0061966 * F.pow(year - 1900, F.lit(3)) - 0.000197 * F.pow(year - 1900, F.lit(4)))
            .when(year < 1941, 21.20 + 0.84493 * (year - 1920) - 0.076100 * F.pow(year - 1920, F.lit(2)) + 0.0020936 * F.pow(year - 1920, F.lit(3)))
            .when(year < 1961, 29.07 + 0.407 * (year - 1950) - F.pow(year - 1950, F.lit(2)) / 233 + F.pow(year - 1950, F.lit(3)) / 2547)
            .when(year < 1986, 45.45 + 1.067 * (year - 1975) - F.pow(year - 1975, F.lit(2)) / 260 - F.pow(year - 1975, F.lit(3)) / 718)
            .when(year < 2005, 63.86 + 0.3345 * t - 0.060374 * t * t + 0.0017275 * t * t * t + 0.000651814 * t * t * t * t + 0.00002373599 * t * t * t * t * t)
            .when(year < 2050, 62.92 + 0.32217 * t + 0.005589 * t * t).otherwise(-20 + 32 * u * u - 0.5628 * (2150 - year)))


def china_hours(jd: Column) -> Column:
    """The clock of China ahead of universal time; it changed with the year 1929."""
    return F.when(jd < 2425612.5 - 1 / 3, (7 + 45 / 60 + 40 / 3600)).otherwise(8.0)


def new_moon(k: Column) -> Column:
    """Julian day of the k-th new moon after that of 6 January 2000, in universal time."""
    k = k.cast("double")
    t = k / 1236.85
    args = F.struct(
        k.alias("k"), (2451550.09766 + 29.530588861 * k + t * t * (0.00015437 + t * (-0.000000150 + 0.00000000073 * t))).alias("mean"), (1 - 0.002516 * t - 0.0000074 * t * t).alias("e"),
        (2.5534 + 29.10535670 * k - t * t * (0.0000014 + 0.00000011 * t)).alias("sun"), (201.5643 + 385.81693528 * k + t * t * (0.0107582 + 0.00001238 * t)).alias("moon"),
        (160.7108 + 390.67050284 * k - t * t * (0.0016118 + 0.00000227 * t)).alias("node"))

    def at(v: Column) -> Column:
        main = _series(MOON_TERMS, lambda c, p, a, b, f: c * F.pow(v["e"], p) * _sin(a * v["sun"] + b * v["moon"] + f * v["node"]))
        rest = _series(PLANET_TERMS, lambda c, a, b: c * _sin(a + b * v["k"]))
        return v["mean"] + main + rest - _bound(2000 + (v["mean"] - NOON_2000) / 365.25, clock_lag) / 86400

    return _bound(args, at)


def sun_longitude(jd: Column) -> Column:
    """The sun's apparent longitude in degrees, to about a thousandth, at a Julian day of universal time."""

    def at(c: Column) -> Column:
        mean = 282.7771834 + 36000.76953744 * c + 0.000005729577951308232 * _series(SUN_TERMS, lambda x, a, b: x * _sin(a + b * c))
        return F.pmod(mean + SUN_SHIFT + _series(SUN_SHIFTS, lambda x, a, b: x * _sin(a + b * c)), F.lit(360.0))

    days = lambda j: (j - NOON_2000 + _bound(2000 + (j - NOON_2000) / 365.25, clock_lag) / 86400) / 36525
    return _bound(jd, lambda j: _bound(days(j), at))


def day_start(day: Column) -> Column:
    """Julian day of a date's first moment in China."""
    jd = F.datediff(day, F.lit(datetime.date(2000, 1, 1))) + (NOON_2000 - 0.5)
    return jd - china_hours(jd) / 24


def term_of(day: Column) -> Column:
    """Solar term (0..23, 0 at the spring equinox) that begins on the date in China, else null."""
    ends = F.array(*[F.floor(sun_longitude(day_start(d)) / 15).cast("int") for d in (day, F.date_add(day, 1))])
    return _bound(ends, lambda e: F.when(F.get(e, F.lit(0)) != F.get(e, F.lit(1)), F.get(e, F.lit(1))))


def lunar_months(spark: SparkSession, first: int, last: int) -> DataFrame:
    """(begin, days, year, month, leap) of the months that touch the years ``first`` to ``last``."""
    span = lambda year: int((year - 2000) * 12.3685)
    moons = spark.range(span(first) - 18, span(last + 1) + 18).select("id", new_moon(F.col("id")).alias("jd"))
    days = moons.select("id", F.date_add(F.lit(datetime.date(2000, 1, 1)), F.floor(F.col("jd") + china_hours(F.col("jd")) / 24 - (NOON_2000 - 0.5)).cast("int")).alias("begin"))
    order = Window.orderBy("id")
    sign = days.withColumn("sign", F.floor(sun_longitude(day_start(F.col("begin"))) / 30)).withColumns({"end": F.lead("begin").over(order), "next": F.lead("sign").over(order)})
    # signs of 30 degrees from the spring equinox: number 9 begins at 270 degrees, the winter solstice
    marked = sign.withColumns({"passes": F.pmod(F.col("next") - F.col("sign"), F.lit(12)), "ahead": F.pmod(9 - F.col("sign"), F.lit(12))})
    marked = marked.withColumn("solstice", (F.col("ahead") > 0) & (F.col("ahead") <= F.col("passes")))  # a month can pass two
    sui = marked.withColumn("sui", F.sum(F.col("solstice").cast("int")).over(order)).where("sui > 0 AND end IS NOT NULL")
    own = Window.partitionBy("sui").orderBy("id")
    placed = sui.withColumns({"at": F.row_number().over(own) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy("sui")), "solstice_year": F.min(F.year("begin")).over(Window.partitionBy("sui"))})
    bare = F.min(F.when((F.col("passes") == 0) & (F.col("at") > 0), F.col("at"))).over(Window.partitionBy("sui"))
    found = placed.withColumn("skip", F.when(F.col("n") == 13, bare)).withColumn("leap", F.coalesce(F.col("at") == F.col("skip"), F.lit(False)))
    number = F.col("at") - F.when(F.col("at") >= F.col("skip"), 1).otherwise(0)
    month = (F.pmod(number + 10, F.lit(12)) + 1).cast("int")
    out = found.select("begin", F.datediff("end", "begin").alias("days"), (F.col("solstice_year") + F.when(number >= 2, 1).otherwise(0)).cast("int").alias("year"), month.alias("month"), "leap")
    return out.where((F.year("begin") <= last) & (F.year(F.date_add("begin", F.col("days"))) >= first))


def lunar_calendar(spark: SparkSession, first: int, last: int) -> DataFrame:
    """(day, lunar_year, lunar_month, leap, lunar_day) of every day of the years."""
    months = lunar_months(spark, first, last)
    each = months.select(F.explode(F.sequence(F.lit(1), "days")).alias("lunar_day"), "begin", F.col("year").alias("lunar_year"), F.col("month").alias("lunar_month"), "leap")
    return each.select(F.date_add("begin", F.col("lunar_day") - 1).alias("day"), "lunar_year", "lunar_month", "leap", "lunar_day").where(F.year("day").between(first, last))


def to_lunar(df: DataFrame, date: str, cal: DataFrame) -> DataFrame:
    """``df`` with lunar_year, lunar_month, leap and lunar_day of a date; null outside the calendar."""
    return df.join(F.broadcast(cal.withColumnRenamed("day", "__day")), F.col(date) == F.col("__day"), "left").drop("__day")


def from_lunar(df: DataFrame, cal: DataFrame, year: str = "lunar_year", month: str = "lunar_month", leap: str = "leap", day: str = "lunar_day", out: str = "day") -> DataFrame:
    """``df`` with the date of a lunar one; null where there is no such day."""
    there = F.broadcast(cal.select(F.col("lunar_year").alias("__y"), F.col("lunar_month").alias("__m"), F.col("leap").alias("__l"), F.col("lunar_day").alias("__d"), F.col("day").alias(out)))
    return df.join(there, (F.col(year) == F.col("__y")) & (F.col(month) == F.col("__m")) & (F.col(leap) == F.col("__l")) & (F.col(day) == F.col("__d")), "left").drop("__y", "__m", "__l", "__d")


def lunar_text(month: Column, leap: Column, day: Column) -> Column:
    """Month and day as they are written."""
    ten, one = F.floor((day - 1) / 10).cast("int"), F.pmod(day - 1, F.lit(10)).cast("int")
    name = F.substring(F.lit(MONTH_NAMES), month, F.lit(1))
    tens = F.when(day == 20, "二").when(day == 30, "三").otherwise(F.element_at(F.array(*map(F.lit, TENS)), ten + 1))
    return F.concat(F.when(leap, "闰").otherwise(""), name, F.lit("月"), tens, F.substring(F.lit(DIGITS), one + 1, F.lit(1)))


def pillars(date: Column, year: Column) -> Column:
    """Names of the lunar year (with its animal), of the month by the sun and of the day, in the cycle of sixty."""
    since = F.floor(F.pmod(sun_longitude(day_start(F.date_add(date, 1))) - 315, F.lit(360.0)) / 30)  # months from the beginning of spring
    named = _bound(since, lambda m: _cycle((F.year(date) - F.when((m >= 10) & (F.month(date) < 3), 1).otherwise(0) - 1984) * 12 + m + 2))
    day = _cycle(F.datediff(date, F.lit(datetime.date(1949, 10, 1))))
    sign = F.substring(F.lit(ANIMALS), F.pmod(year - 1984, F.lit(12)).cast("int") + 1, F.lit(1))
    return F.concat(_cycle(year - 1984), F.lit("["), sign, F.lit("]年,"), named, F.lit("月,"), day, F.lit("日"))


#: The element of each stem and branch.
STEM_ELEMENTS, BRANCH_ELEMENTS = "木木火火土土金金水水", "水土木木土火火土金金土水"


def elements(name: Column) -> Column:
    """The elements of a name in the cycle of sixty, its stem's and its branch's."""
    from .dates import BRANCHES, STEMS

    return F.translate(F.translate(name, STEMS, STEM_ELEMENTS), BRANCHES, BRANCH_ELEMENTS)
