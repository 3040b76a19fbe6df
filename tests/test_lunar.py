"""The lunar calendar: known instants, new years and leap months, and every day there and back."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import lunar

#: Known new years and leap months.
NEW_YEARS = ("1900-01-31 1950-02-17 1980-02-16 1985-02-20 1990-01-27 1997-02-07 2000-02-05 2001-01-24 2010-02-14 2012-01-23 2015-02-19 2017-01-28 2018-02-16 2019-02-05 2020-01-25 2021-02-12 "
             "2022-02-01 2023-01-22 2024-02-10 2025-01-29 2026-02-17 2033-01-31 2034-02-19").split()
LEAPS = {1984: 10, 1987: 6, 1990: 5, 1993: 3, 1995: 8, 1998: 5, 2001: 4, 2004: 2, 2006: 7, 2009: 5, 2012: 4, 2014: 9, 2017: 6, 2020: 4, 2023: 2, 2025: 6, 2028: 5, 2031: 3, 2033: 11}


@pytest.fixture(scope="module")
def months(spark):
    return spark.createDataFrame(lunar.lunar_months(spark, 1900, 2100).collect(), "begin date, days int, year int, month int, leap boolean").cache()


def test_instants(spark):
    moon = spark.range(1).select(lunar.new_moon(F.lit(-283)).alias("a"), lunar.new_moon(F.lit(0)).alias("b")).first()
    assert abs(moon.a - (2443192.65118 - 47.7 / 86400)) < 2e-4 and abs(moon.b - (2451550.25972)) < 1e-3  # 18 February 1977, 6 January 2000 18:14
    at = lambda *when: (datetime.datetime(*when) - datetime.datetime(2000, 1, 1, 12)) / datetime.timedelta(days=1) + lunar.NOON_2000
    for when, degrees in (((2000, 3, 20, 7, 35), 0), ((2024, 12, 21, 9, 20), 270), ((2010, 6, 21, 11, 28), 90), ((1962, 9, 23, 12, 35), 180)):
        off = (spark.range(1).select(lunar.sun_longitude(F.lit(at(*when)))).first()[0] - degrees + 180) % 360 - 180
        assert abs(off) < 0.003, (when, off)


def test_years_and_leap_months(months):
    rows = months.collect()
    first = {r.year: str(r.begin) for r in rows if r.month == 1 and not r.leap}
    assert [first[int(d[:4])] for d in NEW_YEARS] == NEW_YEARS
    leaps = {r.year: r.month for r in rows if r.leap}
    assert {y: m for y, m in leaps.items() if 1983 < y < 2034} == LEAPS
    assert {r.days for r in rows} == {29, 30}
    for y in range(1901, 2100):
        assert [r.month for r in sorted(rows, key=lambda r: r.begin) if r.year == y and not r.leap] == list(range(1, 13))


def test_every_day_there_and_back(spark):
    cal = lunar.lunar_calendar(spark, 1900, 2100).cache()
    assert cal.count() == (datetime.date(2100, 12, 31) - datetime.date(1900, 1, 1)).days + 1
    assert cal.groupBy("lunar_year", "lunar_month", "leap", "lunar_day").count().where("count > 1").isEmpty()
    back = lunar.from_lunar(lunar.to_lunar(cal.select(F.col("day").alias("d")), "d", cal), cal)
    assert back.where("NOT d <=> day").isEmpty()
    known = spark.createDataFrame([("2023-04-19", 2023, 2, True, 29), ("2023-03-21", 2023, 2, False, 30), ("2020-05-23", 2020, 4, True, 1)], "d string, y int, m int, l boolean, k int")
    got = lunar.from_lunar(known, cal, "y", "m", "l", "k").collect()
    assert all(str(r.day) == r.d for r in got)
    assert lunar.from_lunar(spark.createDataFrame([(2024, 2, True, 1)], "y int, m int, l boolean, k int"), cal, "y", "m", "l", "k").first().day is None


def test_names(spark):
    df = spark.createDataFrame([(datetime.date(2023, 1, 22), 2023), (datetime.date(2024, 2, 10), 2024), (datetime.date(1992, 5, 14), 1992), (datetime.date(2000, 1, 1), 1999)], "d date, y int")
    got = [r[0] for r in df.select(lunar.pillars(F.col("d"), F.col("y"))).collect()]
    assert got == ["癸卯[兔]年,癸丑月,庚辰日", "甲辰[龙]年,丙寅月,甲辰日", "壬申[猴]年,乙巳月,庚寅日", "己卯[兔]年,丙子月,戊午日"]
    texts = spark.range(1).select(*[lunar.lunar_text(F.lit(m), F.lit(leap), F.lit(d)) for m, leap, d in ((1, False, 1), (2, True, 20), (12, False, 30), (11, False, 10), (4, False, 21))]).first()
    assert list(texts) == ["正月初一", "闰二月二十", "腊月三十", "冬月初十", "四月廿一"]
    assert spark.range(1).select(lunar.elements(F.lit("甲子")), lunar.elements(F.lit("癸丑"))).first()[:] == ("木水", "水土")


def test_terms(spark):
    days = spark.range(366).select(F.date_add(F.lit(datetime.date(2024, 1, 1)), F.col("id").cast("int")).alias("d"))
    found = {r.t: str(r.d) for r in days.select("d", lunar.term_of(F.col("d")).alias("t")).where("t IS NOT NULL").collect()}
    assert len(found) == 24 and [found[k] for k in (21, 0, 1, 6, 12, 18)] == ["2024-02-04", "2024-03-20", "2024-04-04", "2024-06-21", "2024-09-22", "2024-12-21"]
