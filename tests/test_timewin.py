from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

from pyspark.sql import functions as F

from sluicewatch import resolve_as_of
from sluicewatch.functions.timewin import iso_weekday, ntz, weekday_name


def test_as_of_forms():
    naive = datetime(2024, 1, 31, 6, 30)
    assert resolve_as_of(naive) == naive
    assert resolve_as_of("2024-01-31 06:30:00") == naive
    east = timezone(timedelta(hours=2))
    assert resolve_as_of(datetime(2024, 1, 31, 8, 30, tzinfo=east)) == naive
    assert resolve_as_of("2024-01-31T08:30:00+02:00") == naive
    now = resolve_as_of()
    assert now.tzinfo is None
    assert abs(now - datetime.now(timezone.utc).replace(tzinfo=None)) < timedelta(minutes=1)


def test_ntz_keeps_microseconds(spark):
    moment = datetime(2024, 3, 10, 2, 30, 0, 7)
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = spark.range(1).select(ntz(moment).alias("t"))
        assert got.schema["t"].dataType.simpleString() == "timestamp_ntz"
        assert got.first().t == moment
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_weekdays(spark):
    days = spark.createDataFrame([(date(2024, 3, 11 + i),) for i in range(7)], "d date")
    named = days.select(weekday_name(iso_weekday(F.col("d"))).alias("n")).collect()
    assert [r.n for r in named] == ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
