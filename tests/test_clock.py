"""Local clocks to UTC: gaps, overlaps, unknown zones and midnight."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from turnline.functions.clock import (
    day_offsets, epoch_minute, hour_of_day, minutes_between, plus_minutes, wall_clock, with_local_to_utc,
)


def utc_minute(text):
    return int(pd.Timestamp(text, tz="UTC").timestamp()) // 60


def localised(spark, rows):
    frame = spark.createDataFrame(rows, "i int, date date, hhmm int, tz string")
    frame = frame.withColumns(day_offsets(F.col("date"), F.col("tz")))
    timed = with_local_to_utc(frame, wall_clock(F.col("date"), F.col("hhmm")), "tz", "instant")
    return {row.i: row.m for row in timed.select("i", epoch_minute(F.col("instant")).alias("m")).collect()}


def test_named_cases(spark):
    spring, autumn, june = dt.date(2024, 3, 10), dt.date(2024, 11, 3), dt.date(2024, 6, 1)
    cases = [
        (spring, 230, "America/New_York", None),
        (autumn, 130, "America/New_York", None),
        (autumn, 30, "America/New_York", "2024-11-03 04:30"),
        (autumn, 230, "America/New_York", "2024-11-03 07:30"),
        (spring, 230, "America/Phoenix", "2024-03-10 09:30"),
        (june, 2400, "America/Chicago", "2024-06-02 05:00"),
        (june, 1200, None, None),
        (spring, 2400, "Pacific/Honolulu", "2024-03-11 10:00"),
    ]
    found = localised(spark, [(i, date, hhmm, tz) for i, (date, hhmm, tz, _) in enumerate(cases)])
    for i, (_, _, _, expected) in enumerate(cases):
        assert found[i] == (None if expected is None else utc_minute(expected)), cases[i]


@pytest.mark.parametrize("session_zone", ["UTC", "America/Los_Angeles"])
def test_agrees_with_a_second_implementation_whatever_the_session_zone(spark, session_zone):
    zones = [
        "America/New_York", "America/Denver", "America/Phoenix", "Pacific/Honolulu", "America/St_Johns",
        "Europe/London", "Australia/Lord_Howe", "Pacific/Guam", "America/Puerto_Rico", "America/Anchorage",
    ]
    draw = random.Random(11)
    changes = [dt.date(2024, 3, 10), dt.date(2024, 11, 3), dt.date(2024, 3, 31), dt.date(2024, 10, 27),
               dt.date(2024, 4, 7), dt.date(2024, 10, 6)]
    rows = []
    for zone in zones:
        for date in changes + [dt.date(2024, 1, 1) + dt.timedelta(draw.randrange(366)) for _ in range(20)]:
            for minute in [*range(0, 300, 15), *[draw.randrange(1440) for _ in range(5)]]:
                rows.append((len(rows), date, minute // 60 * 100 + minute % 60, zone))
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", session_zone)
    try:
        found = localised(spark, rows)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    for i, date, hhmm, zone in rows:
        naive = pd.Timestamp(date) + pd.Timedelta(minutes=hhmm // 100 * 60 + hhmm % 100)
        expected = naive.tz_localize(zone, ambiguous="NaT", nonexistent="NaT")
        assert found[i] == (None if expected is pd.NaT else int(expected.timestamp()) // 60), (date, hhmm, zone)


def test_hours_and_minute_arithmetic(spark):
    frame = spark.createDataFrame([(0,), (59,), (100,), (2359,), (2400,)], "t int")
    hours = frame.select("t", hour_of_day(F.col("t")).alias("h")).collect()
    assert {r.t: r.h for r in hours} == {0: 0, 59: 0, 100: 1, 2359: 23, 2400: 0}
    start = F.lit("2024-06-01 12:00:00").cast("timestamp")
    row = spark.range(1).select(
        minutes_between(start, plus_minutes(start, F.lit(2160))).alias("ahead"),
        minutes_between(start, plus_minutes(start, F.lit(-1))).alias("behind"),
        plus_minutes(start, F.lit(None).cast("int")).alias("unknown"),
    ).first()
    assert (row.ahead, row.behind, row.unknown) == (2160, -1, None)
