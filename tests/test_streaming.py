"""Loads taken one after the other: late flights count until the watermark has passed their day, runs can be repeated."""

import datetime as dt

from pyspark.sql import functions as F

from turnline.schema import FLIGHT_NAMES, FLIGHTS
from turnline.sources.tables import read_table
from turnline.streaming.windows import take_load


def load(spark, flights, days):
    """One on-time and one late flight at AAA per day given, from a template row."""
    base = flights.limit(1).drop("flight_date", "origin", "crs_dep_time", "arr_del15")
    rows = spark.createDataFrame(
        [(dt.date(2024, 1, d) if d else None, "AAA", 1200, late) for d in days for late in (True, False)],
        "flight_date date, origin string, crs_dep_time int, arr_del15 boolean")
    return rows.join(F.broadcast(base)).select(*FLIGHT_NAMES)


def test_late_flights_up_to_the_watermark(spark, flights, tmp_path):
    source, target, checkpoint = (str(tmp_path / name) for name in ("source", "target", "checkpoint"))

    def take(days):
        load(spark, flights, days).coalesce(1).write.mode("append").parquet(source)
        take_load(spark, source, target, checkpoint)
        return {(r.day.day, r.flights, r.delayed_flights) for r in read_table(spark, target).collect()}

    assert take([1, 2, 6]) == {(1, 2, 1), (2, 2, 1)}  # the watermark is noon of the third
    assert take([4, 3, 1, None]) == {(1, 2, 1), (2, 2, 1)}  # the third still counts, the first is closed
    take_load(spark, source, target, checkpoint)  # nothing new
    found = take([20])
    assert found == {(1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 2, 1), (6, 2, 1)}
    assert read_table(spark, target).count() == 5


def test_columns_are_those_of_flights(flights):
    assert [f.name for f in FLIGHTS.fields] == flights.select(*FLIGHT_NAMES).columns
