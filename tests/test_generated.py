"""Row-by-row steps stay within what the JVM compiles: a generated method beyond 8,000 bytes is interpreted for good."""

import pytest
from pyspark.sql import functions as F

from turnline.schema import FLIGHT_NAMES
from turnline.sources import derived
from turnline.sources.flights_csv import read_raw, typed_flights, write_raw
from turnline.sources.links_csv import read_links_csv, write_links_csv

LONGEST = 8000


@pytest.fixture
def method_sizes(spark):
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")

    def sizes(frame):
        stages = debug.codegenStringSeq(frame._jdf.queryExecution().executedPlan())
        return [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())]

    yield sizes
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_derived_flights(spark, data_dir, method_sizes):
    assert 0 < max(method_sizes(derived.derive_flights(spark, data_dir))) < LONGEST


def test_raw_flights_and_links(spark, flights, links, tmp_path, method_sizes):
    write_raw(flights.limit(100), str(tmp_path / "raw"))
    assert 0 < max(method_sizes(typed_flights(read_raw(spark, str(tmp_path / "raw/*/*.csv"))))) < LONGEST
    write_links_csv(links.limit(100), str(tmp_path / "links"))
    assert 0 < max(method_sizes(read_links_csv(spark, str(tmp_path / "links")))) < LONGEST


def test_stored_flights_are_those_derived_in_place(spark, data_dir, flights):
    stored, fresh = flights.select(*FLIGHT_NAMES), derived.derive_flights(spark, data_dir)
    assert stored.exceptAll(fresh).isEmpty() and fresh.exceptAll(stored).isEmpty()


def test_numbers_and_dates_of_raw_text(spark, flights, tmp_path):
    """Blanks, exponents and large numbers are read and written as before."""
    wide = flights.limit(1).withColumns({"distance": F.lit(12_345_678), "taxi_in": F.lit(-7), "air_time": F.lit(0)})
    write_raw(wide, str(tmp_path / "raw"))
    raw = read_raw(spark, str(tmp_path / "raw/*/*.csv"))
    row = raw.first()
    assert (row.Distance, row.TaxiIn, row.AirTime) == ("1.2345678E7", "-7.0", "0.0")
    spaced = raw.withColumns({"TaxiIn": F.lit(" 1e1 "), "AirTime": F.lit("  "), "FlightDate": F.lit(" 2024-02-29 "), "Cancelled": F.lit("2.0")})
    got = typed_flights(spaced, F.lit("x").alias("beside")).first()
    assert (got.distance, got.taxi_in, got.air_time, str(got.flight_date), got.cancelled, got.beside) == (12_345_678, 10, None, "2024-02-29", False, "x")
