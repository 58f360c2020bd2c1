"""Stored sketches: months merged are near the exact figures, whatever the order they are merged in."""

from pyspark.sql import functions as F

from turnline.plans import sketches


def test_merged_months_are_within_the_stated_error(spark, flights, tmp_path):
    sketches.monthly_sketches(flights).write.parquet(str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    rows = sketches.compared(stored, flights).collect()
    assert len(rows) == stored.count() + 1
    assert all(r.aircraft_within_error and r.routes_within_error and r.median_within_error and r.p90_within_error for r in rows)
    assert [r.flights for r in rows if r.is_total] == [flights.count()]


def test_quarters_from_months_and_empty_tables(flights):
    months = sketches.monthly_sketches(flights)
    quarters = sketches.merged(months, {"quarter": F.quarter("month")})
    assert sketches.estimates(quarters, ("quarter",)).agg(F.sum("flights")).first()[0] == flights.count()
    assert sketches.estimates_by_month(sketches.monthly_sketches(flights.limit(0))).where("not is_total").isEmpty()
    unknown = flights.limit(5).withColumn("arr_delay_minutes", F.lit(None).cast("int"))
    assert sketches.estimates(sketches.monthly_sketches(unknown)).first().median_delay is None
