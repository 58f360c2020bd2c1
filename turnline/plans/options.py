"""What a filter can be set to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnline.functions.numeric import count_rows
from turnline.plans.rankings import route_label
from turnline.plans.views import MIN_ROUTE_FLIGHTS


def filter_bounds(flights: DataFrame) -> DataFrame:
    return flights.agg(F.min("flight_date").alias("min_date"), F.max("flight_date").alias("max_date"))


def filter_airlines(flights: DataFrame) -> DataFrame:
    return flights.select("reporting_airline").distinct().orderBy("reporting_airline")


def filter_airports(flights: DataFrame) -> DataFrame:
    return flights.select(F.col("origin").alias("airport")).distinct().orderBy("airport")


def filter_routes(flights: DataFrame, min_flights: int = MIN_ROUTE_FLIGHTS) -> DataFrame:
    """Routes with enough flights, as shown and as ``FlightFilter.route`` takes them."""
    return (
        flights.groupBy("origin", "dest")
        .agg(count_rows().alias("flights"))
        .where(F.col("flights") >= min_flights)
        .orderBy("origin", "dest")
        .select(route_label().alias("label"), F.concat_ws("-", "origin", "dest").alias("value"))
    )
