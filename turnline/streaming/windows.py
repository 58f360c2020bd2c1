"""Flights as they are loaded, counted in tumbling windows: late ones up to a watermark, exactly once.

A run takes what files are new since the last one, adds their flights to the windows that are open, and writes the
windows that the watermark has passed.  Open windows wait in the state under the checkpoint folder; a run that fails is
repeated from there, and no window is written twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnline.functions.clock import DAY_SECONDS, wall_clock
from turnline.functions.numeric import count_rows, int_div
from turnline.schema import FLIGHTS

# How late a flight may come, behind the latest departure seen.
LATE = "3 days"


def read_loads(spark: SparkSession, source: str) -> DataFrame:
    """The stream of a folder that typed flights are added to."""
    return spark.readStream.schema(FLIGHTS).parquet(source)


def daily_delays(flights: DataFrame, late: str = LATE) -> DataFrame:
    """Flights, and late arrivals among them, per airport and local day of scheduled departure, as a stream.

    A flight without a date or an airport is in no window, and neither is one whose day the watermark has passed.
    """
    departs = F.timestamp_seconds(wall_clock(F.col("flight_date"), F.col("crs_dep_time")))
    placed = flights.where("flight_date is not null and crs_dep_time is not null and origin is not null")
    windows = placed.withColumn("departs", departs).withWatermark("departs", late).groupBy(F.window("departs", "1 day"), "origin").agg(
        count_rows().alias("flights"), F.count("arr_del15").alias("completed_flights"), F.count_if("arr_del15").alias("delayed_flights")
    )
    day = F.date_from_unix_date(int_div(F.unix_seconds("window.start"), F.lit(DAY_SECONDS)).cast("int"))
    return windows.select(day.alias("day"), F.col("origin").alias("airport"), "flights", "completed_flights", "delayed_flights")


def take_load(spark: SparkSession, source: str, target: str, checkpoint: str, late: str = LATE) -> None:
    """One run: new files in, windows that have closed out; returns when all that is there is taken."""
    query = (
        daily_delays(read_loads(spark, source), late)
        .writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(target)
    )
    query.awaitTermination()
