"""Datasets over spans of time and of dimensions: duty chains, moving rates, the KPI cube, ranks over all routes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnline.functions.clock import epoch_minute
from turnline.functions.numeric import count_rows, mean, pct
from turnline.operators.compare import with_percent_rank
from turnline.operators.rotation import computed_once, legs_of, with_utc_times
from turnline.operators.sequence import HOT_ROWS
from turnline.operators.sessions import merged, sessions

# An aircraft's duty chain ends where it stands for longer than this.
DUTY_GAP_MIN = 8 * 60

# Days of a moving rate, the day itself included.
MOVING_DAYS = 28

DUTY_SUMS = ("legs", "block_minutes")


def leg_spans(flights: DataFrame, airports: DataFrame) -> DataFrame:
    """Scheduled departure and arrival minute (UTC, since the epoch) of every leg whose times are known."""
    timed = with_utc_times(legs_of(flights), airports)
    start, end = epoch_minute(F.col("dep_utc_scheduled")), epoch_minute(F.col("arr_utc_scheduled"))
    minutes = computed_once(timed.select("tail_number", "flight_number", start.alias("start"), end.alias("end")))
    start, end = F.col("start"), F.col("end")
    return minutes.where("start is not null and end is not null").select(
        "tail_number", start.alias("start_min"), F.greatest(start, end).alias("end_min"), F.lit(1).cast("bigint").alias("legs"),
        F.greatest(end - start, F.lit(0).cast("bigint")).alias("block_minutes"), F.col("flight_number"),
    )


def duty_chains(spans: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Legs of an aircraft without a scheduled gap of more than ``DUTY_GAP_MIN``."""
    return sessions(
        spans, ["tail_number"], "start_min", "end_min", DUTY_GAP_MIN, {name: F.sum(name) for name in DUTY_SUMS}, hot_rows
    )


def duty_chains_after(stored: DataFrame, late: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Stored duty chains after late legs came."""
    return merged(stored, late, ["tail_number"], "start_min", "end_min", DUTY_GAP_MIN, DUTY_SUMS, hot_rows)


def moving_delay_rate(flights: DataFrame, days: int = MOVING_DAYS) -> DataFrame:
    """Delay rate of each airport over the days up to each day it has flights on.

    The frame runs over days and not over flights: those are counted per airport and day first, so a window holds no
    more rows of an airport than the calendar has days.
    """
    daily = flights.where("origin is not null and flight_date is not null").groupBy("origin", "flight_date").agg(
        F.count("arr_del15").alias("completed"), F.count_if("arr_del15").alias("delayed")
    )
    frame = Window.partitionBy("origin").orderBy(F.unix_date("flight_date")).rangeBetween(1 - days, 0)
    completed, delayed = F.sum("completed").over(frame), F.sum("delayed").over(frame)
    moving = daily.select(
        F.col("origin").alias("airport"), "flight_date", completed.alias("completed_flights"), delayed.alias("delayed_flights")
    )
    return moving.withColumn("delay_rate_pct", pct(F.col("delayed_flights"), F.col("completed_flights")))


def kpi_cube(flights: DataFrame) -> DataFrame:
    """Flight KPIs by airline, origin, month, every combination of them, and altogether, in one scan.

    ``grouping_id`` has a bit per dimension (airline 4, origin 2, month 1), set where the row is over all its values; so a
    null that flights have is told from a total.  The finest level is summed first and the cube rolls up those sums.
    """
    month = F.trunc("flight_date", "month").alias("month")
    finest = flights.groupBy("reporting_airline", "origin", month).agg(
        count_rows().alias("n"), F.count("arr_del15").alias("completed"), F.count_if("arr_del15").alias("delayed"),
        F.count_if("cancelled").alias("cancelled"), F.sum("arr_delay_minutes").alias("minutes"),
        F.count("arr_delay_minutes").alias("timed"),
    )
    sums = {name: F.sum(name) for name in ("n", "completed", "delayed", "cancelled", "minutes", "timed")}
    rolled = finest.cube("reporting_airline", "origin", "month").agg(
        F.grouping_id().cast("int").alias("grouping_id"), *[total.alias(name) for name, total in sums.items()]
    )
    return rolled.select(
        "grouping_id", "reporting_airline", "origin", "month", F.col("n").alias("total_flights"),
        F.col("delayed").alias("delayed_flights"), pct(F.col("delayed"), F.col("completed")).alias("delay_rate_pct"),
        pct(F.col("cancelled"), F.col("n")).alias("cancellation_rate_pct"), F.col("minutes").alias("total_delay_minutes"),
        mean(F.col("minutes"), F.col("timed")).alias("avg_delay_minutes"),
    )


def route_percent_ranks(flights: DataFrame) -> DataFrame:
    """Every route's delay rate and where it stands among all routes with one."""
    routes = flights.groupBy("origin", "dest").agg(
        F.count("arr_del15").alias("completed_flights"), pct(F.count_if("arr_del15"), F.count("arr_del15")).alias("delay_rate_pct")
    ).where("completed_flights > 0")
    return with_percent_rank(routes, "delay_rate_pct").select(
        "origin", "dest", "completed_flights", "delay_rate_pct", "rank", "percent_rank"
    )
