"""Ad-hoc questions over the flights table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnline.functions.clock import hour_of_day
from turnline.functions.labels import CANCELLATION_REASONS, lookup
from turnline.functions.numeric import correlation, count_rows, mean, mean_of, pct, pct_of_rows
from turnline.operators.topk import top_k
from turnline.plans.kpis import delay_rate as delay_rate_of
from turnline.plans.kpis import late_aircraft_share
from turnline.plans.views import MIN_AIRPORT_FLIGHTS, MIN_ROUTE_FLIGHTS, delay_cause_performance
from turnline.schema import DELAY_CAUSES

TOP_DELAYED = 20


def overall_volume(flights: DataFrame) -> DataFrame:
    """Flights, exact distinct aircraft, carriers and origins, first and last date, in one scan.

    Rows are combined by aircraft, carrier and origin before they are expanded for the three distinct
    counts, so what is expanded and shuffled is those combinations and not the flights.
    """
    combined = flights.groupBy("tail_number", "reporting_airline", "origin").agg(
        count_rows().alias("n"), F.min("flight_date").alias("first"), F.max("flight_date").alias("last")
    )
    return combined.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_flights"),
        F.count_distinct("tail_number").alias("distinct_aircraft"),
        F.count_distinct("reporting_airline").alias("distinct_carriers"),
        F.count_distinct("origin").alias("distinct_origin_airports"),
        F.min("first").alias("first_date"),
        F.max("last").alias("last_date"),
    )


def monthly_volume(flights: DataFrame) -> DataFrame:
    month = F.trunc("flight_date", "month").alias("month")
    return flights.groupBy(month).agg(count_rows().alias("flights")).orderBy("month")


def delay_rate(flights: DataFrame) -> DataFrame:
    return flights.agg(
        F.count_if("arr_del15").alias("delayed_flights"),
        F.count("arr_del15").alias("completed_flights"),
        delay_rate_of().alias("delay_rate_pct"),
    )


def arrival_delay_stats(flights: DataFrame) -> DataFrame:
    """Mean, median and mean-when-late of the arrival delay.

    Whole minutes repeat, so everything is read off the count of each minute
    value; the median is exact and interpolated.
    """
    minutes = F.col("arr_delay_minutes")
    histogram = flights.where(minutes.isNotNull()).groupBy(minutes).agg(count_rows().alias("n"))
    late = minutes > 0
    return histogram.agg(
        mean(F.sum(minutes * F.col("n")), F.sum("n")).alias("avg_arr_delay_minutes"),
        F.percentile(minutes, 0.5, F.col("n")).alias("median_arr_delay_minutes"),
        mean(F.sum(F.when(late, minutes * F.col("n"))), F.sum(F.when(late, F.col("n"))))
        .alias("avg_delay_minutes_when_late"),
    )


def cancellation_rate(flights: DataFrame) -> DataFrame:
    return flights.agg(
        F.count_if("cancelled").alias("cancelled_flights"),
        count_rows().alias("total_flights"),
        pct_of_rows(F.col("cancelled"), 3).alias("cancellation_rate_pct"),
    )


def cancellation_by_reason(flights: DataFrame) -> DataFrame:
    return (
        flights.where("cancelled")
        .groupBy("cancellation_code")
        .agg(count_rows().alias("cancelled_flights"))
        .select(
            "cancellation_code",
            lookup(F.col("cancellation_code"), CANCELLATION_REASONS).alias("reason"),
            "cancelled_flights",
        )
        .orderBy(F.col("cancelled_flights").desc(), "cancellation_code")
    )


def delay_cause_share(flights: DataFrame) -> DataFrame:
    return delay_cause_performance(flights)


def airport_delay_top20(
    flights: DataFrame, min_flights: int = MIN_AIRPORT_FLIGHTS, k: int = TOP_DELAYED
) -> DataFrame:
    rows = flights.groupBy("origin").agg(
        count_rows().alias("flights"),
        delay_rate_of().alias("delay_rate_pct"),
        mean_of(F.col("arr_delay_minutes")).alias("avg_arr_delay_minutes"),
        late_aircraft_share().alias("late_aircraft_share_pct"),
    )
    return top_k(rows.where(F.col("flights") >= min_flights), "delay_rate_pct", ["origin"], k)


def route_delay_top20(flights: DataFrame, min_flights: int = MIN_ROUTE_FLIGHTS, k: int = TOP_DELAYED) -> DataFrame:
    rows = flights.groupBy("origin", "dest").agg(
        count_rows().alias("flights"),
        delay_rate_of().alias("delay_rate_pct"),
        mean_of(F.col("arr_delay_minutes")).alias("avg_arr_delay_minutes"),
    )
    return top_k(rows.where(F.col("flights") >= min_flights), "delay_rate_pct", ["origin", "dest"], k)


def day_of_week(flights: DataFrame) -> DataFrame:
    """By ISO weekday, 1 for Monday; the name is added to the seven result rows."""
    iso_day = (F.weekday("flight_date") + 1).alias("iso_day_of_week")
    names = F.array(*[F.lit(name) for name in (
        "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday",
    )])
    return (
        flights.groupBy(iso_day)
        .agg(
            count_rows().alias("flights"),
            delay_rate_of().alias("delay_rate_pct"),
            mean_of(F.col("arr_delay_minutes")).alias("avg_arr_delay_minutes"),
        )
        .select(
            "iso_day_of_week", F.element_at(names, F.col("iso_day_of_week")).alias("day_name"),
            "flights", "delay_rate_pct", "avg_arr_delay_minutes",
        )
        .orderBy("iso_day_of_week")
    )


def hour_of_day_pattern(flights: DataFrame) -> DataFrame:
    return (
        flights.groupBy(hour_of_day(F.col("crs_dep_time")).alias("scheduled_dep_hour"))
        .agg(
            count_rows().alias("flights"),
            delay_rate_of().alias("delay_rate_pct"),
            mean_of(F.col("arr_delay_minutes")).alias("avg_arr_delay_minutes"),
            mean_of(F.col("late_aircraft_delay")).alias("avg_late_aircraft_delay_minutes"),
        )
        .orderBy("scheduled_dep_hour")
    )


def late_aircraft_dominant(flights: DataFrame) -> DataFrame:
    """Flights on which no reported cause exceeds the late-aircraft minutes; ties count."""
    late = F.col("late_aircraft_delay")
    dominant = (late == F.greatest(*DELAY_CAUSES)) & (late > 0)
    return flights.where(F.col("carrier_delay").isNotNull()).agg(
        F.count_if(dominant).alias("late_aircraft_dominant_flights"),
        count_rows().alias("total_delayed_flights"),
        pct_of_rows(dominant).alias("pct_late_aircraft_dominant"),
    )


def late_aircraft_share_by_hour(flights: DataFrame) -> DataFrame:
    return (
        flights.where(F.col("carrier_delay").isNotNull())
        .groupBy(hour_of_day(F.col("crs_dep_time")).alias("scheduled_dep_hour"))
        .agg(
            late_aircraft_share().alias("late_aircraft_share_pct"),
            mean_of(F.col("late_aircraft_delay")).alias("avg_late_aircraft_delay_minutes"),
        )
        .orderBy("scheduled_dep_hour")
    )


def _timed_both_ends(flights: DataFrame) -> DataFrame:
    return flights.where(F.col("dep_delay_minutes").isNotNull() & F.col("arr_delay_minutes").isNotNull())


def dep_arr_correlation(flights: DataFrame) -> DataFrame:
    """How a flight's own departure delay goes with its arrival delay."""
    return _timed_both_ends(flights).agg(
        correlation(F.col("dep_delay_minutes"), F.col("arr_delay_minutes")).alias("dep_arr_delay_correlation"),
        count_rows().alias("flights_used"),
    )


def inflight_recovery(flights: DataFrame) -> DataFrame:
    """Minutes won back in the air by flights that left late; negative when more were lost."""
    recovered = F.col("dep_delay_minutes") - F.col("arr_delay_minutes")
    return _timed_both_ends(flights).where(F.col("dep_delay_minutes") > 0).agg(
        mean_of(recovered).alias("avg_minutes_recovered_in_flight"),
        pct_of_rows(recovered > 0).alias("pct_flights_recovering_time"),
    )
