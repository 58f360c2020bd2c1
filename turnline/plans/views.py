"""The seven analytical views; each takes an optional filter."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnline.functions.clock import hour_of_day
from turnline.functions.labels import BUFFER_BUCKETS, bin_label, bin_number
from turnline.functions.numeric import correlation, count_rows, mean_of, pct, pct_of_rows
from turnline.operators.filters import FlightFilter, narrowed
from turnline.operators.rotation import VALID, valid_links
from turnline.plans.kpis import FLIGHT_KPIS, LINK_KPIS, flight_kpis, joined_kpis, link_kpis
from turnline.schema import DELAY_CAUSES

Filter = FlightFilter | Mapping | None

# Flights a year from which an airport or a route is ranked.
MIN_AIRPORT_FLIGHTS = 1000
MIN_ROUTE_FLIGHTS = 200


def network_summary(flights: DataFrame, links: DataFrame, flt: Filter = None) -> DataFrame:
    """One row over everything: the flight KPIs and the link KPIs."""
    flight_row = flight_kpis(narrowed(flights, flt))
    link_row = link_kpis(narrowed(links, flt))
    # Two one-row frames become one row by stacking them and taking what is there.
    stacked = flight_row.unionByName(link_row, allowMissingColumns=True)
    return stacked.agg(*[F.max(name).alias(name) for name in (*FLIGHT_KPIS, *LINK_KPIS)])


def airport_performance(
    flights: DataFrame, links: DataFrame, flt: Filter = None, min_flights: int = MIN_AIRPORT_FLIGHTS
) -> DataFrame:
    """KPIs by origin airport, with a flag for those large enough to rank."""
    rows = joined_kpis(narrowed(flights, flt), narrowed(links, flt), {"airport": F.col("origin")})
    return rows.select(
        "airport", *FLIGHT_KPIS, *LINK_KPIS,
        (F.col("total_flights") >= min_flights).alias("meets_min_volume_threshold"),
    )


def route_performance(
    flights: DataFrame, links: DataFrame, flt: Filter = None, min_flights: int = MIN_ROUTE_FLIGHTS
) -> DataFrame:
    """KPIs by origin and destination, with a flag for those large enough to rank."""
    keys = {"origin": F.col("origin"), "dest": F.col("dest")}
    rows = joined_kpis(narrowed(flights, flt), narrowed(links, flt), keys)
    return rows.select(
        "origin", "dest", *FLIGHT_KPIS, *LINK_KPIS,
        (F.col("total_flights") >= min_flights).alias("meets_min_volume_threshold"),
    )


def hour_of_day_performance(flights: DataFrame, links: DataFrame, flt: Filter = None) -> DataFrame:
    """KPIs by scheduled departure hour, local time at the origin."""
    keys = {"scheduled_dep_hour": hour_of_day(F.col("crs_dep_time"))}
    rows = joined_kpis(narrowed(flights, flt), narrowed(links, flt), keys)
    shown = [name for name in FLIGHT_KPIS if name != "total_delay_minutes"]
    return rows.select("scheduled_dep_hour", *shown, *LINK_KPIS).orderBy("scheduled_dep_hour")


def delay_cause_performance(flights: DataFrame, flt: Filter = None) -> DataFrame:
    """Reported delay minutes by cause and their share; one scan, five rows."""
    attributed = narrowed(flights, flt).where(F.col("carrier_delay").isNotNull())
    totals = attributed.agg(*[F.sum(name).alias(name) for name in DELAY_CAUSES])
    everything = F.lit(0)
    for name in DELAY_CAUSES:
        everything = everything + F.coalesce(F.col(name), F.lit(0))
    return (
        totals.withColumn("everything", everything)
        .unpivot("everything", list(DELAY_CAUSES), "cause", "minutes")
        .select("cause", "minutes", pct(F.col("minutes"), F.col("everything")).alias("pct_of_total_delay_minutes"))
        .orderBy(F.col("minutes").desc_nulls_last(), "cause")
    )


def propagation_signal_comparison(links: DataFrame, flt: Filter = None) -> DataFrame:
    """Reported late-aircraft minutes (A) against the reconstructed estimate (B), one row."""
    reported, estimate = F.col("late_aircraft_delay"), F.col("propagated_delay_estimate_min")
    defined = reported.isNotNull()
    a = F.coalesce(reported, F.lit(0))
    both, neither = F.count_if((a > 0) & (estimate > 0)), F.count_if((a == 0) & (estimate == 0))
    return valid_links(narrowed(links, flt)).agg(
        count_rows().alias("signal_b_valid_links"),
        F.count(reported).alias("signal_a_defined_links"),
        pct_of_rows(defined).alias("signal_a_coverage_pct"),
        F.round(correlation(F.col("prior_leg_arr_delay_minutes"), reported), 3)
        .alias("corr_raw_prior_delay_vs_signal_a"),
        F.round(correlation(estimate, reported), 3).alias("corr_buffer_adjusted_estimate_vs_signal_a"),
        both.alias("both_signals_present"),
        neither.alias("both_signals_absent"),
        F.count_if((a == 0) & (estimate > 0)).alias("signal_b_only"),
        F.count_if((a > 0) & (estimate == 0)).alias("signal_a_only"),
        pct(both + neither, count_rows()).alias("agreement_rate_pct"),
    )


def late_departure(minutes: Column) -> Column:
    return minutes >= 15


def turnaround_buffer_performance(links: DataFrame, flt: Filter = None) -> DataFrame:
    """Downstream delay by scheduled buffer, over valid links whose prior leg came late."""
    delayed = narrowed(links, flt).where(
        (F.col("link_status") == VALID) & (F.col("prior_leg_arr_delay_minutes") > 0)
    )
    last = F.lit(len(BUFFER_BUCKETS) - 1)
    bucket = F.coalesce(bin_number(F.col("scheduled_turnaround_min"), BUFFER_BUCKETS), last)
    return (
        delayed.groupBy(bucket.alias("bucket_order"))
        .agg(
            count_rows().alias("n_links"),
            mean_of(F.col("prior_leg_arr_delay_minutes")).alias("avg_prior_leg_delay_minutes"),
            mean_of(F.col("dep_delay_minutes")).alias("avg_current_dep_delay_minutes"),
            pct_of_rows(late_departure(F.col("dep_delay_minutes"))).alias("downstream_delay_rate_pct"),
        )
        .select(
            "bucket_order",
            bin_label(F.col("bucket_order"), BUFFER_BUCKETS).alias("buffer_bucket_minutes"),
            "n_links", "avg_prior_leg_delay_minutes", "avg_current_dep_delay_minutes", "downstream_delay_rate_pct",
        )
        .orderBy("bucket_order")
    )
