"""The rows behind the charts: rankings, profiles and the signal matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnline.functions.labels import CAUSE_LABELS, lookup
from turnline.operators.filters import narrowed
from turnline.operators.rotation import valid_links
from turnline.operators.topk import ranked_top_k, top_k
from turnline.plans.views import (
    Filter, airport_performance, delay_cause_performance, hour_of_day_performance, route_performance,
    turnaround_buffer_performance,
)

# Rows shown by the delay-rate charts and by the propagation charts.
TOP_BY_DELAY_RATE = 15
TOP_BY_PROPAGATION = 10


def route_label() -> Column:
    return F.concat_ws(" → ", "origin", "dest")


def top_airports_by_delay_rate(
    flights: DataFrame, links: DataFrame, flt: Filter = None, k: int = TOP_BY_DELAY_RATE
) -> DataFrame:
    ranked = airport_performance(flights, links, flt).where("meets_min_volume_threshold")
    return top_k(ranked, "delay_rate_pct", ["airport"], k).select(
        "airport", "delay_rate_pct", "total_flights", "avg_delay_minutes"
    )


def top_routes_by_delay_rate(
    flights: DataFrame, links: DataFrame, flt: Filter = None, k: int = TOP_BY_DELAY_RATE
) -> DataFrame:
    ranked = route_performance(flights, links, flt).where("meets_min_volume_threshold")
    return top_k(ranked, "delay_rate_pct", ["origin", "dest"], k).select(
        route_label().alias("route"), "delay_rate_pct", "total_flights", "avg_delay_minutes"
    )


def cause_ranking(flights: DataFrame, flt: Filter = None) -> DataFrame:
    causes = delay_cause_performance(flights, flt)
    ranked = ranked_top_k(causes, "minutes", ["cause"], len(CAUSE_LABELS), "minutes")
    return ranked.select(
        "rank", "cause", lookup(F.col("cause"), CAUSE_LABELS).alias("label"),
        "minutes", "pct_of_total_delay_minutes",
    )


def hourly_delay_profile(flights: DataFrame, links: DataFrame, flt: Filter = None) -> DataFrame:
    return hour_of_day_performance(flights, links, flt).select(
        "scheduled_dep_hour", "delay_rate_pct", "avg_delay_minutes"
    )


def hourly_signals(flights: DataFrame, links: DataFrame, flt: Filter = None) -> DataFrame:
    return hour_of_day_performance(flights, links, flt).select(
        "scheduled_dep_hour", "signal_a_late_aircraft_share_pct", "signal_b_propagation_rate_pct"
    )


def turnaround_profile(links: DataFrame, flt: Filter = None) -> DataFrame:
    return turnaround_buffer_performance(links, flt).select(
        "bucket_order", "buffer_bucket_minutes", "downstream_delay_rate_pct", "n_links",
        "avg_prior_leg_delay_minutes",
    )


def airport_propagation_rankings(
    flights: DataFrame, links: DataFrame, flt: Filter = None, k: int = TOP_BY_PROPAGATION
) -> DataFrame:
    """Airports by total and by average propagated delay, in long form."""
    airports = airport_performance(flights, links, flt).where("meets_min_volume_threshold")
    total, average = "signal_b_propagated_delay_minutes", "signal_b_avg_propagated_delay_minutes"
    rankings = ranked_top_k(airports, total, ["airport"], k, "total").unionByName(
        ranked_top_k(airports, average, ["airport"], k, "average")
    )
    return rankings.select("ranking", "rank", "airport", total, average)


def signal_agreement_matrix(links: DataFrame, flt: Filter = None) -> DataFrame:
    """Valid links by reported signal (rows) and reconstructed signal (columns); both rows always appear."""
    a = F.coalesce(F.col("late_aircraft_delay") > 0, F.lit(False))
    b = F.coalesce(F.col("propagated_delay_estimate_min") > 0, F.lit(False))

    def row(name: str, reported: Column) -> Column:
        return F.struct(
            F.lit(name).alias("signal_a"),
            F.count_if(reported & b).alias("signal_b_present"),
            F.count_if(reported & ~b).alias("signal_b_absent"),
        )

    cells = valid_links(narrowed(links, flt)).agg(F.array(row("present", a), row("absent", ~a)).alias("cells"))
    return cells.select(F.inline("cells"))
