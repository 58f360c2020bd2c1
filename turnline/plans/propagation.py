"""How delay travels along rotations: analyses over the link table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnline.functions.clock import hour_of_day
from turnline.functions.labels import POSITIVE_BUFFER_BINS, PRIOR_DELAY_BINS, bin_label, bin_number
from turnline.functions.numeric import correlation, count_rows, mean_of, pct, pct_of_rows
from turnline.operators.rotation import VALID, valid_links
from turnline.operators.topk import top_k

# Valid links from which an airport or a route is listed, and rows listed.
MIN_AIRPORT_LINKS = 500
MIN_ROUTE_LINKS = 100
TOP_LISTED = 15

LATE_MIN = 15


def link_status_counts(links: DataFrame) -> DataFrame:
    return links.groupBy("link_status").agg(count_rows().alias("links")).orderBy(F.desc("links"), "link_status")


def link_coverage(links: DataFrame) -> DataFrame:
    """Valid links among all flights whose aircraft is known."""
    valid = F.col("link_status") == VALID
    return links.agg(
        count_rows().alias("tail_known_flights"),
        F.count_if(valid).alias("valid_links"),
        pct_of_rows(valid).alias("valid_pct"),
    )


def compare_signals(links: DataFrame) -> DataFrame:
    """Both signals on valid links; a missing signal counts as absent."""
    reported, estimate = F.col("late_aircraft_delay"), F.col("propagated_delay_estimate_min")
    a = F.coalesce(reported > 0, F.lit(False))
    b = F.coalesce(estimate > 0, F.lit(False))
    both, neither = F.count_if(a & b), F.count_if(~a & ~b)
    return valid_links(links).agg(
        count_rows().alias("valid_links"),
        F.count(reported).alias("signal_a_defined"),
        pct_of_rows(reported.isNotNull()).alias("signal_a_defined_pct"),
        F.round(correlation(F.col("prior_leg_arr_delay_minutes"), reported), 3).alias("corr_prior_delay"),
        F.round(correlation(estimate, reported), 3).alias("corr_estimate"),
        pct(both + neither, count_rows()).alias("agreement_pct"),
        both.alias("both_present"),
        neither.alias("both_absent"),
        F.count_if(~a & b).alias("b_only"),
        F.count_if(a & ~b).alias("a_only"),
        pct(both, F.count_if(a)).alias("a_present_flagged_by_b_pct"),
    )


def downstream_vs_prior(links: DataFrame) -> DataFrame:
    """Delay of the current leg by how late the prior leg came in."""
    number = bin_number(F.col("prior_leg_arr_delay_minutes"), PRIOR_DELAY_BINS).alias("bin_order")
    return (
        valid_links(links)
        .groupBy(number)
        .agg(
            count_rows().alias("n"),
            mean_of(F.col("dep_delay_minutes")).alias("avg_current_dep_delay"),
            mean_of(F.col("arr_delay_minutes")).alias("avg_current_arr_delay"),
            pct_of_rows(F.col("arr_delay_minutes") >= LATE_MIN).alias("pct_current_delayed_15"),
        )
        .where(F.col("bin_order").isNotNull())
        .withColumn("prior_delay_bucket", bin_label(F.col("bin_order"), PRIOR_DELAY_BINS))
        .orderBy("bin_order")
    )


def prior_dep_correlation(links: DataFrame) -> DataFrame:
    prior, departure = F.col("prior_leg_arr_delay_minutes"), F.col("dep_delay_minutes")
    return valid_links(links).agg(
        F.round(correlation(prior, departure), 3).alias("corr_prior_vs_dep_delay"),
        F.count_if(prior.isNotNull() & departure.isNotNull()).alias("links_used"),
    )


def buffer_effect(links: DataFrame) -> DataFrame:
    """Departure delay by positive scheduled buffer, where the prior leg came late."""
    buffer_min = F.col("scheduled_turnaround_min")
    number = bin_number(buffer_min, POSITIVE_BUFFER_BINS).alias("bin_order")
    return (
        valid_links(links)
        .where((F.col("prior_leg_arr_delay_minutes") > 0) & (buffer_min > 0))
        .groupBy(number)
        .agg(
            count_rows().alias("n"),
            mean_of(F.col("prior_leg_arr_delay_minutes")).alias("avg_prior_delay"),
            mean_of(F.col("dep_delay_minutes")).alias("avg_current_dep_delay"),
            pct_of_rows(F.col("dep_delay_minutes") >= LATE_MIN).alias("pct_current_delayed_15"),
        )
        .withColumn("buffer_bucket", bin_label(F.col("bin_order"), POSITIVE_BUFFER_BINS))
        .orderBy("bin_order")
    )


def _propagation_by(links: DataFrame, keys: Sequence[Column | str]) -> DataFrame:
    estimate = F.col("propagated_delay_estimate_min")
    return valid_links(links).groupBy(*keys).agg(
        count_rows().alias("n"),
        mean_of(estimate).alias("avg_propagated_estimate"),
        pct_of_rows(estimate > 0).alias("pct_with_propagated_delay"),
    )


def propagation_by_hour(links: DataFrame) -> DataFrame:
    return _propagation_by(links, [hour_of_day(F.col("crs_dep_time")).alias("dep_hour")]).orderBy("dep_hour")


def propagation_by_airport(links: DataFrame, min_n: int = MIN_AIRPORT_LINKS, k: int = TOP_LISTED) -> DataFrame:
    rows = _propagation_by(links, ["origin"]).where(F.col("n") >= min_n)
    return top_k(rows, "avg_propagated_estimate", ["origin"], k)


def propagation_by_route(links: DataFrame, min_n: int = MIN_ROUTE_LINKS, k: int = TOP_LISTED) -> DataFrame:
    rows = _propagation_by(links, ["origin", "dest"]).where(F.col("n") >= min_n)
    return top_k(rows, "avg_propagated_estimate", ["origin", "dest"], k)
