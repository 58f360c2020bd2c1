"""The KPI blocks of flights and of links, each defined once.

Both reduce to additive totals, so Spark sums them before the shuffle and only
one small row per group and task travels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnline.functions.numeric import count_rows, mean_of, pct, pct_of_rows
from turnline.operators.rotation import valid_links
from turnline.schema import DELAY_CAUSES

FLIGHT_KPIS = (
    "total_flights", "delayed_flights", "delay_rate_pct", "total_delay_minutes", "avg_delay_minutes",
    "signal_a_late_aircraft_delay_minutes", "signal_a_late_aircraft_share_pct",
)
LINK_KPIS = (
    "signal_b_valid_links", "signal_b_propagation_rate_pct", "signal_b_propagated_delay_minutes",
    "signal_b_avg_propagated_delay_minutes",
)


def all_causes() -> Column:
    """Minutes of the five causes of a flight together, null unless all are reported."""
    first, *rest = DELAY_CAUSES
    total = F.col(first).cast("bigint")
    for name in rest:
        total = total + F.col(name)
    return total


def delay_rate(digits: int = 2) -> Column:
    """Aggregate: share of arrived flights that were at least 15 minutes late."""
    return pct(F.count_if("arr_del15"), F.count("arr_del15"), digits)


def late_aircraft_share() -> Column:
    """Aggregate: late-aircraft minutes among all attributed delay minutes."""
    return pct(F.sum("late_aircraft_delay"), F.sum(all_causes()))


def flight_kpis(flights: DataFrame, keys: Sequence[Column] = ()) -> DataFrame:
    return flights.groupBy(*keys).agg(
        count_rows().alias("total_flights"),
        F.count_if("arr_del15").alias("delayed_flights"),
        delay_rate().alias("delay_rate_pct"),
        F.sum("arr_delay_minutes").alias("total_delay_minutes"),
        mean_of(F.col("arr_delay_minutes")).alias("avg_delay_minutes"),
        F.sum("late_aircraft_delay").alias("signal_a_late_aircraft_delay_minutes"),
        late_aircraft_share().alias("signal_a_late_aircraft_share_pct"),
    )


def link_kpis(links: DataFrame, keys: Sequence[Column] = ()) -> DataFrame:
    """KPIs over valid links; a group without any has no row."""
    estimate = F.col("propagated_delay_estimate_min")
    return valid_links(links).groupBy(*keys).agg(
        count_rows().alias("signal_b_valid_links"),
        pct_of_rows(estimate > 0).alias("signal_b_propagation_rate_pct"),
        F.sum(estimate).alias("signal_b_propagated_delay_minutes"),
        mean_of(estimate).alias("signal_b_avg_propagated_delay_minutes"),
    )


def joined_kpis(flights: DataFrame, links: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Flight and link KPIs side by side; both sides are aggregated before they meet.

    A group without valid links shows zero of them and zero propagated minutes.
    """
    by = [value.alias(name) for name, value in keys.items()]
    return (
        flight_kpis(flights, by)
        .join(link_kpis(links, by), list(keys), "left")
        .fillna(0, ["signal_b_valid_links", "signal_b_propagated_delay_minutes"])
    )
