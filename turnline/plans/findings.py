"""The headline findings over flights and links in one frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnline.plans import analysis, propagation, views

# What is taken from each one-row dataset.
OF_FLIGHTS = {
    analysis.delay_rate: ("delayed_flights", "delay_rate_pct"),
    analysis.arrival_delay_stats: ("avg_arr_delay_minutes", "median_arr_delay_minutes", "avg_delay_minutes_when_late"),
    analysis.cancellation_rate: ("total_flights", "cancellation_rate_pct"),
}
OF_LINKS = {
    propagation.link_coverage: ("tail_known_flights", "valid_links", "valid_pct"),
    propagation.compare_signals: ("corr_prior_delay", "corr_estimate", "agreement_pct", "a_present_flagged_by_b_pct"),
}


def headline_findings(flights: DataFrame, links: DataFrame) -> DataFrame:
    """Rows ``finding``, ``part`` (of what, where there are several), ``value``.

    Network size and delay, delay causes, link coverage, agreement of both signals, and the downstream delay rate by
    scheduled buffer.  Every part is aggregated by itself; only these few rows are put together.
    """

    def one_row(plan, table: DataFrame, names: tuple[str, ...]) -> DataFrame:
        row = plan(table).select(*[F.col(name).cast("double").alias(name) for name in names])
        return row.unpivot([], list(names), "finding", "value").select("finding", F.lit(None).cast("string").alias("part"), "value")

    def by_part(rows: DataFrame, finding: str, part: str, value: Column) -> DataFrame:
        return rows.select(F.lit(finding).alias("finding"), F.col(part).alias("part"), value.cast("double").alias("value"))

    parts = [
        *[one_row(plan, flights, names) for plan, names in OF_FLIGHTS.items()],
        *[one_row(plan, links, names) for plan, names in OF_LINKS.items()],
        by_part(views.delay_cause_performance(flights), "cause_share_pct", "cause", F.col("pct_of_total_delay_minutes")),
        by_part(views.turnaround_buffer_performance(links), "downstream_delay_rate_pct", "buffer_bucket_minutes",
                F.col("downstream_delay_rate_pct")),
    ]
    whole, *rest = parts
    for some in rest:
        whole = whole.unionByName(some)
    return whole
