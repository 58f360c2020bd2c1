"""Temporary views for SQL users: the two tables and the seven views over them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from turnline.plans import views


def register_views(flights: DataFrame, links: DataFrame) -> None:
    tables = {
        "flights": flights,
        "rotation_links": links,
        "v_network_summary": views.network_summary(flights, links),
        "v_airport_performance": views.airport_performance(flights, links),
        "v_route_performance": views.route_performance(flights, links),
        "v_hour_of_day_performance": views.hour_of_day_performance(flights, links),
        "v_delay_cause_performance": views.delay_cause_performance(flights),
        "v_propagation_signal_comparison": views.propagation_signal_comparison(links),
        "v_turnaround_buffer_performance": views.turnaround_buffer_performance(links),
    }
    for name, table in tables.items():
        table.createOrReplaceTempView(name)


def run_query(spark: SparkSession, sql: str, params: Mapping | None = None) -> DataFrame:
    """SQL over the registered views; ``:name`` parameters are bound, never pasted in."""
    return spark.sql(sql, args=dict(params or {}))
