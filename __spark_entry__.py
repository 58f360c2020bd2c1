
from __future__ import annotations

import sys
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from oracles.queries import statements  # noqa: E402
from turnline.functions.clock import epoch_minute  # noqa: E402
from turnline.operators.filters import FlightFilter  # noqa: E402
from turnline.operators.rotation import build_links, legs_of, rotation_links, with_utc_times  # noqa: E402
from turnline.operators import chains  # noqa: E402
from turnline.operators import compare, increment  # noqa: E402
from turnline.plans import analysis, catalog, findings, ground, options, propagation, quality, rankings, sketches, spans, views  # noqa: E402
from turnline.schema import FLIGHT_NAMES, LINK_NAMES  # noqa: E402
from turnline.sources import derived  # noqa: E402
from turnline.sources.flights_csv import ingest, read_raw, typed_flights, write_raw  # noqa: E402
from turnline.sources.lineitem import airports  # noqa: E402
from turnline.sources.links_csv import read_links_csv, write_links_csv  # noqa: E402
from turnline.sources.tables import candidate_months, months_pending  # noqa: E402
from turnline.streaming.windows import take_load  # noqa: E402

try:  # the text operators can be left out as a whole
    import corpus_pipeline
    from turnline.llm import queries as llm
except ImportError:
    llm = None

Query = Callable[[SparkSession, str], DataFrame]

DATES = {"start_date": "2024-03-01", "end_date": "2024-07-31"}

# One filter of each kind, the parts together, and all of them.
FILTERS = {
    "dates": FlightFilter(**DATES),
    "airline": FlightFilter(airline="CA"),
    "airport": FlightFilter(airport="CAA"),
    "route": FlightFilter(route="CAA-HAA"),
    "combined": FlightFilter(**DATES, airline="CA", airport="CAA"),
    "all": FlightFilter(**DATES, airline="CA", airport="CAA", route="CAA-HAA"),
}


def entry(spark: SparkSession) -> DataFrame:
    """The network summary at the smallest scale."""
    return queries()["network_summary"](spark, "/root/testdata/sf0.001")


def _on_flights(plan: Callable[..., DataFrame], **settings) -> Query:
    return lambda spark, sf_dir: plan(derived.flights(spark, sf_dir), **settings)


def _on_links(plan: Callable[..., DataFrame], **settings) -> Query:
    return lambda spark, sf_dir: plan(derived.links(spark, sf_dir), **settings)


def _on_both(plan: Callable[..., DataFrame], **settings) -> Query:
    return lambda spark, sf_dir: plan(derived.flights(spark, sf_dir), derived.links(spark, sf_dir), **settings)


def _scratch(spark: SparkSession, sf_dir: str, name: str) -> str:
    path = derived.scratch_path(spark, sf_dir, name)
    if path is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    return f"{path}-{uuid.uuid4().hex}"  # no call overwrites what another reads


def _raw_extracts(spark: SparkSession, sf_dir: str) -> str:
    """The derived flights written as raw monthly extracts, in a folder of the call's own; returns the glob over them."""
    path = _scratch(spark, sf_dir, "raw_extracts")
    write_raw(derived.flights(spark, sf_dir), path)
    return f"{path}/month=*/*.csv"


def flights_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed_flights(read_raw(spark, _raw_extracts(spark, sf_dir)))


def flights_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw extracts loaded twice into the stored table; the second load adds nothing."""
    extracts, target = _raw_extracts(spark, sf_dir), _scratch(spark, sf_dir, "ingested")
    ingest(spark, extracts, target)
    return ingest(spark, extracts, target).select(*FLIGHT_NAMES)


def utc_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    legs = with_utc_times(legs_of(derived.flights(spark, sf_dir)), airports(spark))
    instants = ("dep_utc_scheduled", "arr_utc_scheduled", "dep_utc_actual", "arr_utc_actual")
    return legs.select(
        "tail_number", "flight_date", "flight_number", "origin", "dest", "crs_dep_time", "origin_tz",
        *[epoch_minute(F.col(name)).alias(f"{name}_min") for name in instants],
    )


def rotation_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The link table built from the stored flights, not read back."""
    return rotation_links(derived.flights(spark, sf_dir), airports(spark))


def links_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark, sf_dir, "links_csv")
    write_links_csv(derived.links(spark, sf_dir), path)
    return read_links_csv(spark, path)


def pending_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return months_pending(candidate_months(spark, 2024, 2025), derived.flights(spark, sf_dir))


def sql_airport_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog.register_views(derived.flights(spark, sf_dir), derived.links(spark, sf_dir))
    return catalog.run_query(
        spark,
        """SELECT airport, total_flights, delay_rate_pct FROM v_airport_performance
           WHERE meets_min_volume_threshold AND delay_rate_pct >= :min_rate""",
        {"min_rate": 30.0},
    )


def last_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ground.last_arrivals(derived.flights(spark, sf_dir), airports(spark))


def carried_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.carried_delays(derived.flights(spark, sf_dir), airports(spark))


def carried_delay_by_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.by_depth(carried_delays(spark, sf_dir))


def duty_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.duty_chains(spans.leg_spans(derived.flights(spark, sf_dir), airports(spark)))


def duty_chains_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of most legs, stored, and then of the legs that came late."""
    every = spans.leg_spans(derived.flights(spark, sf_dir), airports(spark))
    path = _scratch(spark, sf_dir, "duty_chains")
    spans.duty_chains(every.where("flight_number % 7 <> 0")).write.parquet(path)
    return spans.duty_chains_after(spark.read.parquet(path), every.where("flight_number % 7 = 0"))


def links_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of what was loaded first, then of a second load: later months, and some legs that came late."""
    flights = derived.flights(spark, sf_dir)
    second = F.coalesce(F.col("flight_date") >= F.lit("2024-09-01").cast("date"), F.lit(False)) | (F.col("flight_number") % 401 == 0)
    path = _scratch(spark, sf_dir, "links_by_month")
    before = increment.timed_legs(flights.where(~second), airports(spark))
    before.write.parquet(f"{path}/legs")
    legs = spark.read.parquet(f"{path}/legs")
    increment.frontier(legs).write.parquet(f"{path}/frontier")
    build_links(legs).select(*LINK_NAMES).write.parquet(f"{path}/links")
    increment.timed_legs(flights.where(second), airports(spark)).write.parquet(f"{path}/new_legs")
    return increment.links_after(
        spark.read.parquet(f"{path}/links"), legs, spark.read.parquet(f"{path}/frontier"), spark.read.parquet(f"{path}/new_legs"),
    )


def sketch_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of every month, stored, merged, and held against exact counts."""
    flights, path = derived.flights(spark, sf_dir), _scratch(spark, sf_dir, "sketches")
    sketches.monthly_sketches(flights).write.parquet(path)
    return sketches.compared(spark.read.parquet(path), flights)


def streamed_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that closed after three loads, in each of which some flights of the load before come late."""
    flights, path = derived.flights(spark, sf_dir), _scratch(spark, sf_dir, "streamed")
    date, late = F.col("flight_date"), F.col("flight_number") % 50 == 0
    load = F.when(date < F.lit("2024-05-01").cast("date"), 1).when(date < F.lit("2024-09-01").cast("date"), 2).otherwise(3)
    loads = flights.withColumn("_load", F.least(F.lit(3), load + late.cast("int")))
    for number in (1, 2, 3):
        loads.where(F.col("_load") == number).select(*FLIGHT_NAMES).write.mode("append").parquet(f"{path}/source")
        take_load(spark, f"{path}/source", f"{path}/windows", f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/windows")


def _second_load(flights: DataFrame) -> DataFrame:
    """The flights as a later load might give them: some gone, some twice, some with another delay."""
    number = F.col("flight_number")
    kept = flights.where(number % 97 != 0)
    changed = kept.withColumn("arr_delay_minutes", F.when(number % 89 == 0, F.col("arr_delay_minutes") + 1).otherwise(F.col("arr_delay_minutes")))
    return changed.unionByName(changed.where(number % 83 == 0))


def loads_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    flights = derived.flights(spark, sf_dir)
    return compare.bag_difference(flights, _second_load(flights), FLIGHT_NAMES, (*quality.FLIGHT_KEY, "tail_number", "arr_delay_minutes"))


def loads_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    flights = derived.flights(spark, sf_dir)
    by_key = compare.keyed_difference(flights, _second_load(flights), quality.FLIGHT_KEY, FLIGHT_NAMES)
    return by_key.groupBy("state").agg(
        F.count("*").alias("flight_keys"), F.sum("removed").alias("removed_rows"), F.sum("added").alias("added_rows"), F.sum("kept").alias("kept_rows")
    )


def _on_stays(plan: Callable[..., DataFrame]) -> Query:
    return lambda spark, sf_dir: plan(derived.stays(spark, sf_dir))


def queries() -> dict[str, Query]:
    on_flights = {
        "overall_volume": analysis.overall_volume,
        "monthly_volume": analysis.monthly_volume,
        "delay_rate": analysis.delay_rate,
        "arrival_delay_stats": analysis.arrival_delay_stats,
        "cancellation_rate": analysis.cancellation_rate,
        "cancellation_by_reason": analysis.cancellation_by_reason,
        "delay_cause_share": analysis.delay_cause_share,
        "airport_delay_top20": analysis.airport_delay_top20,
        "route_delay_top20": analysis.route_delay_top20,
        "day_of_week": analysis.day_of_week,
        "hour_of_day": analysis.hour_of_day_pattern,
        "late_aircraft_dominant": analysis.late_aircraft_dominant,
        "late_aircraft_share_by_hour": analysis.late_aircraft_share_by_hour,
        "dep_arr_correlation": analysis.dep_arr_correlation,
        "inflight_recovery": analysis.inflight_recovery,
        "delay_cause_performance": views.delay_cause_performance,
        "cause_ranking": rankings.cause_ranking,
        "filter_options_bounds": options.filter_bounds,
        "filter_options_airlines": options.filter_airlines,
        "filter_options_airports": options.filter_airports,
        "filter_options_routes": options.filter_routes,
        "dq_month_coverage": quality.month_coverage,
        "dq_required_nulls": quality.required_nulls,
        "dq_nullable_profile": quality.nullable_profile,
        "dq_full_row_duplicates": quality.full_row_duplicates,
        "dq_key_duplicates": quality.key_duplicates,
        "dq_domain": quality.domain_violations,
        "dq_cause_consistency": quality.cause_consistency,
        "dq_cancel_divert": quality.cancel_divert,
        "dq_date_range": options.filter_bounds,
    }
    on_links = {
        "propagation_signal_comparison": views.propagation_signal_comparison,
        "turnaround_buffer_performance": views.turnaround_buffer_performance,
        "link_status_counts": propagation.link_status_counts,
        "link_coverage": propagation.link_coverage,
        "compare_signals": propagation.compare_signals,
        "downstream_vs_prior": propagation.downstream_vs_prior,
        "prior_dep_correlation": propagation.prior_dep_correlation,
        "buffer_effect": propagation.buffer_effect,
        "propagation_by_hour": propagation.propagation_by_hour,
        "propagation_by_airport": propagation.propagation_by_airport,
        "propagation_by_route": propagation.propagation_by_route,
        "turnaround_profile": rankings.turnaround_profile,
        "signal_agreement_matrix": rankings.signal_agreement_matrix,
        "dq_required_link_nulls": quality.required_link_nulls,
        "dq_link_status": quality.link_status_report,
        "dq_valid_link_invariants": quality.valid_link_invariants,
    }
    on_both = {
        "network_summary": views.network_summary,
        "airport_performance": views.airport_performance,
        "route_performance": views.route_performance,
        "hour_of_day_performance": views.hour_of_day_performance,
        "top_airports_by_delay_rate": rankings.top_airports_by_delay_rate,
        "top_routes_by_delay_rate": rankings.top_routes_by_delay_rate,
        "hourly_delay_profile": rankings.hourly_delay_profile,
        "hourly_signals": rankings.hourly_signals,
        "airport_propagation_rankings": rankings.airport_propagation_rankings,
        "dq_summary": quality.summary,
        "dq_report": quality.report,
        "headline_findings": findings.headline_findings,
    }
    filtered = {
        **{f"filtered_network_{name}": _on_both(views.network_summary, flt=flt) for name, flt in FILTERS.items()},
        "filtered_airports": _on_both(views.airport_performance, flt=FILTERS["dates"]),
        "filtered_routes": _on_both(views.route_performance, flt=FILTERS["airline"]),
        "filtered_hourly": _on_both(views.hour_of_day_performance, flt=FILTERS["airport"]),
        "filtered_causes": _on_flights(views.delay_cause_performance, flt=FILTERS["route"]),
        "filtered_propagation": _on_links(views.propagation_signal_comparison, flt=FILTERS["combined"]),
        "filtered_turnaround": _on_links(views.turnaround_buffer_performance, flt=FILTERS["dates"]),
    }
    return {
        "flights_typed": flights_typed,
        "flights_ingest": flights_ingest,
        "months_pending": pending_months,
        "utc_times": utc_times,
        "rotation_links": rotation_build,
        "links_csv": links_csv,
        **{name: _on_flights(plan) for name, plan in on_flights.items()},
        **{name: _on_links(plan) for name, plan in on_links.items()},
        **{name: _on_both(plan) for name, plan in on_both.items()},
        **filtered,
        "last_arrivals": last_arrivals,
        "ground_overlaps": _on_stays(ground.ground_overlaps),
        "overlaps_by_airport": _on_stays(ground.overlaps_by_airport),
        "ground_presence": _on_stays(ground.ground_presence),
        "ground_peaks": _on_stays(ground.ground_peaks),
        "carried_delays": carried_delays,
        "duty_chains": duty_chains,
        "duty_chains_merged": duty_chains_merged,
        "links_by_month": links_by_month,
        "loads_difference": loads_difference,
        "loads_by_key": loads_by_key,
        "sketch_errors": sketch_errors,
        "streamed_days": streamed_days,
        "moving_delay_rate": _on_flights(spans.moving_delay_rate),
        "kpi_cube": _on_flights(spans.kpi_cube),
        "route_percent_ranks": _on_flights(spans.route_percent_ranks),
        "carried_delay_by_depth": carried_delay_by_depth,
        "sql_airport_report": sql_airport_report,
        **({**llm.queries(), "pipeline": corpus_pipeline.run} if llm else {}),
    }


def oracle_sql() -> dict[str, str]:
    return {**statements(), **(llm.oracle_sql() if llm else {})}
