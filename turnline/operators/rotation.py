"""Aircraft rotations: each flight linked to the same aircraft's flight before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnline.functions.clock import day_offsets, minutes_between, plus_minutes, wall_clock, with_local_to_utc
from turnline.functions.numeric import int_div
from turnline.operators.sequence import HOT_ROWS, hot_keys, with_previous
from turnline.schema import LINK_NAMES

# Plausible range of a turnaround, in minutes, both ends included.
MIN_TURNAROUND_MIN = 15
MAX_TURNAROUND_MIN = 36 * 60

VALID = "valid"

# The flight columns a rotation needs.
LEG_COLUMNS = (
    "tail_number", "flight_date", "reporting_airline", "flight_number", "origin", "dest",
    "crs_dep_time", "crs_elapsed_time", "actual_elapsed_time", "dep_delay_minutes",
    "arr_delay_minutes", "cancelled", "diverted", "late_aircraft_delay",
)

# What a link takes from the leg before.
CARRIED = (
    "flight_date", "flight_number", "origin", "dest", "arr_delay_minutes", "cancelled", "diverted",
    "arr_utc_scheduled", "arr_utc_actual",
)

LEG_ORDER = ("dep_utc_scheduled", "flight_date", "flight_number", "crs_dep_time", "origin", "dest")

# Whatever else reaches a link settles ties, so that a task that runs again orders
# alike.  Columns the links do not need stay out: the sort key is shuffled.
TIE_BREAKS = (
    "reporting_airline", "dep_delay_minutes", "arr_delay_minutes", "late_aircraft_delay",
    "cancelled", "diverted", "arr_utc_scheduled", "arr_utc_actual",
)

# Width of the time slices a hot tail is cut into.
SLICE_SECONDS = 600

# The zone calendar is broadcast up to this many rows (some 25 MB); 100 zones over 10 years have as many.
MAX_CALENDAR_ROWS = 400_000


def legs_of(flights: DataFrame) -> DataFrame:
    """The flights whose aircraft is known, cut to the columns a rotation needs."""
    return flights.where(F.col("tail_number").isNotNull()).select(*LEG_COLUMNS)


def zone_calendar(flights: DataFrame) -> DataFrame:
    """The (zone, date) pairs that occur among placed flights, with the UTC offsets around the date."""
    pairs = flights.select("origin_tz", "flight_date").dropna().distinct()
    return pairs.withColumns(day_offsets(F.col("flight_date"), F.col("origin_tz")))


def _with_day_offsets(flights: DataFrame) -> DataFrame:
    """Add the UTC offsets around the local date of each flight.

    Looking up zone rules costs more than the rest of the row, so it is done once
    per zone and date that occur, whatever stray dates there are.  The calendar is
    broadcast once its rows were counted and found few; Spark chooses the join otherwise.
    """
    calendar = zone_calendar(flights)
    if calendar.limit(MAX_CALENDAR_ROWS + 1).count() <= MAX_CALENDAR_ROWS:
        calendar = F.broadcast(calendar)
    return flights.join(calendar, ["origin_tz", "flight_date"], "left")


def with_utc_times(flights: DataFrame, airports: DataFrame) -> DataFrame:
    """Add ``origin_tz`` and the four UTC times; an unknown zone or local time leaves them null.

    Only the scheduled departure is read off a local clock.  The other three
    follow from it by reported minutes, so no calendar day has to be guessed.
    The airport dimension carries no broadcast hint: Spark broadcasts it while
    its measured size is below the session's threshold.
    """
    zones = airports.groupBy(F.col("iata").alias("origin")).agg(F.max("tz").alias("origin_tz"))
    placed = _with_day_offsets(flights.join(zones, "origin", "left"))
    wall = wall_clock(F.col("flight_date"), F.col("crs_dep_time"))
    timed = with_local_to_utc(placed, wall, "origin_tz", "dep_utc_scheduled")
    return timed.drop("early_offset", "late_offset").withColumns({
        "arr_utc_scheduled": plus_minutes(F.col("dep_utc_scheduled"), F.col("crs_elapsed_time")),
        "dep_utc_actual": plus_minutes(F.col("dep_utc_scheduled"), F.col("dep_delay_minutes")),
        "arr_utc_actual": plus_minutes(
            F.col("dep_utc_scheduled"), F.col("dep_delay_minutes") + F.col("actual_elapsed_time")
        ),
    })


def computed_once(rows: DataFrame) -> DataFrame:
    """The same rows, through a generator of one row each.

    Filters on computed columns are otherwise pushed below their computation, which then runs once per filter and again
    for the column; for the long expressions of zone arithmetic that costs more than the rest of a plan.
    """
    return rows.select(F.inline(F.array(F.struct(*rows.columns))))


def _link_status(min_turn: int, max_turn: int) -> Column:
    """The first reason that rules a link out, or ``valid``.

    Fixed values: the status names and the order in which they are tested.
    """
    observed = F.col("observed_turnaround_min")
    return (
        F.when(~F.col("has_prev"), "excluded_no_prior_flight")
        .when(F.col("prev_cancelled"), "excluded_prior_cancelled")
        .when(F.col("cancelled"), "excluded_current_cancelled")
        .when(F.col("prev_diverted"), "excluded_prior_diverted")
        .when(F.col("diverted"), "excluded_current_diverted")
        .when(F.coalesce(F.col("prev_dest") != F.col("origin"), F.lit(True)), "excluded_airport_mismatch")
        .when(F.col("scheduled_turnaround_min").isNull(), "excluded_missing_scheduled_times")
        .when(observed.isNull(), "excluded_missing_actual_times")
        .when(observed < 0, "invalid_negative_turnaround")
        .when(observed < min_turn, "suspicious_short_turnaround")
        .when(observed > max_turn, "suspicious_long_turnaround")
        .otherwise(VALID)
    )


def leg_slices() -> list[Column]:
    """What the legs of a hot tail are cut by; it rises along their order."""
    known = F.col("dep_utc_scheduled").isNotNull()
    step = int_div(F.unix_seconds("dep_utc_scheduled"), F.lit(SLICE_SECONDS))
    return [
        known,
        F.when(known, step).otherwise(F.unix_date("flight_date")),
        F.when(known, 0).otherwise(F.coalesce("flight_number", F.lit(-1))),
    ]


def build_links(
    legs: DataFrame,
    min_turn: int = MIN_TURNAROUND_MIN,
    max_turn: int = MAX_TURNAROUND_MIN,
    hot_rows: int = HOT_ROWS,
    hot: DataFrame | None = None,
    more_carried: tuple[str, ...] = (),
) -> DataFrame:
    """One link per leg: the leg before it, both turnarounds, status and carried-over delay.

    ``legs`` carries the UTC times of ``with_utc_times``.  Legs are not cut by
    calendar day, so overnight turns link.  A leg without a known departure time
    sorts to the head of its aircraft.  ``hot`` are the tails to cut into slices, if
    they are known; ``more_carried`` are further columns to take from the leg before.
    """
    order = [name for name in (*LEG_ORDER, *TIE_BREAKS) if name in legs.columns]
    if hot is None:
        hot = hot_keys(legs, ["tail_number"], hot_rows)
    linked = with_previous(legs, ["tail_number"], order, (*CARRIED, *more_carried), leg_slices(), hot)

    buffer_min = F.col("scheduled_turnaround_min")
    over = F.col("prev_arr_delay_minutes") - buffer_min
    measured = linked.withColumns({
        "scheduled_turnaround_min": minutes_between(F.col("prev_arr_utc_scheduled"), F.col("dep_utc_scheduled")),
        "observed_turnaround_min": minutes_between(F.col("prev_arr_utc_actual"), F.col("dep_utc_actual")),
    })
    return measured.withColumns({
        "link_status": _link_status(min_turn, max_turn),
        "prior_leg_arr_delay_minutes": F.col("prev_arr_delay_minutes"),
        "available_turnaround_buffer_min": buffer_min,
        "propagated_delay_estimate_min": F.when(over < 0, 0).otherwise(over),
    }).drop("has_prev")


def rotation_links(flights: DataFrame, airports: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The 18-column link table of a flights table."""
    legs = legs_of(flights)
    hot = hot_keys(legs, ["tail_number"], hot_rows)
    return build_links(with_utc_times(legs, airports), hot=hot).select(*LINK_NAMES)


def valid_links(links: DataFrame) -> DataFrame:
    return links.where(F.col("link_status") == VALID)
