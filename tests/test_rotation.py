"""Link status cascade and the propagation estimate, on hand-made legs."""

import datetime as dt

import pytest

from turnline.operators.rotation import build_links

T0 = dt.datetime(2024, 6, 1, 12, 0)
SCHEMA = (
    "tail_number string, flight_date date, flight_number int, origin string, dest string,"
    " arr_delay_minutes int, cancelled boolean, diverted boolean, dep_utc_scheduled timestamp,"
    " dep_utc_actual timestamp, arr_utc_scheduled timestamp, arr_utc_actual timestamp"
)


def leg(origin, dest, dep, dep_actual, arr, arr_actual, delay=0, cancelled=False, diverted=False):
    """Times are minutes after T0; None is unknown."""
    at = [None if m is None else T0 + dt.timedelta(minutes=m) for m in (dep, dep_actual, arr, arr_actual)]
    date = (at[0] or T0).date()
    return (date, origin, dest, delay, cancelled, diverted, *at)


ON_TIME = leg("ATL", "JFK", 0, 0, 120, 120)
ONWARD = leg("JFK", "BOS", 180, 180, 240, 240)


def second_leg(observed, scheduled=60):
    """A leg that leaves ``observed`` minutes after ON_TIME arrived."""
    return leg("JFK", "BOS", 120 + scheduled, 120 + observed, 400, 400)


# name: (legs, status of the last leg, scheduled turnaround, prior delay, estimate)
CASES = {
    "on_time": ([ON_TIME, ONWARD], "valid", 60, 0, 0),
    "buffer_covers_delay": (
        [leg("ATL", "JFK", 0, 0, 120, 140, delay=20), leg("JFK", "BOS", 180, 200, 240, 260)], "valid", 60, 20, 0),
    "delay_exceeds_buffer": (
        [leg("ATL", "ORD", 0, 0, 120, 210, delay=90), leg("ORD", "DEN", 165, 260, 300, 390)], "valid", 45, 90, 45),
    "first_leg": ([ON_TIME], "excluded_no_prior_flight", None, None, None),
    "prior_cancelled": ([leg("ATL", "JFK", 0, 0, 120, 120, cancelled=True), ONWARD], "excluded_prior_cancelled", 60, 0, 0),
    "current_cancelled": (
        [ON_TIME, leg("JFK", "BOS", 180, 180, 240, 240, cancelled=True)], "excluded_current_cancelled", 60, 0, 0),
    "prior_diverted": ([leg("ATL", "JFK", 0, 0, 120, 120, diverted=True), ONWARD], "excluded_prior_diverted", 60, 0, 0),
    "current_diverted": (
        [ON_TIME, leg("JFK", "BOS", 180, 180, 240, 240, diverted=True)], "excluded_current_diverted", 60, 0, 0),
    "airport_mismatch": (
        [leg("ATL", "LAX", 0, 0, 120, 120), leg("SFO", "BOS", 180, 180, 240, 240)], "excluded_airport_mismatch", 60, 0, 0),
    "missing_scheduled": (
        [leg("ATL", "JFK", 0, 0, None, 120), ONWARD], "excluded_missing_scheduled_times", None, 0, None),
    "missing_actual": ([leg("ATL", "JFK", 0, 0, 120, None), ONWARD], "excluded_missing_actual_times", 60, 0, 0),
    "observed_below_zero": ([ON_TIME, second_leg(-1)], "invalid_negative_turnaround", 60, 0, 0),
    "observed_5": ([ON_TIME, leg("JFK", "BOS", 125, 125, 180, 180)], "suspicious_short_turnaround", 5, 0, 0),
    "observed_14": ([ON_TIME, second_leg(14)], "suspicious_short_turnaround", 60, 0, 0),
    "observed_15": ([ON_TIME, second_leg(15)], "valid", 60, 0, 0),
    "observed_2160": ([ON_TIME, second_leg(2160)], "valid", 60, 0, 0),
    "observed_2161": ([ON_TIME, second_leg(2161)], "suspicious_long_turnaround", 60, 0, 0),
    "observed_37_hours": ([ON_TIME, leg("JFK", "BOS", 2340, 2340, 2400, 2400)], "suspicious_long_turnaround", 2220, 0, 0),
    "overnight": (
        [leg("ATL", "JFK", 630, 630, 710, 710), leg("JFK", "BOS", 760, 760, 820, 820)], "valid", 50, 0, 0),
    "negative_buffer_adds_to_estimate": (
        [leg("ATL", "JFK", 0, 0, 120, 130, delay=10), leg("JFK", "BOS", 100, 200, 240, 300)], "valid", -20, 10, 30),
    "unknown_prior_delay": (
        [leg("ATL", "JFK", 0, 0, 120, 120, delay=None), ONWARD], "valid", 60, None, None),
    "cancelled_twice_names_the_prior": (
        [leg("ATL", "JFK", 0, 0, 120, 120, cancelled=True), leg("JFK", "BOS", 180, 180, 240, 240, cancelled=True)],
        "excluded_prior_cancelled", 60, 0, 0),
    "current_cancelled_before_mismatch": (
        [ON_TIME, leg("SFO", "BOS", 180, 180, 240, 240, cancelled=True)], "excluded_current_cancelled", 60, 0, 0),
    "mismatch_before_missing": (
        [leg("ATL", "LAX", 0, 0, None, None), ONWARD], "excluded_airport_mismatch", None, 0, None),
}


@pytest.fixture(scope="module", params=[None, 1], ids=["one window", "sliced"])
def last_legs(request, spark):
    """The last leg of each case, linked by one window and with every aircraft treated as hot."""
    rows = [
        (name, date, number, *rest)
        for name, (legs, *_) in CASES.items()
        for number, (date, *rest) in enumerate(legs, start=1)
    ]
    settings = {} if request.param is None else {"hot_rows": request.param}
    linked = build_links(spark.createDataFrame(rows, SCHEMA), **settings)
    return {(row.tail_number, row.flight_number): row for row in linked.collect()}


@pytest.mark.parametrize("name", CASES)
def test_case(last_legs, name):
    legs, status, scheduled, prior, estimate = CASES[name]
    row = last_legs[name, len(legs)]
    assert row.link_status == status
    assert row.scheduled_turnaround_min == scheduled
    assert row.prior_leg_arr_delay_minutes == prior
    assert row.propagated_delay_estimate_min == estimate


def test_unknown_departure_sorts_to_the_head(spark):
    unknown = leg("ATL", "JFK", None, None, None, None)
    rows = [("T", date, n, *rest) for n, (date, *rest) in enumerate([ON_TIME, unknown], start=1)]
    linked = {row.flight_number: row for row in build_links(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert linked[2].link_status == "excluded_no_prior_flight"
    assert linked[1].prev_flight_number == 2


def test_thresholds_are_parameters(spark):
    rows = [("T", date, n, *rest) for n, (date, *rest) in enumerate([ON_TIME, second_leg(14)], start=1)]
    frame = spark.createDataFrame(rows, SCHEMA)
    status = {r.flight_number: r.link_status for r in build_links(frame, min_turn=10).collect()}
    assert status[2] == "valid"
    status = {r.flight_number: r.link_status for r in build_links(frame, min_turn=5, max_turn=13).collect()}
    assert status[2] == "suspicious_long_turnaround"
