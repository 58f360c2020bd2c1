"""Delay carried along chains: the scan equals the recursion, however tails are cut."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from turnline.operators import chains
from turnline.operators.rotation import VALID, build_links, legs_of, with_utc_times
from turnline.operators.sequence import hot_keys
from turnline.sources.lineitem import airports

KEY = ("tail_number", "flight_date", "flight_number", "origin", "dest", "crs_dep_time")


def recursion(rows):
    """Carried minutes and links of one aircraft's legs in order, one after the other."""
    carried, legs, before = 0, 0, None
    for r in rows:
        own = None if before is None or before.arr_delay_minutes is None else max(
            0, before.arr_delay_minutes - (before.late_aircraft_delay or 0))
        if r.link_status != VALID or own is None or r.scheduled_turnaround_min is None:
            carried, legs = 0, 0
        else:
            carried += own - r.scheduled_turnaround_min
            carried, legs = (carried, legs + 1) if carried > 0 else (0, 0)
        yield r, carried, legs
        before = r


@pytest.mark.parametrize("hot_rows", [10**9, 500, 0])
def test_scan_is_the_recursion(spark, flights, hot_rows):
    # Short turnarounds and long delays on a third of all legs, in one tail, so that delays travel.
    skewed = flights.withColumns({
        "tail_number": F.when(F.col("flight_number") % 3 == 0, "HOT").otherwise(F.col("tail_number")),
        "arr_delay_minutes": F.when(F.col("distance") % 2 == 0, F.col("arr_delay_minutes") * 40).otherwise(F.col("arr_delay_minutes")),
    })
    got = {}
    for r in chains.carried_delays(skewed, airports(spark), hot_rows).collect():
        got.setdefault(tuple(r[c] for c in KEY), []).append((r.carried_delay_min, r.legs_carried))
    legs = legs_of(skewed)
    linked = build_links(with_utc_times(legs, airports(spark)), hot=hot_keys(legs, ["tail_number"]))
    by_tail = {}
    for r in linked.orderBy("tail_number", F.col("dep_utc_scheduled").asc_nulls_first(), "flight_date", "flight_number", "crs_dep_time", "origin", "dest").collect():
        by_tail.setdefault(r.tail_number, []).append(r)
    expected, deepest = {}, 0
    for rows in by_tail.values():
        for r, carried, n in recursion(rows):
            expected.setdefault(tuple(r[c] for c in KEY), []).append((carried, n))
            deepest = max(deepest, n)
    assert deepest >= 1
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in expected.items()}


@pytest.mark.parametrize("hot_rows", [10**9, 300, 0])
def test_long_chains(spark, hot_rows):
    """Random gains and breaks, a third of them in one tail; delays travel over dozens of legs."""
    rng, start = random.Random(3), datetime(2024, 1, 1)
    rows, expected, deepest = [], {}, 0
    for tail, count in [("HOT", 1000), *[(f"N{i}", 50) for i in range(40)]]:
        carried = legs = 0
        for leg in range(count):
            valid, own, buffer = leg > 0 and rng.random() < 0.97, rng.choice([None, 0, 0, 45, 90]), rng.randrange(0, 70)
            rows.append((tail, start + timedelta(minutes=leg), start.date(), leg, VALID if valid else "suspicious_long_turnaround", own, buffer))
            if valid and own is not None:
                carried = max(0, carried + own - buffer)
                legs = legs + 1 if carried else 0
            else:
                carried = legs = 0
            expected[tail, leg], deepest = (carried, legs), max(deepest, legs)
    frame = spark.createDataFrame(
        rows, "tail_number string, dep_utc_scheduled timestamp, flight_date date, flight_number int, link_status string, "
              "prev_own_delay_min int, available_turnaround_buffer_min int").repartition(5)
    got = chains.with_carried_delay(frame, hot_keys(frame, ["tail_number"], hot_rows))
    assert {(r.tail_number, r.flight_number): (r.carried_delay_min, r.legs_carried) for r in got.collect()} == expected
    assert deepest > 10


def test_rows_by_depth(spark, flights):
    carried = chains.carried_delays(flights, airports(spark))
    total = carried.agg(F.sum("carried_delay_min")).first()[0]
    assert sum(r.carried_minutes for r in chains.by_depth(carried).collect()) == total
    assert carried.where("legs_carried > 0 and carried_delay_min = 0 or legs_carried = 0 and carried_delay_min > 0").isEmpty()
