"""Sessions against a plain sweep, late rows against a rebuild, and what follows from stored links."""

import random

import pytest
from pyspark.sql import functions as F

from turnline.operators import increment
from turnline.operators.rotation import rotation_links
from turnline.operators.sessions import merged, sessions
from turnline.plans import spans
from turnline.sources.lineitem import airports

SCHEMA = "k string, s long, e long, n long"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    out = []
    for i in range(1500):
        s = rng.randrange(-3000, 60_000)
        out.append(("HOT" if i % 3 == 0 else f"k{i % 40}", s, s + rng.choice([0, 5, 30, 400]), 1))
    return out + out[:50] + [("k1", None, 5, 1), (None, 1, 2, 1), ("k2", 7, None, 1)]


def plain(rows, gap):
    out, last = [], {}
    for k, s, e, n in sorted((r for r in rows if None not in r), key=lambda r: r[:3]):
        if k in last and s - last[k][2] <= gap:
            last[k][2], last[k][3] = max(last[k][2], e), last[k][3] + n
        else:
            last[k] = [k, s, e, n]
            out.append(last[k])
    return sorted(map(tuple, out))


def found(frame):
    return sorted(tuple(r) for r in frame.select("k", "s", "e", "n").collect())


@pytest.mark.parametrize("hot_rows", [10**9, 200, 0])
@pytest.mark.parametrize("gap", [0, 60, 2000])
def test_sessions_are_the_plain_sweep(spark, rows, hot_rows, gap):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert found(sessions(frame, ["k"], "s", "e", gap, {"n": F.sum("n")}, hot_rows)) == plain(rows, gap)


@pytest.mark.parametrize("hot_rows", [10**9, 100])
def test_late_rows_give_what_a_rebuild_gives(spark, rows, hot_rows):
    first, late = [r for i, r in enumerate(rows) if i % 5], [r for i, r in enumerate(rows) if i % 5 == 0]
    late = [r for r in late if r[0] in ("HOT", "k1", "k2", "k3", None)] + [("new", 1, 2, 1)]
    stored = spark.createDataFrame(plain(first, 60), SCHEMA)
    got = merged(stored, spark.createDataFrame(late, SCHEMA), ["k"], "s", "e", 60, ["n"], hot_rows)
    assert found(got) == plain(first + late, 60)
    assert found(merged(stored, spark.createDataFrame([], SCHEMA), ["k"], "s", "e", 60, ["n"])) == plain(first, 60)


def test_duty_chains_hold_every_leg_once(spark, flights):
    legs = spans.leg_spans(flights, airports(spark))
    chains = spans.duty_chains(legs)
    assert chains.agg(F.sum("legs"), F.sum("block_minutes")).first() == legs.agg(F.sum("legs"), F.sum("block_minutes")).first()


@pytest.mark.parametrize("hot_rows", [10**9, 200])
@pytest.mark.parametrize("second", [
    "flight_date >= '2024-08-01'", "flight_number % 3 = 0", "flight_date >= '2024-08-01' or flight_number % 211 = 0", "true", "false",
])
def test_links_after_a_load_are_those_of_a_rebuild(spark, flights, second, hot_rows):
    where, legs = F.expr(second), increment.timed_legs(flights.where(~F.expr(second)), airports(spark))
    got = increment.links_after(
        rotation_links(flights.where(~where), airports(spark)), legs, increment.frontier(legs),
        increment.timed_legs(flights.where(where), airports(spark)), hot_rows,
    )
    full = rotation_links(flights, airports(spark))
    assert got.exceptAll(full).isEmpty() and full.exceptAll(got).isEmpty()


def test_the_frontier_moves_on(spark, flights):
    legs = increment.timed_legs(flights, airports(spark))
    early, rest = legs.where("flight_number < 130"), legs.where("flight_number >= 130")
    known = increment.frontier(early)
    assert known.count() == early.select("tail_number").distinct().count()
    moved, full = increment.later_frontier(known, rest), increment.frontier(legs)
    assert moved.exceptAll(full.select(*moved.columns)).isEmpty()
