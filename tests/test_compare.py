"""Load differences against EXCEPT ALL, percent ranks against one window, and rows of grouping sets."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from turnline.functions.clock import local_to_utc
from turnline.operators import compare
from turnline.plans import quality, spans

ROWS = [(1, "a"), (1, "a"), (1, "b"), (2, None), (2, None), (3, "c"), (None, "x"), (4, "d"), (4, "e")]
LATER = [(1, "a"), (1, "b"), (1, "b"), (2, None), (3, "c"), (None, "x"), (None, "x"), (5, "f"), (4, "d"), (4, "e")]


@pytest.fixture(scope="module")
def loads(spark):
    return spark.createDataFrame(ROWS, "k int, v string"), spark.createDataFrame(LATER, "k int, v string")


def test_bag_difference_is_except_all(loads):
    old, new = loads
    counts = {(r.k, r.v): (r.n_before, r.n_after) for r in compare.bag_difference(old, new, ["k", "v"]).collect()}
    assert counts == {(1, "a"): (2, 1), (1, "b"): (1, 2), (2, None): (2, 1), (None, "x"): (1, 2), (5, "f"): (0, 1)}
    gone = sorted(map(tuple, old.exceptAll(new).collect()), key=str)
    assert gone == sorted((k for k, (a, b) in counts.items() for _ in range(a - b)), key=str)


def test_columns_not_shown_still_tell_rows_apart_and_travel_as_hashes(spark):
    kind = "k int, v string, w int, a array<int>"
    old = spark.createDataFrame([(1, "a", None, [1, None]), (1, None, 2, [1]), (1, "ab", 3, None), (2, "x", 1, [1]), (2, "x", 1, [1])], kind)
    new = spark.createDataFrame([(1, "a", None, [None, 1]), (1, "2", None, [1]), (1, "ab", 3, None), (2, "x", 1, [1])], kind)
    whole = compare.bag_difference(old, new, old.columns)
    some = compare.bag_difference(old, new, old.columns, ["k"])
    assert sorted(map(tuple, some.collect())) == sorted((r.k, r.n_before, r.n_after) for r in whole.collect())
    assert some.count() == 5
    row = compare.keyed_difference(old, new, ["k"], old.columns).where("k = 1").first()
    assert (row.state, row.removed, row.added, row.kept) == ("changed", 2, 2, 1)
    shuffled = [line for line in compare.keyed_difference(old, new, ["k"], ["k", "v", "w"])._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in line]
    assert shuffled and not any(" v#" in line or " w#" in line for line in shuffled)


def test_keyed_difference(loads):
    got = {r.k: (r.state, r.removed, r.added, r.kept) for r in compare.keyed_difference(*loads, ["k"], ["k", "v"]).collect()}
    assert got == {1: ("changed", 1, 1, 2), 2: ("changed", 1, 0, 1), 3: ("unchanged", 0, 0, 1), None: ("changed", 0, 1, 1),
                   4: ("unchanged", 0, 0, 2), 5: ("added", 0, 1, 0)}
    assert compare.keyed_difference(loads[0], loads[0], ["k"], ["k", "v"]).where("state <> 'unchanged'").isEmpty()


@pytest.mark.parametrize("ranges", [2, 5, 256])
def test_percent_rank_is_the_one_window(spark, monkeypatch, ranges):
    monkeypatch.setattr(compare, "RANGES", ranges)
    rows = spark.range(3000).select(
        "id", F.when(F.col("id") % 97 != 0, (F.pmod(F.xxhash64("id"), F.lit(500)) - 200) / 4).alias("v"))
    rows = rows.withColumn("v", F.when(F.col("id") % 3 == 0, 1.25).otherwise(F.col("v")))  # a third of all rows is equal
    window = Window.orderBy("v")
    expected = {r.id: (r.a, r.b) for r in rows.select("id", F.rank().over(window).alias("a"), F.percent_rank().over(window).alias("b")).collect()}
    got = compare.with_percent_rank(rows, "v")
    assert {r.id: (r["rank"], r.percent_rank) for r in got.collect()} == expected
    assert compare.with_percent_rank(rows.limit(0), "v").isEmpty()
    assert compare.with_percent_rank(rows.where("id = 5"), "v").first().percent_rank == 0.0


def test_totals_are_told_from_nulls(spark, flights):
    some = flights.limit(50).unionByName(flights.limit(3).withColumn("flight_date", F.lit(None).cast("date")))
    months = quality.month_coverage(some).collect()
    assert sorted(r.flights for r in months if r.month is None) == [3, 53]
    assert [r.flights for r in months if r.is_total] == [53]
    cube = spans.kpi_cube(some)
    assert cube.where("grouping_id = 7").first().total_flights == 53
    assert cube.where("grouping_id = 6 and month is null").first().total_flights == 3
    for level in range(8):
        assert cube.where(F.col("grouping_id") == level).agg(F.sum("total_flights")).first()[0] == 53


def test_duplicates_with_nulls_in_different_columns(spark, flights):
    one = flights.where("tail_number is not null").limit(1)
    rows = one.unionByName(one).unionByName(one.withColumn("tail_number", F.lit(None).cast("string")))
    shifted = one.withColumns({"origin": F.col("tail_number"), "tail_number": F.lit(None).cast("string")})
    assert quality.full_row_duplicates(rows.unionByName(shifted)).first().duplicate_rows == 1


def test_local_to_utc_as_one_expression(spark):
    rows = [("2024-03-10 02:30", "America/New_York", None), ("2024-11-03 01:30", "America/New_York", None),
            ("2024-03-10 03:00", "America/New_York", "2024-03-10 07:00"), ("2024-11-03 02:00", "America/New_York", "2024-11-03 07:00"),
            ("2024-07-01 12:00", "America/Phoenix", "2024-07-01 19:00"), ("2024-07-01 12:00", None, None)]
    frame = spark.createDataFrame(rows, "wall string, tz string, utc string")
    instant = local_to_utc(F.unix_seconds(F.col("wall").cast("timestamp")), F.col("tz"))
    for r in frame.withColumn("got", F.date_format(instant, "yyyy-MM-dd HH:mm")).collect():
        assert r.got == r.utc


def test_set_aside_rows_and_the_others_are_all_rows(spark, flights):
    some = flights.limit(20).withColumns({
        "origin": F.when(F.col("flight_number") % 2 == 0, F.col("origin")), "distance": F.when(F.col("flight_number") % 3 == 0, F.col("distance"))})
    some = spark.createDataFrame(some.collect(), some.schema)
    whole, lacking = quality.set_aside(some)
    assert whole.columns == flights.columns and whole.count() + lacking.count() == 20
    assert whole.where("flight_number % 6 <> 0").isEmpty()
    for r in lacking.collect():
        assert r.missing == ",".join(n for n, d in (("origin", 2), ("distance", 3)) if r.flight_number % d)
