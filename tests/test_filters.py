"""The filter set: default test, predicate, month pruning."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from turnline.operators.filters import FlightFilter, is_default, narrowed
from turnline.plans import views

FIRST, LAST = "2024-01-01", "2024-12-31"


@pytest.mark.parametrize("values", [{}, {"start_date": FIRST, "end_date": LAST}, {"airline": None, "route": ""}])
def test_whole_range_is_default(values):
    assert is_default(values, FIRST, LAST) is True


@pytest.mark.parametrize("values", [
    {"airline": "AA"}, {"airport": "ATL"}, {"route": "ATL-JFK"}, {"start_date": "2024-07-01"},
    {"end_date": "2024-07-31"},
])
def test_any_part_set_is_not_default(values):
    assert is_default(values, FIRST, LAST) is False


def _kept(spark, values):
    rows = [
        (1, dt.date(2024, 6, 30), "AA", "ATL", "JFK"),
        (2, dt.date(2024, 7, 1), "AA", "ATL", "JFK"),
        (3, dt.date(2024, 7, 31), "AA", "ATL", "JFK"),
        (4, dt.date(2024, 8, 1), "AA", "ATL", "JFK"),
        (5, dt.date(2024, 7, 15), "DL", "ATL", "JFK"),
        (6, dt.date(2024, 7, 15), "AA", "JFK", "ATL"),
        (7, dt.date(2024, 7, 15), "AA", "ATL", "BOS"),
    ]
    frame = spark.createDataFrame(
        rows, "i int, flight_date date, reporting_airline string, origin string, dest string")
    return {row.i for row in narrowed(frame, values).collect()}


@pytest.mark.parametrize("values,expected", [
    (None, {1, 2, 3, 4, 5, 6, 7}),
    ({}, {1, 2, 3, 4, 5, 6, 7}),
    ({"start_date": "2024-07-01", "end_date": "2024-07-31"}, {2, 3, 5, 6, 7}),
    ({"airline": "AA"}, {1, 2, 3, 4, 6, 7}),
    ({"airport": "JFK"}, {6}),
    ({"route": "ATL-BOS"}, {7}),
    ({"start_date": "2024-07-01", "end_date": "2024-07-31", "airline": "AA", "airport": "ATL",
      "route": "ATL-JFK"}, {2, 3}),
])
def test_parts_narrow_together(spark, values, expected):
    assert _kept(spark, values) == expected


def test_values_are_bound_not_pasted(spark):
    assert _kept(spark, {"airport": "ATL' OR '1'='1"}) == set()


def test_a_route_needs_two_airports(spark):
    with pytest.raises(ValueError):
        FlightFilter(route="ATL").predicate()


def test_date_range_prunes_month_folders(spark, flights):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = narrowed(flights, {"start_date": "2024-03-15", "end_date": "2024-04-10"})
    text = plan._jdf.queryExecution().executedPlan().toString()
    partition_filters = text.split("PartitionFilters: [")[1].split("], PushedFilters")[0]
    assert "202403" in partition_filters and "202404" in partition_filters
    assert plan.count() == flights.where("flight_date between '2024-03-15' and '2024-04-10'").count()


def test_empty_filter_equals_the_view(flights, links):
    for view in (views.network_summary, views.airport_performance, views.route_performance):
        assert sorted(map(tuple, view(flights, links, {}).collect())) == sorted(map(tuple, view(flights, links).collect()))


def test_links_are_filtered_after_linking(flights, links):
    route = FlightFilter(airport="CAA")
    expected = links.where((F.col("origin") == "CAA") & (F.col("link_status") == "valid")).count()
    assert expected > 0
    assert views.network_summary(flights, links, route).first().signal_b_valid_links == expected
