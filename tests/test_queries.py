"""Every registered query against its SQL counterpart, and what must hold between them."""

import pytest
from compare import connect, differences
from pyspark.sql import functions as F

import __spark_entry__ as registered
from turnline.plans import catalog, propagation, quality, rankings, views

QUERIES = registered.queries()
SQL = registered.oracle_sql()


@pytest.fixture(scope="module")
def duck(data_dir):
    connection = connect(data_dir)
    yield connection
    connection.close()


def test_every_query_of_the_survey_has_sql():
    own = {name for name in QUERIES if name != "pipeline" and not name.startswith("op")}
    assert own <= set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", SQL)
def test_query_equals_sql(spark, data_dir, duck, name):
    assert differences(QUERIES[name](spark, data_dir), duck, SQL[name]) == []


def test_entry_is_one_row(spark):
    assert registered.entry(spark).count() == 1


def test_one_link_per_flight_with_a_known_aircraft(flights, links):
    assert links.count() == flights.where("tail_number is not null").count()
    first = links.where("link_status = 'excluded_no_prior_flight'")
    assert first.count() == links.select("tail_number").distinct().count()


def test_signal_cells_add_up(links):
    row = views.propagation_signal_comparison(links).first()
    cells = row.both_signals_present + row.both_signals_absent + row.signal_a_only + row.signal_b_only
    assert cells == row.signal_b_valid_links
    matrix = {r.signal_a: (r.signal_b_present, r.signal_b_absent) for r in rankings.signal_agreement_matrix(links).collect()}
    assert matrix == {"present": (row.both_signals_present, row.signal_a_only),
                      "absent": (row.signal_b_only, row.both_signals_absent)}


def test_cause_shares_add_to_a_hundred(flights):
    shares = [r.pct_of_total_delay_minutes for r in views.delay_cause_performance(flights).collect()]
    assert len(shares) == 5 and abs(sum(shares) - 100) <= 0.03


def test_groups_add_up_to_the_network(flights, links):
    network = views.network_summary(flights, links).first()
    for view in (views.airport_performance, views.route_performance, views.hour_of_day_performance):
        row = view(flights, links).agg(
            F.sum("total_flights").alias("f"), F.sum("signal_b_valid_links").alias("l"),
            F.sum("signal_b_propagated_delay_minutes").alias("m"),
        ).first()
        assert (row.f, row.l, row.m) == (
            network.total_flights, network.signal_b_valid_links, network.signal_b_propagated_delay_minutes)


def test_an_airport_without_links_counts_zero(flights, links):
    rows = views.airport_performance(flights, links.where("origin <> 'AAA'")).where("airport = 'AAA'").first()
    assert (rows.signal_b_valid_links, rows.signal_b_propagated_delay_minutes) == (0, 0)
    assert rows.signal_b_propagation_rate_pct is None and rows.signal_b_avg_propagated_delay_minutes is None


def test_views_of_nothing(flights, links):
    none = {"airport": "???"}
    row = views.network_summary(flights, links, none).first()
    assert (row.total_flights, row.signal_b_valid_links, row.delay_rate_pct) == (0, 0, None)
    assert views.airport_performance(flights, links, none).isEmpty()
    assert views.propagation_signal_comparison(links, none).first().agreement_rate_pct is None
    assert {r.pct_of_total_delay_minutes for r in views.delay_cause_performance(flights, none).collect()} == {None}


@pytest.mark.parametrize("most_hashes", [10_000, 3])
def test_quality_checks_find_planted_faults(flights, monkeypatch, most_hashes):
    monkeypatch.setattr(quality, "MAX_REPEATED_HASHES", most_hashes)
    twice = flights.unionByName(flights.where("origin = 'AAA'"))
    n = flights.where("origin = 'AAA'").count()
    assert quality.full_row_duplicates(twice).first().duplicate_rows == n
    assert quality.key_duplicates(twice).first().duplicate_keys >= n
    faulty = flights.withColumn("origin", F.when(F.col("origin") == "AAA", "Aa1").otherwise(F.col("origin")))
    found = {r.check_name: r.bad_rows for r in quality.domain_violations(faulty.withColumn("distance", F.lit(0))).collect()}
    assert found["bad_origin_code"] == n and found["nonpositive_distance"] == flights.count()


def test_rankings_take_parameters(flights, links):
    assert propagation.propagation_by_airport(links, min_n=1, k=3).count() == 3
    top = rankings.top_routes_by_delay_rate(flights, links, k=2).collect()
    assert len(top) == 2 and top[0].delay_rate_pct >= top[1].delay_rate_pct
    assert " → " in top[0].route


def test_sql_users_see_tables_and_views(spark, flights, links):
    catalog.register_views(flights, links)
    found = catalog.run_query(
        spark, "SELECT count(*) AS n FROM flights WHERE origin = :airport", {"airport": "CAA"}).first().n
    assert found == flights.where("origin = 'CAA'").count()
    for view in ("v_network_summary", "v_airport_performance", "v_route_performance", "v_hour_of_day_performance",
                 "v_delay_cause_performance", "v_propagation_signal_comparison", "v_turnaround_buffer_performance"):
        assert not catalog.run_query(spark, f"SELECT * FROM {view}").isEmpty()


def test_no_query_leaves_the_jvm(spark, data_dir):
    for name, query in QUERIES.items():
        plan = query(spark, data_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Join Cross" not in plan, name
