"""One DuckDB statement per registered query."""

from __future__ import annotations

from oracles.tables import LEGS, STAYS, over_flights, over_legs, over_links

CAUSES = ("carrier_delay", "weather_delay", "nas_delay", "security_delay", "late_aircraft_delay")
NULLABLE = (
    "tail_number", "flight_number", "dep_time", "dep_delay_minutes", "taxi_out", "wheels_off", "wheels_on",
    "taxi_in", "arr_time", "arr_delay_minutes", "arr_del15", "cancellation_code", "crs_elapsed_time",
    "actual_elapsed_time", "air_time", *CAUSES,
)
REQUIRED = (
    "flight_date", "reporting_airline", "origin", "dest", "crs_dep_time", "crs_arr_time", "cancelled",
    "diverted", "distance",
)
REQUIRED_LINK = (
    "tail_number", "flight_date", "reporting_airline", "origin", "dest", "crs_dep_time", "link_status",
)

# Bins as (upper bound in minutes, label); the last bin has no bound.
BUFFER_BUCKETS = (
    (0, "<=0 (no scheduled buffer)"), (30, "0-30"), (45, "30-45"), (60, "45-60"), (90, "60-90"), (120, "90-120"),
    (None, "120+"),
)
PRIOR_DELAY_BINS = ((0, "<=0"), (15, "1-15"), (30, "15-30"), (60, "30-60"), (120, "60-120"), (None, "120+"))
POSITIVE_BUFFER_BINS = ((30, "<30"), (45, "30-45"), (60, "45-60"), (90, "60-90"), (120, "90-120"), (None, "120+"))

# Codes and the text shown for them.
CANCELLATION_REASONS = (("A", "Carrier"), ("B", "Weather"), ("C", "National Air System"), ("D", "Security"))
CAUSE_LABELS = (
    ("carrier_delay", "Carrier Delay"), ("weather_delay", "Weather Delay"), ("nas_delay", "NAS Delay"),
    ("security_delay", "Security Delay"), ("late_aircraft_delay", "Late Aircraft Delay"),
)

HOUR = "CAST((crs_dep_time // 100) % 24 AS INTEGER)"
ALL_CAUSES = " + ".join(CAUSES)


def ratio(k: str, n: str, scale: int) -> str:
    k, n = f"CAST({k} AS HUGEINT)", f"CAST({n} AS HUGEINT)"
    return (
        f"CASE WHEN {n} > 0 THEN sign({k}) * CAST((abs({k}) * {2 * scale} + {n}) // (2 * {n}) AS BIGINT)"
        f" / {scale}.0e0 END"
    )


def pct(part: str, whole: str, digits: int = 2) -> str:
    return ratio(f"100 * ({part})", whole, 10**digits)


def bin_number(value: str, bins: tuple) -> str:
    """Position of the first bin whose bound the value does not exceed."""
    bounded = [f"WHEN {value} <= {bound} THEN {i}" for i, (bound, _) in enumerate(bins) if bound is not None]
    return f"CAST(CASE {' '.join(bounded)} ELSE {len(bins) - 1} END AS INTEGER)"


def shown_as(code: str, pairs) -> str:
    return f"CASE {code} " + " ".join(f"WHEN {key!r} THEN '{text}'" for key, text in pairs) + " END"


def bin_label(number: str, bins: tuple) -> str:
    return shown_as(number, enumerate(label for _, label in bins))


def avg2(x: str) -> str:
    return ratio(f"sum({x})", f"count({x})", 100)


def total(x: str) -> str:
    return f"CAST(sum({x}) AS BIGINT)"


def share(predicate: str, digits: int = 2) -> str:
    return pct(f"count(*) FILTER (WHERE {predicate})", "count(*)", digits)


LATE_SHARE = pct("sum(late_aircraft_delay)", f"sum({ALL_CAUSES})")
DELAY_RATE = pct("count(*) FILTER (WHERE arr_del15)", "count(arr_del15)")

FLIGHT_KPIS = f"""
    count(*) AS total_flights,
    count(*) FILTER (WHERE arr_del15) AS delayed_flights,
    {DELAY_RATE} AS delay_rate_pct,
    {total('arr_delay_minutes')} AS total_delay_minutes,
    {avg2('arr_delay_minutes')} AS avg_delay_minutes,
    {total('late_aircraft_delay')} AS signal_a_late_aircraft_delay_minutes,
    {LATE_SHARE} AS signal_a_late_aircraft_share_pct"""

VALID = "link_status = 'valid'"
EST = "CASE WHEN link_status = 'valid' THEN propagated_delay_estimate_min END"
LINK_KPIS = f"""
    count(*) FILTER (WHERE {VALID}) AS signal_b_valid_links,
    {pct(f"count(*) FILTER (WHERE {VALID} AND propagated_delay_estimate_min > 0)", f"count(*) FILTER (WHERE {VALID})")}
        AS signal_b_propagation_rate_pct,
    {total(EST)} AS signal_b_propagated_delay_minutes,
    {avg2(EST)} AS signal_b_avg_propagated_delay_minutes"""


def _joined(keys: dict[str, str], where: str, drop: tuple[str, ...] = (), flag: int | None = None) -> str:
    """Flight KPIs left-joined with link KPIs, both aggregated by the same keys."""
    named = ", ".join(f"{expression} AS {name}" for name, expression in keys.items())
    by = ", ".join(keys)
    flight_names = [
        name for name in (
            "total_flights", "delayed_flights", "delay_rate_pct", "total_delay_minutes", "avg_delay_minutes",
            "signal_a_late_aircraft_delay_minutes", "signal_a_late_aircraft_share_pct",
        ) if name not in drop
    ]
    shown = [f"f.{name}" for name in (*keys, *flight_names)] + [
        "coalesce(r.signal_b_valid_links, 0) AS signal_b_valid_links",
        "r.signal_b_propagation_rate_pct",
        "coalesce(r.signal_b_propagated_delay_minutes, 0) AS signal_b_propagated_delay_minutes",
        "r.signal_b_avg_propagated_delay_minutes",
    ]
    if flag:
        shown.append(f"f.total_flights >= {flag} AS meets_min_volume_threshold")
    on = " AND ".join(f"f.{name} = r.{name}" for name in keys)
    return f"""SELECT {', '.join(shown)}
    FROM (SELECT {named}, {FLIGHT_KPIS} FROM flights WHERE {where} GROUP BY {by}) f
    LEFT JOIN (SELECT {named}, {LINK_KPIS} FROM rotation_links WHERE {where} GROUP BY {by}) r ON {on}"""


def network(where: str = "TRUE") -> str:
    return over_links(f"""SELECT * FROM (SELECT {FLIGHT_KPIS} FROM flights WHERE {where})
        CROSS JOIN (SELECT {LINK_KPIS} FROM rotation_links WHERE {where})""")


def airports(where: str = "TRUE") -> str:
    return _joined({"airport": "origin"}, where, flag=1000)


def routes(where: str = "TRUE") -> str:
    return _joined({"origin": "origin", "dest": "dest"}, where, flag=200)


def hours(where: str = "TRUE") -> str:
    return _joined({"scheduled_dep_hour": HOUR}, where, drop=("total_delay_minutes",))


def causes(where: str = "TRUE") -> str:
    rows = " UNION ALL ".join(f"SELECT '{c}' AS cause, {c} AS minutes FROM totals" for c in CAUSES)
    return f"""SELECT cause, minutes, {pct('minutes', 'everything')} AS pct_of_total_delay_minutes
    FROM (SELECT *, sum(minutes) OVER () AS everything FROM (
        WITH totals AS (
            SELECT {', '.join(f'{total(c)} AS {c}' for c in CAUSES)}
            FROM flights WHERE carrier_delay IS NOT NULL AND {where}
        ) {rows}))"""


A0 = "coalesce(late_aircraft_delay, 0)"
BOTH = f"count(*) FILTER (WHERE {A0} > 0 AND propagated_delay_estimate_min > 0)"
NEITHER = f"count(*) FILTER (WHERE {A0} = 0 AND propagated_delay_estimate_min = 0)"


def corr3(x: str, y: str) -> str:
    return f"round(corr({x}, {y}), 3)"


def signals(where: str = "TRUE") -> str:
    return f"""SELECT
        count(*) AS signal_b_valid_links,
        count(late_aircraft_delay) AS signal_a_defined_links,
        {share('late_aircraft_delay IS NOT NULL')} AS signal_a_coverage_pct,
        {corr3('prior_leg_arr_delay_minutes', 'late_aircraft_delay')} AS corr_raw_prior_delay_vs_signal_a,
        {corr3('propagated_delay_estimate_min', 'late_aircraft_delay')} AS corr_buffer_adjusted_estimate_vs_signal_a,
        {BOTH} AS both_signals_present,
        {NEITHER} AS both_signals_absent,
        count(*) FILTER (WHERE {A0} = 0 AND propagated_delay_estimate_min > 0) AS signal_b_only,
        count(*) FILTER (WHERE {A0} > 0 AND propagated_delay_estimate_min = 0) AS signal_a_only,
        {pct(f'{BOTH} + {NEITHER}', 'count(*)')} AS agreement_rate_pct
    FROM rotation_links WHERE {VALID} AND {where}"""


def turnaround(where: str = "TRUE") -> str:
    return f"""SELECT bucket_order,
        {bin_label('bucket_order', BUFFER_BUCKETS)} AS buffer_bucket_minutes,
        count(*) AS n_links,
        {avg2('prior_leg_arr_delay_minutes')} AS avg_prior_leg_delay_minutes,
        {avg2('dep_delay_minutes')} AS avg_current_dep_delay_minutes,
        {share('dep_delay_minutes >= 15')} AS downstream_delay_rate_pct
    FROM (SELECT *, {bin_number('scheduled_turnaround_min', BUFFER_BUCKETS)} AS bucket_order
        FROM rotation_links WHERE {VALID} AND prior_leg_arr_delay_minutes > 0 AND {where})
    GROUP BY bucket_order"""


def propagation_by(keys: str, names: str) -> str:
    return f"""SELECT {keys}, count(*) AS n,
        {avg2('propagated_delay_estimate_min')} AS avg_propagated_estimate,
        {share('propagated_delay_estimate_min > 0')} AS pct_with_propagated_delay
    FROM rotation_links WHERE {VALID} GROUP BY {names}"""


def count_rows_per_column(table: str, columns: tuple[str, ...]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS null_rows FROM {table}"
        for c in columns
    )


def checks(table: str, rules: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS check_name, count(*) FILTER (WHERE {rule}) AS bad_rows FROM {table}"
        for name, rule in rules.items()
    )


def top(select: str, by: str, keys: str, k: int) -> str:
    return f"SELECT * FROM ({select}) ORDER BY {by} DESC NULLS LAST, {keys} LIMIT {k}"


# The filter settings that __spark_entry__ registers, in SQL.
DATES = "flight_date >= DATE '2024-03-01' AND flight_date <= DATE '2024-07-31'"
ALL_FILTERS = f"{DATES} AND reporting_airline = 'CA' AND origin = 'CAA' AND dest = 'HAA'"
FILTERS = {
    "dates": DATES,
    "airline": "reporting_airline = 'CA'",
    "airport": "origin = 'CAA'",
    "route": "origin = 'CAA' AND dest = 'HAA'",
    "combined": f"{DATES} AND reporting_airline = 'CA' AND origin = 'CAA'",
    "all": ALL_FILTERS,
}


def statements() -> dict[str, str]:
    sql: dict[str, str] = {}

    # Flights and links themselves.
    sql["flights_typed"] = sql["flights_ingest"] = over_flights("SELECT * FROM flights")
    sql["utc_times"] = over_legs("""SELECT tail_number, flight_date, flight_number, origin, dest, crs_dep_time,
        origin_tz, CAST(epoch(dep_s) AS BIGINT) // 60 AS dep_utc_scheduled_min,
        CAST(epoch(arr_s) AS BIGINT) // 60 AS arr_utc_scheduled_min,
        CAST(epoch(dep_a) AS BIGINT) // 60 AS dep_utc_actual_min,
        CAST(epoch(arr_a) AS BIGINT) // 60 AS arr_utc_actual_min
        FROM legs WHERE tail_number IS NOT NULL""")
    sql["rotation_links"] = sql["links_csv"] = over_links("SELECT * FROM rotation_links")
    sql["months_pending"] = over_flights("""SELECT CAST(y AS INTEGER) AS flight_year, CAST(m AS INTEGER) AS flight_month
        FROM range(2024, 2026) a(y), range(1, 13) b(m)
        WHERE NOT EXISTS (SELECT 1 FROM flights WHERE year(flight_date) = y AND month(flight_date) = m)""")

    # Ad-hoc questions over flights.
    sql["overall_volume"] = over_flights("""SELECT count(*) AS total_flights,
        count(DISTINCT tail_number) AS distinct_aircraft, count(DISTINCT reporting_airline) AS distinct_carriers,
        count(DISTINCT origin) AS distinct_origin_airports, min(flight_date) AS first_date,
        max(flight_date) AS last_date FROM flights""")
    sql["monthly_volume"] = over_flights("""SELECT CAST(date_trunc('month', flight_date) AS DATE) AS month,
        count(*) AS flights FROM flights GROUP BY 1""")
    sql["delay_rate"] = over_flights(f"""SELECT count(*) FILTER (WHERE arr_del15) AS delayed_flights,
        count(arr_del15) AS completed_flights, {DELAY_RATE} AS delay_rate_pct FROM flights""")
    sql["arrival_delay_stats"] = over_flights(f"""SELECT {avg2('arr_delay_minutes')} AS avg_arr_delay_minutes,
        CAST(percentile_cont(0.5) WITHIN GROUP (ORDER BY arr_delay_minutes) AS DOUBLE) AS median_arr_delay_minutes,
        {avg2('CASE WHEN arr_delay_minutes > 0 THEN arr_delay_minutes END')} AS avg_delay_minutes_when_late
        FROM flights WHERE arr_delay_minutes IS NOT NULL""")
    sql["cancellation_rate"] = over_flights(f"""SELECT count(*) FILTER (WHERE cancelled) AS cancelled_flights,
        count(*) AS total_flights, {share('cancelled', 3)} AS cancellation_rate_pct FROM flights""")
    sql["cancellation_by_reason"] = over_flights(f"""SELECT cancellation_code,
        {shown_as('cancellation_code', CANCELLATION_REASONS)} AS reason, count(*) AS cancelled_flights
        FROM flights WHERE cancelled GROUP BY 1""")
    sql["delay_cause_share"] = over_flights(causes())
    airport_rows = f"""SELECT origin, count(*) AS flights, {DELAY_RATE} AS delay_rate_pct,
        {avg2('arr_delay_minutes')} AS avg_arr_delay_minutes, {LATE_SHARE} AS late_aircraft_share_pct
        FROM flights GROUP BY origin HAVING count(*) >= 1000"""
    sql["airport_delay_top20"] = over_flights(top(airport_rows, "delay_rate_pct", "origin", 20))
    route_rows = f"""SELECT origin, dest, count(*) AS flights, {DELAY_RATE} AS delay_rate_pct,
        {avg2('arr_delay_minutes')} AS avg_arr_delay_minutes
        FROM flights GROUP BY origin, dest HAVING count(*) >= 200"""
    sql["route_delay_top20"] = over_flights(top(route_rows, "delay_rate_pct", "origin, dest", 20))
    sql["day_of_week"] = over_flights(f"""SELECT CAST(isodow(flight_date) AS INTEGER) AS iso_day_of_week,
        dayname(flight_date) AS day_name, count(*) AS flights, {DELAY_RATE} AS delay_rate_pct,
        {avg2('arr_delay_minutes')} AS avg_arr_delay_minutes FROM flights GROUP BY 1, 2""")
    sql["hour_of_day"] = over_flights(f"""SELECT {HOUR} AS scheduled_dep_hour, count(*) AS flights,
        {DELAY_RATE} AS delay_rate_pct, {avg2('arr_delay_minutes')} AS avg_arr_delay_minutes,
        {avg2('late_aircraft_delay')} AS avg_late_aircraft_delay_minutes FROM flights GROUP BY 1""")
    dominant = f"late_aircraft_delay = greatest({', '.join(CAUSES)}) AND late_aircraft_delay > 0"
    sql["late_aircraft_dominant"] = over_flights(f"""SELECT
        count(*) FILTER (WHERE {dominant}) AS late_aircraft_dominant_flights, count(*) AS total_delayed_flights,
        {share(dominant)} AS pct_late_aircraft_dominant FROM flights WHERE carrier_delay IS NOT NULL""")
    sql["late_aircraft_share_by_hour"] = over_flights(f"""SELECT {HOUR} AS scheduled_dep_hour,
        {LATE_SHARE} AS late_aircraft_share_pct, {avg2('late_aircraft_delay')} AS avg_late_aircraft_delay_minutes
        FROM flights WHERE carrier_delay IS NOT NULL GROUP BY 1""")
    x, y = "CAST(dep_delay_minutes AS HUGEINT)", "CAST(arr_delay_minutes AS HUGEINT)"
    sql["dep_arr_correlation"] = over_flights(f"""SELECT
        CAST(count(*) * sum({x} * {y}) - sum({x}) * sum({y}) AS DOUBLE)
        / nullif(sqrt(CAST(count(*) * sum({x} * {x}) - sum({x}) * sum({x}) AS DOUBLE))
               * sqrt(CAST(count(*) * sum({y} * {y}) - sum({y}) * sum({y}) AS DOUBLE)), 0) AS dep_arr_delay_correlation,
        count(*) AS flights_used
        FROM flights WHERE dep_delay_minutes IS NOT NULL AND arr_delay_minutes IS NOT NULL""")
    sql["inflight_recovery"] = over_flights(f"""SELECT
        {avg2('dep_delay_minutes - arr_delay_minutes')} AS avg_minutes_recovered_in_flight,
        {share('arr_delay_minutes < dep_delay_minutes')} AS pct_flights_recovering_time
        FROM flights WHERE dep_delay_minutes > 0 AND arr_delay_minutes IS NOT NULL""")

    # Views, plain and filtered.
    sql["network_summary"] = network()
    sql["airport_performance"] = over_links(airports())
    sql["route_performance"] = over_links(routes())
    sql["hour_of_day_performance"] = over_links(hours())
    sql["delay_cause_performance"] = over_flights(causes())
    sql["propagation_signal_comparison"] = over_links(signals())
    sql["turnaround_buffer_performance"] = over_links(turnaround())
    for name, where in FILTERS.items():
        sql[f"filtered_network_{name}"] = network(where)
    sql["filtered_airports"] = over_links(airports(FILTERS["dates"]))
    sql["filtered_routes"] = over_links(routes(FILTERS["airline"]))
    sql["filtered_hourly"] = over_links(hours(FILTERS["airport"]))
    sql["filtered_causes"] = over_flights(causes(FILTERS["route"]))
    sql["filtered_propagation"] = over_links(signals(FILTERS["combined"]))
    sql["filtered_turnaround"] = over_links(turnaround(FILTERS["dates"]))
    sql["sql_airport_report"] = over_links(f"""SELECT airport, total_flights, delay_rate_pct
        FROM ({airports()}) WHERE meets_min_volume_threshold AND delay_rate_pct >= 30""")

    # Filter options.
    sql["filter_options_bounds"] = sql["dq_date_range"] = over_flights(
        "SELECT min(flight_date) AS min_date, max(flight_date) AS max_date FROM flights")
    sql["filter_options_airlines"] = over_flights("SELECT DISTINCT reporting_airline FROM flights")
    sql["filter_options_airports"] = over_flights("SELECT DISTINCT origin AS airport FROM flights")
    sql["filter_options_routes"] = over_flights("""SELECT origin || ' → ' || dest AS label,
        origin || '-' || dest AS value FROM flights GROUP BY origin, dest HAVING count(*) >= 200""")

    # Rotation and signal analyses.
    sql["link_status_counts"] = over_links("SELECT link_status, count(*) AS links FROM rotation_links GROUP BY 1")
    sql["link_coverage"] = over_links(f"""SELECT count(*) AS tail_known_flights,
        count(*) FILTER (WHERE {VALID}) AS valid_links, {share(VALID)} AS valid_pct FROM rotation_links""")
    b = "coalesce(propagated_delay_estimate_min, 0)"
    both, neither = f"count(*) FILTER (WHERE {A0} > 0 AND {b} > 0)", f"count(*) FILTER (WHERE {A0} <= 0 AND {b} <= 0)"
    sql["compare_signals"] = over_links(f"""SELECT count(*) AS valid_links,
        count(late_aircraft_delay) AS signal_a_defined,
        {share('late_aircraft_delay IS NOT NULL')} AS signal_a_defined_pct,
        {corr3('prior_leg_arr_delay_minutes', 'late_aircraft_delay')} AS corr_prior_delay,
        {corr3('propagated_delay_estimate_min', 'late_aircraft_delay')} AS corr_estimate,
        {pct(f'{both} + {neither}', 'count(*)')} AS agreement_pct,
        {both} AS both_present, {neither} AS both_absent,
        count(*) FILTER (WHERE {A0} <= 0 AND {b} > 0) AS b_only,
        count(*) FILTER (WHERE {A0} > 0 AND {b} <= 0) AS a_only,
        {pct(both, f'count(*) FILTER (WHERE {A0} > 0)')} AS a_present_flagged_by_b_pct
        FROM rotation_links WHERE {VALID}""")
    p = "prior_leg_arr_delay_minutes"
    sql["downstream_vs_prior"] = over_links(f"""SELECT bin_order, count(*) AS n,
        {avg2('dep_delay_minutes')} AS avg_current_dep_delay, {avg2('arr_delay_minutes')} AS avg_current_arr_delay,
        {share('arr_delay_minutes >= 15')} AS pct_current_delayed_15,
        {bin_label('bin_order', PRIOR_DELAY_BINS)} AS prior_delay_bucket
        FROM (SELECT *, {bin_number(p, PRIOR_DELAY_BINS)} AS bin_order
            FROM rotation_links WHERE {VALID} AND {p} IS NOT NULL) GROUP BY bin_order""")
    sql["prior_dep_correlation"] = over_links(f"""SELECT {corr3(p, 'dep_delay_minutes')} AS corr_prior_vs_dep_delay,
        count(*) FILTER (WHERE {p} IS NOT NULL AND dep_delay_minutes IS NOT NULL) AS links_used
        FROM rotation_links WHERE {VALID}""")
    s = "scheduled_turnaround_min"
    sql["buffer_effect"] = over_links(f"""SELECT bin_order, count(*) AS n, {avg2(p)} AS avg_prior_delay,
        {avg2('dep_delay_minutes')} AS avg_current_dep_delay,
        {share('dep_delay_minutes >= 15')} AS pct_current_delayed_15,
        {bin_label('bin_order', POSITIVE_BUFFER_BINS)} AS buffer_bucket
        FROM (SELECT *, {bin_number(s, POSITIVE_BUFFER_BINS)} AS bin_order
            FROM rotation_links WHERE {VALID} AND {p} > 0 AND {s} > 0) GROUP BY bin_order""")
    sql["propagation_by_hour"] = over_links(propagation_by(f"{HOUR} AS dep_hour", "dep_hour"))
    sql["propagation_by_airport"] = over_links(top(
        propagation_by("origin", "origin") + " HAVING count(*) >= 500", "avg_propagated_estimate", "origin", 15))
    sql["propagation_by_route"] = over_links(top(
        propagation_by("origin, dest", "origin, dest") + " HAVING count(*) >= 100",
        "avg_propagated_estimate", "origin, dest", 15))

    # Rankings and profiles.
    shown = "delay_rate_pct, total_flights, avg_delay_minutes"
    sql["top_airports_by_delay_rate"] = over_links(top(
        f"SELECT airport, {shown} FROM ({airports()}) WHERE meets_min_volume_threshold",
        "delay_rate_pct", "airport", 15))
    sql["top_routes_by_delay_rate"] = over_links(top(
        f"SELECT origin || ' → ' || dest AS route, {shown} FROM ({routes()}) WHERE meets_min_volume_threshold",
        "delay_rate_pct", "route", 15))
    sql["cause_ranking"] = over_flights(f"""SELECT
        CAST(row_number() OVER (ORDER BY minutes DESC NULLS LAST, cause) AS INTEGER) AS rank, cause,
        {shown_as('cause', CAUSE_LABELS)} AS label, minutes, pct_of_total_delay_minutes FROM ({causes()})""")
    sql["hourly_delay_profile"] = over_links(
        f"SELECT scheduled_dep_hour, delay_rate_pct, avg_delay_minutes FROM ({hours()})")
    sql["hourly_signals"] = over_links(f"""SELECT scheduled_dep_hour, signal_a_late_aircraft_share_pct,
        signal_b_propagation_rate_pct FROM ({hours()})""")
    sql["turnaround_profile"] = over_links(f"""SELECT bucket_order, buffer_bucket_minutes,
        downstream_delay_rate_pct, n_links, avg_prior_leg_delay_minutes FROM ({turnaround()})""")
    tot, avg = "signal_b_propagated_delay_minutes", "signal_b_avg_propagated_delay_minutes"
    sql["airport_propagation_rankings"] = over_links(
        " UNION ALL ".join(
            f"""SELECT * FROM (SELECT '{name}' AS ranking,
            CAST(row_number() OVER (ORDER BY {by} DESC NULLS LAST, airport) AS INTEGER) AS rank, airport, {tot}, {avg}
            FROM eligible) WHERE rank <= 10""" for name, by in (("total", tot), ("average", avg))),
        f"eligible AS (SELECT * FROM ({airports()}) WHERE meets_min_volume_threshold)")
    sql["signal_agreement_matrix"] = over_links(" UNION ALL ".join(
        f"""SELECT '{name}' AS signal_a, count(*) FILTER (WHERE {A0} {test} AND {b} > 0) AS signal_b_present,
        count(*) FILTER (WHERE {A0} {test} AND {b} <= 0) AS signal_b_absent FROM rotation_links WHERE {VALID}"""
        for name, test in (("present", "> 0"), ("absent", "<= 0"))))

    # Data quality.
    sql["dq_month_coverage"] = over_flights("""SELECT CAST(date_trunc('month', flight_date) AS DATE) AS month,
        false AS is_total, count(*) AS flights FROM flights GROUP BY 1
        UNION ALL SELECT NULL AS month, true AS is_total, count(*) AS flights FROM flights""")
    sql["dq_required_nulls"] = over_flights(count_rows_per_column("flights", REQUIRED))
    sql["dq_required_link_nulls"] = over_links(count_rows_per_column("rotation_links", REQUIRED_LINK))
    sql["dq_nullable_profile"] = over_flights(count_rows_per_column("flights", NULLABLE))
    sql["dq_full_row_duplicates"] = over_flights(
        "SELECT (SELECT count(*) FROM flights) - (SELECT count(*) FROM (SELECT DISTINCT * FROM flights))"
        " AS duplicate_rows")
    sql["dq_key_duplicates"] = over_flights("""SELECT count(*) AS duplicate_keys,
        CAST(coalesce(sum(n), 0) AS BIGINT) AS rows_sharing_a_key
        FROM (SELECT count(*) AS n FROM flights GROUP BY flight_date, reporting_airline, flight_number, origin,
            dest, crs_dep_time HAVING count(*) > 1)""")
    sql["dq_domain"] = over_flights(checks("flights", {
        "bad_origin_code": "NOT regexp_full_match(origin, '[A-Z]{3}')",
        "bad_dest_code": "NOT regexp_full_match(dest, '[A-Z]{3}')",
        "nonpositive_distance": "distance <= 0",
        "outside_year": "year(flight_date) <> 2024",
        "negative_dep_delay": "dep_delay_minutes < 0",
        "negative_arr_delay": "arr_delay_minutes < 0",
    }))
    reported = " + ".join(f"CAST({c} IS NOT NULL AS INTEGER)" for c in CAUSES)
    sql["dq_cause_consistency"] = over_flights(checks("flights", {
        "causes_partly_reported": f"({reported}) BETWEEN 1 AND 4",
        "causes_without_delay": f"({reported}) > 0 AND (arr_delay_minutes IS NULL OR arr_delay_minutes < 15)",
    }))
    sql["dq_cancel_divert"] = over_flights("""SELECT count(*) FILTER (WHERE cancelled) AS cancelled_flights,
        count(*) FILTER (WHERE diverted) AS diverted_flights FROM flights""")
    sql["dq_link_status"] = over_links("""SELECT link_status, count(*) AS links FROM rotation_links GROUP BY 1
        UNION ALL SELECT 'total' AS link_status, count(*) AS links FROM rotation_links""")
    sql["dq_valid_link_invariants"] = over_links(checks(f"(SELECT * FROM rotation_links WHERE {VALID})", {
        "missing_inputs": """scheduled_turnaround_min IS NULL OR observed_turnaround_min IS NULL
            OR prior_leg_arr_delay_minutes IS NULL OR propagated_delay_estimate_min IS NULL""",
        "negative_estimate": "propagated_delay_estimate_min < 0",
    }))
    sql["dq_summary"] = over_links(f"""SELECT 'flight_rows' AS check_name, count(*) AS result FROM flights
        UNION ALL SELECT 'months_present', count(DISTINCT date_trunc('month', flight_date)) FROM flights
        UNION ALL SELECT 'tail_known_flights', count(*) FROM rotation_links
        UNION ALL SELECT 'valid_links', count(*) FROM rotation_links WHERE {VALID}""")
    rows = [f"SELECT check_name, {value} AS result FROM ({sql[name]})" for name, value in (
        ("dq_summary", "result"), ("dq_domain", "bad_rows"), ("dq_cause_consistency", "bad_rows"), ("dq_valid_link_invariants", "bad_rows"))]
    rows += [f"SELECT '{name}' AS check_name, sum(null_rows)::BIGINT AS result FROM ({sql[key]})" for name, key in (
        ("required_flight_nulls", "dq_required_nulls"), ("required_link_nulls", "dq_required_link_nulls"))]
    rows += [f"SELECT '{column}' AS check_name, {column}::BIGINT AS result FROM ({sql[key]})" for key, columns in (
        ("dq_full_row_duplicates", ["duplicate_rows"]), ("dq_key_duplicates", ["duplicate_keys", "rows_sharing_a_key"]),
        ("dq_cancel_divert", ["cancelled_flights", "diverted_flights"])) for column in columns]
    sql["dq_report"] = " UNION ALL ".join(rows)
    found = [f"SELECT '{name}' AS finding, CAST(NULL AS VARCHAR) AS part, {name}::DOUBLE AS value FROM ({sql[key]})" for key, names in (
        ("delay_rate", ("delayed_flights", "delay_rate_pct")),
        ("arrival_delay_stats", ("avg_arr_delay_minutes", "median_arr_delay_minutes", "avg_delay_minutes_when_late")),
        ("cancellation_rate", ("total_flights", "cancellation_rate_pct")),
        ("link_coverage", ("tail_known_flights", "valid_links", "valid_pct")),
        ("compare_signals", ("corr_prior_delay", "corr_estimate", "agreement_pct", "a_present_flagged_by_b_pct"))) for name in names]
    found += [f"SELECT '{name}' AS finding, {part} AS part, {value}::DOUBLE AS value FROM ({sql[key]})" for name, key, part, value in (
        ("cause_share_pct", "delay_cause_performance", "cause", "pct_of_total_delay_minutes"),
        ("downstream_delay_rate_pct", "turnaround_buffer_performance", "buffer_bucket_minutes", "downstream_delay_rate_pct"))]
    sql["headline_findings"] = " UNION ALL ".join(found)
    sql |= ground_statements() | span_statements()
    sql["links_by_month"] = sql["rotation_links"]
    return sql


def ground_statements() -> dict[str, str]:
    """As-of, interval, sweep and chain queries."""
    minute = "epoch({})::BIGINT // 60"
    chains = """gains AS (
        SELECT *, CASE WHEN link_status = 'valid' AND prev_own_delay IS NOT NULL
                       THEN prev_own_delay - scheduled_turnaround_min END AS gain FROM linked
    ),
    walk(tail_number, leg_number, carried, legs) AS (
        SELECT tail_number, leg_number, 0::BIGINT, 0::BIGINT FROM gains WHERE leg_number = 1
        UNION ALL
        SELECT g.tail_number, g.leg_number, CASE WHEN gain IS NULL THEN 0 ELSE greatest(0, carried + gain) END,
               CASE WHEN gain IS NULL OR carried + gain <= 0 THEN 0 ELSE legs + 1 END
        FROM walk w JOIN gains g ON g.tail_number = w.tail_number AND g.leg_number = w.leg_number + 1
    )"""
    carried = """SELECT tail_number, flight_date, reporting_airline, flight_number, origin, dest, crs_dep_time, link_status,
        propagated_delay_estimate_min, carried AS carried_delay_min, legs AS legs_carried
        FROM linked JOIN walk USING (tail_number, leg_number)"""
    pairs = """SELECT a.airport, a.tail_number AS a_tail_number, a.start_min AS a_start_min, a.end_min AS a_end_min,
        b.tail_number AS b_tail_number, b.start_min AS b_start_min, b.end_min AS b_end_min,
        greatest(a.start_min, b.start_min) AS overlap_start, least(a.end_min, b.end_min) AS overlap_end
        FROM stays a JOIN stays b ON a.airport = b.airport AND a.start_min < b.end_min AND b.start_min < a.end_min
            AND (a.tail_number, a.start_min, a.end_min) < (b.tail_number, b.start_min, b.end_min)"""
    steps = """changes AS (
        SELECT airport, at_min, sum(change) AS change FROM (
            SELECT airport, start_min AS at_min, 1 AS change FROM stays UNION ALL SELECT airport, end_min, -1 FROM stays)
        GROUP BY ALL HAVING sum(change) <> 0
    ),
    steps AS (SELECT airport, at_min, (sum(change) OVER (PARTITION BY airport ORDER BY at_min))::BIGINT AS aircraft_on_ground FROM changes)"""
    return {
        "last_arrivals": over_flights(f"""SELECT d.tail_number, d.flight_date, d.flight_number, d.origin, d.dest, d.crs_dep_time,
            {minute.format("d.dep_a")} AS dep_min, {minute.format("a.arr_a")} AS last_arr_min, a.tail_number AS last_tail_number,
            a.flight_number AS last_flight_number, a.origin AS last_from, a.arr_delay_minutes AS last_arr_delay_minutes,
            {minute.format("d.dep_a")} - {minute.format("a.arr_a")} AS minutes_since_arrival,
            a.tail_number = d.tail_number AS same_aircraft
            FROM (SELECT * FROM legs WHERE dep_a IS NOT NULL) d ASOF LEFT JOIN arrivals a ON a.dest = d.origin AND d.dep_a >= a.arr_a""",
            LEGS, """arrivals AS (
                SELECT * FROM legs WHERE arr_a IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dest, arr_a ORDER BY
                    tail_number DESC NULLS LAST, flight_number DESC NULLS LAST, origin DESC, arr_delay_minutes DESC NULLS LAST) = 1)"""),
        "ground_overlaps": over_links(pairs, STAYS),
        "overlaps_by_airport": over_links(f"""SELECT airport, count(*) AS overlapping_pairs,
            sum(overlap_end - overlap_start)::BIGINT AS overlap_minutes, max(overlap_end - overlap_start) AS longest_overlap_min
            FROM ({pairs}) GROUP BY airport""", STAYS),
        "ground_presence": over_links("SELECT * FROM steps", STAYS, steps),
        "ground_peaks": over_links("""SELECT airport, max(aircraft_on_ground) AS peak_aircraft,
            min(at_min) FILTER (aircraft_on_ground = most) AS peak_min
            FROM (SELECT *, max(aircraft_on_ground) OVER (PARTITION BY airport) AS most FROM steps) GROUP BY airport""", STAYS, steps),
        "carried_delays": over_links(carried, chains).replace("WITH", "WITH RECURSIVE", 1),
        "carried_delay_by_depth": over_links(f"""SELECT legs_carried, count(*) AS legs, sum(carried_delay_min)::BIGINT AS carried_minutes,
            max(carried_delay_min) AS most_minutes FROM ({carried}) WHERE carried_delay_min > 0 GROUP BY legs_carried""",
            chains).replace("WITH", "WITH RECURSIVE", 1),
    }


def span_statements() -> dict[str, str]:
    """Session, moving-frame, cube, rank and difference queries."""
    minute = "epoch({})::BIGINT // 60"
    duty = over_legs(f"""SELECT tail_number, min(s) AS start_min, max(e) AS end_min, count(*) AS legs, sum(greatest(b, 0))::BIGINT AS block_minutes
        FROM (SELECT *, sum(begins) OVER (PARTITION BY tail_number ORDER BY s, e, begins DESC ROWS UNBOUNDED PRECEDING) AS chain FROM (
            SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY tail_number ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
                           <= 480 THEN 0 ELSE 1 END AS begins FROM (
                SELECT tail_number, {minute.format("dep_s")} AS s, greatest({minute.format("dep_s")}, {minute.format("arr_s")}) AS e,
                       {minute.format("arr_s")} - {minute.format("dep_s")} AS b
                FROM legs WHERE tail_number IS NOT NULL AND dep_s IS NOT NULL AND arr_s IS NOT NULL)))
        GROUP BY tail_number, chain""")
    key = "flight_date, reporting_airline, flight_number, origin, dest, crs_dep_time"
    kept = """kept AS (
        SELECT * REPLACE (CASE WHEN flight_number % 89 = 0 THEN arr_delay_minutes + 1 ELSE arr_delay_minutes END AS arr_delay_minutes)
        FROM flights WHERE flight_number % 97 <> 0
    ),
    counts AS (
        SELECT * EXCLUDE (o, n), sum(o)::BIGINT AS n_before, sum(n)::BIGINT AS n_after FROM (
            SELECT *, 1 AS o, 0 AS n FROM flights UNION ALL SELECT *, 0, 1 FROM kept
            UNION ALL SELECT *, 0, 1 FROM kept WHERE flight_number % 83 = 0)
        GROUP BY ALL
    )"""
    return {
        "duty_chains": duty,
        "duty_chains_merged": duty,
        "loads_difference": over_flights(f"SELECT {key}, tail_number, arr_delay_minutes, n_before, n_after FROM counts WHERE n_before <> n_after", kept),
        "loads_by_key": over_flights(f"""SELECT CASE WHEN b = 0 THEN 'added' WHEN a = 0 THEN 'removed' WHEN removed + added = 0 THEN 'unchanged'
            ELSE 'changed' END AS state, count(*) AS flight_keys, sum(removed)::BIGINT AS removed_rows, sum(added)::BIGINT AS added_rows,
            sum(kept)::BIGINT AS kept_rows FROM (
                SELECT sum(n_before) AS b, sum(n_after) AS a, sum(greatest(n_before - n_after, 0)) AS removed,
                       sum(greatest(n_after - n_before, 0)) AS added, sum(least(n_before, n_after)) AS kept FROM counts GROUP BY {key})
            GROUP BY 1""", kept),
        "moving_delay_rate": over_flights(f"""SELECT airport, flight_date, completed_flights, delayed_flights,
            {pct("delayed_flights", "completed_flights")} AS delay_rate_pct FROM (
                SELECT origin AS airport, flight_date, (sum(c) OVER w)::BIGINT AS completed_flights, (sum(d) OVER w)::BIGINT AS delayed_flights
                FROM (SELECT origin, flight_date, count(arr_del15) AS c, count(*) FILTER (arr_del15) AS d FROM flights GROUP BY ALL)
                WINDOW w AS (PARTITION BY origin ORDER BY flight_date RANGE BETWEEN INTERVAL 27 DAYS PRECEDING AND CURRENT ROW))"""),
        "kpi_cube": over_flights(f"""SELECT grouping_id, reporting_airline, origin, month, total_flights, delayed_flights,
            {pct("delayed_flights", "completed")} AS delay_rate_pct, {pct("cancelled", "total_flights")} AS cancellation_rate_pct,
            total_delay_minutes, {ratio("total_delay_minutes", "timed", 100)} AS avg_delay_minutes FROM (
                SELECT CAST(grouping(reporting_airline, origin, month) AS INTEGER) AS grouping_id, reporting_airline, origin, month,
                       count(*) AS total_flights, count(*) FILTER (arr_del15) AS delayed_flights, count(arr_del15) AS completed,
                       count(*) FILTER (cancelled) AS cancelled, sum(arr_delay_minutes)::BIGINT AS total_delay_minutes,
                       count(arr_delay_minutes) AS timed
                FROM (SELECT *, CAST(date_trunc('month', flight_date) AS DATE) AS month FROM flights)
                GROUP BY CUBE (reporting_airline, origin, month))"""),
        "streamed_days": over_flights("""SELECT flight_day AS day, origin AS airport, count(*) AS flights, count(arr_del15) AS completed_flights,
            count(*) FILTER (arr_del15) AS delayed_flights
            FROM placed LEFT JOIN marks ON marks.load = placed.load - 1
            WHERE (mark IS NULL OR flight_day + INTERVAL 1 DAY > mark) AND flight_day + INTERVAL 1 DAY <= (SELECT max(mark) FROM marks)
            GROUP BY ALL""", """placed AS (
            SELECT *, least(3, CASE WHEN flight_date < DATE '2024-05-01' THEN 1 WHEN flight_date < DATE '2024-09-01' THEN 2 ELSE 3 END
                            + CAST(flight_number % 50 = 0 AS INTEGER)) AS load,
                   CAST(flight_date AS TIMESTAMP) + to_minutes(crs_dep_time // 100 * 60 + crs_dep_time % 100) AS departs,
                   CAST(date_trunc('day', CAST(flight_date AS TIMESTAMP) + to_minutes(crs_dep_time // 100 * 60 + crs_dep_time % 100)) AS DATE) AS flight_day
            FROM flights
        ),
        marks AS (SELECT load, max(max(departs)) OVER (ORDER BY load) - INTERVAL 3 DAY AS mark FROM placed GROUP BY load)"""),
        "sketch_errors": over_flights("""SELECT CAST(date_trunc('month', flight_date) AS DATE) AS month,
            grouping(date_trunc('month', flight_date)) = 1 AS is_total, count(*) AS flights,
            count(DISTINCT tail_number) AS exact_aircraft, count(DISTINCT origin || '-' || dest) AS exact_routes,
            true AS aircraft_within_error, true AS routes_within_error, true AS median_within_error, true AS p90_within_error
            FROM flights GROUP BY ROLLUP (date_trunc('month', flight_date))"""),
        "route_percent_ranks": over_flights(f"""SELECT origin, dest, completed_flights, delay_rate_pct,
            rank() OVER (ORDER BY delay_rate_pct) AS rank, percent_rank() OVER (ORDER BY delay_rate_pct) AS percent_rank FROM (
                SELECT origin, dest, count(arr_del15) AS completed_flights,
                       {pct("count(*) FILTER (arr_del15)", "count(arr_del15)")} AS delay_rate_pct
                FROM flights GROUP BY ALL HAVING count(arr_del15) > 0)"""),
    }
