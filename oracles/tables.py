"""DuckDB spelling of the derived tables: flights, airports, legs with UTC times, links."""

from __future__ import annotations

FLIGHTS = """
lines AS (
    SELECT
        CAST(l_quantity AS INTEGER) AS q,
        CAST(round(l_extendedprice * 100) AS BIGINT) AS c,
        CAST(round(l_discount * 100) AS INTEGER) AS d,
        CAST(round(l_tax * 100) AS INTEGER) AS x,
        CAST(l_suppkey * 3 + l_orderkey % 3 AS INTEGER) AS t,
        CAST(100 + l_partkey % 2400 AS INTEGER) AS distance,
        row_number() OVER (
            PARTITION BY l_suppkey, l_orderkey % 3
            ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity
        ) - 1 AS n
    FROM lineitem
),
shaped AS (
    SELECT *,
        c % 71 = 0 AS cancelled,
        c % 83 = 0 AS diverted,
        80 + (t * 3 + n * 11) % 100 AS el,
        greatest(0, (c % 400 - 300) * 2) AS dd,
        CASE WHEN c % 101 = 0 THEN 2400 ELSE (1 + (n % 4) * 5 + t % 3) * 100 + c % 60 END AS sched
    FROM lines
),
arrived AS (
    SELECT *,
        CASE WHEN cancelled OR diverted THEN NULL ELSE greatest(0, dd + d * 3 - 10) END AS ad,
        CASE WHEN cancelled OR diverted OR c % 103 = 0 THEN NULL ELSE el + d * 3 - 10 END AS flown_min
    FROM shaped
),
caused AS (
    SELECT *,
        CASE WHEN ad >= 15 THEN CASE WHEN q % 25 = 0 THEN 1 ELSE 0 END END AS sec,
        CASE WHEN ad >= 15 THEN ad * (d % 3) // 20 END AS wx,
        CASE WHEN ad >= 15 THEN ad * (x % 3) // 10 END AS nas,
        CASE WHEN ad >= 15 AND q % 2 = 1 THEN ad * (q % 4) // 10 END AS car0
    FROM arrived
),
flights AS (
    SELECT
        CAST(DATE '2024-01-01' + CAST(n // 4 % 2656 + (n // 4 % 2656 // 2) * 9 + t % 11 AS INTEGER) AS DATE) AS flight_date,
        chr(CAST(65 + t % 7 AS INTEGER)) || 'A' AS reporting_airline,
        CASE WHEN c % 97 = 0 THEN NULL ELSE 'N' || t END AS tail_number,
        CAST(100 + n % 900 AS INTEGER) AS flight_number,
        chr(CAST(65 + CASE WHEN c % 89 = 0 THEN 25 ELSE (t * 7 + n * 5) % 25 END AS INTEGER)) || 'AA' AS origin,
        chr(CAST(65 + (t * 7 + (n + 1) * 5) % 25 AS INTEGER)) || 'AA' AS dest,
        CAST(sched AS INTEGER) AS crs_dep_time,
        CAST(CASE WHEN cancelled THEN NULL ELSE sched END AS INTEGER) AS dep_time,
        CAST(CASE WHEN cancelled THEN NULL ELSE dd END AS INTEGER) AS dep_delay_minutes,
        CASE WHEN cancelled THEN NULL ELSE q % 20 + 5 END AS taxi_out,
        CAST(NULL AS INTEGER) AS wheels_off,
        CAST(NULL AS INTEGER) AS wheels_on,
        CASE WHEN cancelled OR diverted THEN NULL ELSE d + 3 END AS taxi_in,
        CAST((sched // 100 + 2) % 24 * 100 + sched % 100 AS INTEGER) AS crs_arr_time,
        CAST(CASE WHEN cancelled OR diverted THEN NULL
             ELSE (sched // 100 + 2) % 24 * 100 + sched % 100 END AS INTEGER) AS arr_time,
        CAST(ad AS INTEGER) AS arr_delay_minutes,
        ad >= 15 AS arr_del15,
        cancelled,
        CASE WHEN cancelled THEN chr(65 + q % 4) END AS cancellation_code,
        diverted,
        CAST(el AS INTEGER) AS crs_elapsed_time,
        CAST(flown_min AS INTEGER) AS actual_elapsed_time,
        CAST(flown_min - 20 AS INTEGER) AS air_time,
        distance,
        CAST(CASE WHEN q % 2 = 1 THEN car0 WHEN ad >= 15 THEN ad - wx - nas - sec END AS INTEGER) AS carrier_delay,
        CAST(wx AS INTEGER) AS weather_delay,
        CAST(nas AS INTEGER) AS nas_delay,
        CAST(sec AS INTEGER) AS security_delay,
        CAST(CASE WHEN ad >= 15 AND q % 2 = 1 THEN ad - wx - nas - sec - car0
             WHEN ad >= 15 THEN 0 END AS INTEGER) AS late_aircraft_delay
    FROM caused
)"""

LEGS = """
airports AS (
    SELECT chr(CAST(65 + k AS INTEGER)) || 'AA' AS iata,
        CASE WHEN k < 12 OR k = 25 THEN 'America/New_York' WHEN k <= 17 THEN 'America/Chicago'
             WHEN k <= 19 THEN 'America/Denver' WHEN k = 20 THEN 'America/Phoenix'
             WHEN k <= 22 THEN 'America/Los_Angeles' WHEN k = 23 THEN 'Pacific/Honolulu' END AS tz
    FROM range(26) r(k)
),
clocked AS (
    SELECT f.*, a.tz AS origin_tz,
        CAST(flight_date AS TIMESTAMP) + to_minutes(crs_dep_time // 100 * 60 + crs_dep_time % 100) AS wall
    FROM flights f LEFT JOIN airports a ON f.origin = a.iata
),
guessed AS (
    SELECT *, (wall AT TIME ZONE origin_tz) AT TIME ZONE 'UTC' AS guess FROM clocked
),
localised AS (
    SELECT *,
        CASE WHEN (guess AT TIME ZONE 'UTC') AT TIME ZONE origin_tz <> wall THEN NULL
             WHEN ((guess - INTERVAL 1 HOUR) AT TIME ZONE 'UTC') AT TIME ZONE origin_tz = wall THEN NULL
             WHEN ((guess + INTERVAL 1 HOUR) AT TIME ZONE 'UTC') AT TIME ZONE origin_tz = wall THEN NULL
             ELSE guess END AS dep_s
    FROM guessed
),
legs AS (
    SELECT * EXCLUDE (wall, guess),
        dep_s + to_minutes(crs_elapsed_time) AS arr_s,
        dep_s + to_minutes(dep_delay_minutes) AS dep_a,
        dep_s + to_minutes(dep_delay_minutes + actual_elapsed_time) AS arr_a
    FROM localised
)"""

LINKS = """
chained AS (
    SELECT *,
        lag(flight_date) OVER leg AS prev_flight_date,
        lag(flight_number) OVER leg AS prev_flight_number,
        lag(dest) OVER leg AS prev_dest,
        lag(arr_delay_minutes) OVER leg AS prior_leg_arr_delay_minutes,
        lag(cancelled) OVER leg AS prev_cancelled,
        lag(diverted) OVER leg AS prev_diverted,
        lag(CASE WHEN arr_delay_minutes IS NOT NULL THEN greatest(0, arr_delay_minutes - coalesce(late_aircraft_delay, 0)) END) OVER leg AS prev_own_delay,
        row_number() OVER leg AS leg_number,
        lag(arr_s) OVER leg AS prev_arr_s,
        lag(arr_a) OVER leg AS prev_arr_a
    FROM legs WHERE tail_number IS NOT NULL
    WINDOW leg AS (
        PARTITION BY tail_number
        ORDER BY dep_s NULLS FIRST, flight_date, flight_number NULLS FIRST, crs_dep_time, origin, dest,
            reporting_airline, dep_delay_minutes NULLS FIRST, arr_delay_minutes NULLS FIRST,
            late_aircraft_delay NULLS FIRST, cancelled, diverted, arr_s NULLS FIRST, arr_a NULLS FIRST
    )
),
turned AS (
    SELECT *,
        CAST(datediff('minute', prev_arr_s, dep_s) AS INTEGER) AS scheduled_turnaround_min,
        CAST(datediff('minute', prev_arr_a, dep_a) AS INTEGER) AS observed_turnaround_min
    FROM chained
),
linked AS (
    SELECT *,
        CASE WHEN prior_leg_arr_delay_minutes IS NULL OR scheduled_turnaround_min IS NULL THEN NULL
             ELSE greatest(0, prior_leg_arr_delay_minutes - scheduled_turnaround_min)
        END AS propagated_delay_estimate_min,
        CASE WHEN prev_flight_date IS NULL THEN 'excluded_no_prior_flight'
             WHEN prev_cancelled THEN 'excluded_prior_cancelled'
             WHEN cancelled THEN 'excluded_current_cancelled'
             WHEN prev_diverted THEN 'excluded_prior_diverted'
             WHEN diverted THEN 'excluded_current_diverted'
             WHEN coalesce(prev_dest <> origin, true) THEN 'excluded_airport_mismatch'
             WHEN dep_s IS NULL OR prev_arr_s IS NULL THEN 'excluded_missing_scheduled_times'
             WHEN dep_a IS NULL OR prev_arr_a IS NULL THEN 'excluded_missing_actual_times'
             WHEN observed_turnaround_min < 0 THEN 'invalid_negative_turnaround'
             WHEN observed_turnaround_min < 15 THEN 'suspicious_short_turnaround'
             WHEN observed_turnaround_min > 2160 THEN 'suspicious_long_turnaround'
             ELSE 'valid' END AS link_status
    FROM turned
),
rotation_links AS (
    SELECT tail_number, flight_date, reporting_airline, flight_number, origin, dest,
        prev_flight_date, prev_flight_number, prev_dest, crs_dep_time,
        prior_leg_arr_delay_minutes, dep_delay_minutes, arr_delay_minutes, late_aircraft_delay,
        scheduled_turnaround_min, observed_turnaround_min, propagated_delay_estimate_min, link_status
    FROM linked
)"""

STAYS = """
stays AS (
    SELECT origin AS airport, tail_number, epoch(prev_arr_a)::BIGINT // 60 AS start_min, epoch(dep_a)::BIGINT // 60 AS end_min
    FROM linked WHERE link_status = 'valid'
)"""


def over_flights(select: str, *ctes: str) -> str:
    return f"WITH {', '.join([FLIGHTS, *ctes])}\n{select}"


def over_legs(select: str) -> str:
    return over_flights(select, LEGS)


def over_links(select: str, *ctes: str) -> str:
    return over_flights(select, LEGS, LINKS, *ctes)
