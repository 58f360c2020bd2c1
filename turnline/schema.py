"""Column contracts of the three tables: flights, rotation links, airports."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {
    "date": T.DateType(),
    "text": T.StringType(),
    "int": T.IntegerType(),
    "flag": T.BooleanType(),
}

# The names the published on-time extract uses, the snake_case
# names of the flights table, and the kind of each column.
FLIGHT_COLUMNS = (
    ("FlightDate", "flight_date", "date"),
    ("Reporting_Airline", "reporting_airline", "text"),
    ("Tail_Number", "tail_number", "text"),
    ("Flight_Number_Reporting_Airline", "flight_number", "int"),
    ("Origin", "origin", "text"),
    ("Dest", "dest", "text"),
    ("CRSDepTime", "crs_dep_time", "int"),
    ("DepTime", "dep_time", "int"),
    ("DepDelayMinutes", "dep_delay_minutes", "int"),
    ("TaxiOut", "taxi_out", "int"),
    ("WheelsOff", "wheels_off", "int"),
    ("WheelsOn", "wheels_on", "int"),
    ("TaxiIn", "taxi_in", "int"),
    ("CRSArrTime", "crs_arr_time", "int"),
    ("ArrTime", "arr_time", "int"),
    ("ArrDelayMinutes", "arr_delay_minutes", "int"),
    ("ArrDel15", "arr_del15", "flag"),
    ("Cancelled", "cancelled", "flag"),
    ("CancellationCode", "cancellation_code", "text"),
    ("Diverted", "diverted", "flag"),
    ("CRSElapsedTime", "crs_elapsed_time", "int"),
    ("ActualElapsedTime", "actual_elapsed_time", "int"),
    ("AirTime", "air_time", "int"),
    ("Distance", "distance", "int"),
    ("CarrierDelay", "carrier_delay", "int"),
    ("WeatherDelay", "weather_delay", "int"),
    ("NASDelay", "nas_delay", "int"),
    ("SecurityDelay", "security_delay", "int"),
    ("LateAircraftDelay", "late_aircraft_delay", "int"),
)

# The 18 columns of the rotation-link table.
LINK_COLUMNS = (
    ("tail_number", "text"),
    ("flight_date", "date"),
    ("reporting_airline", "text"),
    ("flight_number", "int"),
    ("origin", "text"),
    ("dest", "text"),
    ("prev_flight_date", "date"),
    ("prev_flight_number", "int"),
    ("prev_dest", "text"),
    ("crs_dep_time", "int"),
    ("prior_leg_arr_delay_minutes", "int"),
    ("dep_delay_minutes", "int"),
    ("arr_delay_minutes", "int"),
    ("late_aircraft_delay", "int"),
    ("scheduled_turnaround_min", "int"),
    ("observed_turnaround_min", "int"),
    ("propagated_delay_estimate_min", "int"),
    ("link_status", "text"),
)

# Flight columns that must never be null, and the link columns likewise.
REQUIRED_FLIGHT_COLUMNS = (
    "flight_date", "reporting_airline", "origin", "dest", "crs_dep_time", "crs_arr_time",
    "cancelled", "diverted", "distance",
)
REQUIRED_LINK_COLUMNS = (
    "tail_number", "flight_date", "reporting_airline", "origin", "dest", "crs_dep_time", "link_status",
)

# The five reported delay causes.
DELAY_CAUSES = ("carrier_delay", "weather_delay", "nas_delay", "security_delay", "late_aircraft_delay")

SOURCE_NAMES = tuple(source for source, _, _ in FLIGHT_COLUMNS)
FLIGHT_NAMES = tuple(name for _, name, _ in FLIGHT_COLUMNS)
LINK_NAMES = tuple(name for name, _ in LINK_COLUMNS)
NULLABLE_FLIGHT_COLUMNS = tuple(n for n in FLIGHT_NAMES if n not in REQUIRED_FLIGHT_COLUMNS)

FLIGHTS = T.StructType([T.StructField(name, _KINDS[kind]) for _, name, kind in FLIGHT_COLUMNS])
LINKS = T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in LINK_COLUMNS])
AIRPORTS = T.StructType([T.StructField("iata", T.StringType()), T.StructField("tz", T.StringType())])

# Calendar columns the stored tables are partitioned by.
MONTH_COLUMNS = ("flight_year", "flight_month")
