"""Flights derived from an order-line table, so that every job runs on given data.

The derivation is whole-number arithmetic on row content alone; any engine gets
the same flights.  An aircraft is a supplier and a third of its orders; the
aircraft's lines in shipping order are its flights.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnline.functions.numeric import int_div
from turnline.operators.rotation import computed_once
from turnline.operators.sequence import HOT_ROWS, hot_keys, with_row_number
from turnline.schema import FLIGHT_NAMES

# Time zones of the derived airports, as (last letter, zone), A to Z.
# Airport Y has no known zone.
AIRPORT_ZONES = (
    ("L", "America/New_York"),
    ("R", "America/Chicago"),
    ("T", "America/Denver"),
    ("U", "America/Phoenix"),
    ("W", "America/Los_Angeles"),
    ("X", "Pacific/Honolulu"),
    ("Y", None),
    ("Z", "America/New_York"),
)

# Fixed value: four-flight rounds after which an aircraft's calendar starts over, some 40 years.
# An aircraft of any number of lines so stays within real dates.
CALENDAR_ROUNDS = 2656

_AIRCRAFT = ("l_suppkey", "order_third")
_SHIPPING_ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")


def airports(spark: SparkSession) -> DataFrame:
    """``airports(iata, tz)`` for the codes the derivation uses."""
    letter = F.char(F.col("id") + 65)
    (last, zone), *rest = AIRPORT_ZONES
    tz = F.when(letter <= last, zone)
    for last, zone in rest:
        tz = tz.when(letter <= last, zone)
    return spark.range(0, 26, 1, 1).select(F.concat(letter, F.lit("AA")).alias("iata"), tz.alias("tz"))


def _code(number: Column, tail: str) -> Column:
    return F.concat(F.char(number + 65), F.lit(tail))


def flights_from_lineitem(lineitem: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    return flights_of(numbered_lines(lineitem, hot_rows))


def numbered_lines(lineitem: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The few numbers of each order line that its flight follows from: its place ``n`` among its aircraft's lines is one."""
    lines = lineitem.select(
        "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_shipdate",
        "l_discount", "l_tax", (F.col("l_orderkey") % 3).alias("order_third"),
    )
    shipped = F.col("l_shipdate").isNotNull()
    day = F.when(shipped, F.unix_date(F.col("l_shipdate").cast("date"))).otherwise(0)
    hot = hot_keys(lines, _AIRCRAFT, hot_rows)
    numbered = with_row_number(lines, _AIRCRAFT, _SHIPPING_ORDER, [shipped, day], "number", hot)

    return numbered.select(
        F.col("l_quantity").cast("int").alias("q"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("c"),
        F.round(F.col("l_discount") * 100).cast("int").alias("d"),
        F.round(F.col("l_tax") * 100).cast("int").alias("x"),
        (F.col("l_suppkey") * 3 + F.col("order_third")).cast("int").alias("t"),
        (F.col("number") - 1).alias("n"),
        (F.col("l_partkey") % 2400 + 100).cast("int").alias("distance"),
    )


def _day(n: Column) -> Column:
    return int_div(n, F.lit(4)) % CALENDAR_ROUNDS


def _flight_date(day: Column, t: Column) -> Column:
    return F.date_add(F.lit("2024-01-01").cast("date"), (day + int_div(day, F.lit(2)) * 9 + t % 11).cast("int"))


def flight_month(lines: DataFrame) -> Column:
    """The month in which the flight of a numbered line lies."""
    return F.trunc(_flight_date(_day(F.col("n")), F.col("t")), "month")


def flights_of(lines: DataFrame) -> DataFrame:
    """A flight per numbered line, row by row.

    Steps are kept apart by ``computed_once``: all of them in one generated method are too long for the JVM to compile.
    """
    div, when = int_div, F.when
    n, t, q, c, d, x = (F.col(name) for name in "ntqcdx")
    base = computed_once(lines.select("q", "c", "d", "x", "t", "n", "distance"))
    sched = when(c % 101 == 0, 2400).otherwise((n % 4 * 5 + 1 + t % 3) * 100 + c % 60)
    legs = base.withColumns({
        "dn": _day(n),
        "o": when(c % 89 == 0, 25).otherwise((t * 7 + n * 5) % 25),
        "s": (t * 7 + (n + 1) * 5) % 25,
        "dd": F.greatest(F.lit(0), (c % 400 - 300) * 2),
        "el": (t * 3 + n * 11) % 100 + 80,
        "cancelled": c % 71 == 0,
        "diverted": c % 83 == 0,
        "crs_dep_time": sched.cast("int"),
    })
    flown = ~F.col("cancelled") & ~F.col("diverted")
    timed = computed_once(legs).withColumns({
        "ad": when(flown, F.greatest(F.lit(0), F.col("dd") + d * 3 - 10)),
        "crs_arr_time": (
            (div(F.col("crs_dep_time"), F.lit(100)) + 2) % 24 * 100 + F.col("crs_dep_time") % 100
        ).cast("int"),
        "actual_elapsed_time": when(flown & (c % 103 != 0), F.col("el") + d * 3 - 10).cast("int"),
    })
    ad = F.col("ad")
    late, odd = ad >= 15, q % 2 == 1
    causes = computed_once(timed).withColumns({
        "sec": when(late, when(q % 25 == 0, 1).otherwise(0)),
        "wx": when(late, div(ad * (d % 3), F.lit(20))),
        "nas": when(late, div(ad * (x % 3), F.lit(10))),
        "car0": when(late & odd, div(ad * (q % 4), F.lit(10))),
    })
    rest = ad - F.col("wx") - F.col("nas") - F.col("sec")
    flights = computed_once(causes).select(
        _flight_date(F.col("dn"), t).alias("flight_date"),
        _code(t % 7, "A").alias("reporting_airline"),
        when(c % 97 != 0, F.concat(F.lit("N"), t.cast("string"))).alias("tail_number"),
        (n % 900 + 100).alias("flight_number"),
        _code(F.col("o"), "AA").alias("origin"),
        _code(F.col("s"), "AA").alias("dest"),
        "crs_dep_time",
        when(~F.col("cancelled"), F.col("crs_dep_time")).alias("dep_time"),
        when(~F.col("cancelled"), F.col("dd")).alias("dep_delay_minutes"),
        when(~F.col("cancelled"), q % 20 + 5).alias("taxi_out"),
        F.lit(None).alias("wheels_off"),
        F.lit(None).alias("wheels_on"),
        when(flown, d + 3).alias("taxi_in"),
        "crs_arr_time",
        when(flown, F.col("crs_arr_time")).alias("arr_time"),
        ad.alias("arr_delay_minutes"),
        late.alias("arr_del15"),
        "cancelled",
        when(F.col("cancelled"), F.char(q % 4 + 65)).alias("cancellation_code"),
        "diverted",
        F.col("el").alias("crs_elapsed_time"),
        "actual_elapsed_time",
        (F.col("actual_elapsed_time") - 20).alias("air_time"),
        "distance",
        when(odd, F.col("car0")).when(late, rest).alias("carrier_delay"),
        F.col("wx").alias("weather_delay"),
        F.col("nas").alias("nas_delay"),
        F.col("sec").alias("security_delay"),
        when(late & odd, rest - F.col("car0")).when(late, 0).alias("late_aircraft_delay"),
    )
    numbers = [name for name, kind in flights.dtypes if kind in ("bigint", "void")]
    return flights.withColumns({name: F.col(name).cast("int") for name in numbers}).select(*FLIGHT_NAMES)
