"""Local clock fields, time zones and UTC arithmetic.

Everything is counted in whole seconds since the epoch, so no result depends on
the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnline.functions.numeric import int_div

DAY_SECONDS = 86_400

# Fixed value: a clock field of 2400 is midnight at the end of the day.
END_OF_DAY = 2400


def hour_of_day(hhmm: Column) -> Column:
    """Hour 0..23 of an hhmm field; 2400 belongs to hour 0."""
    return int_div(hhmm, F.lit(100)).cast("int") % 24


def wall_clock(date: Column, hhmm: Column) -> Column:
    """Epoch seconds of the clock reading, as if the clock showed UTC."""
    # 2400 div 100 is hour 24, which already lands on the next day.
    minutes = int_div(hhmm, F.lit(100)) * 60 + hhmm % 100
    return F.unix_date(date).cast("bigint") * DAY_SECONDS + minutes * 60


def reading(instant: Column, tz: Column) -> Column:
    """What a clock in the zone shows at an instant, both in epoch seconds."""
    return F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(instant), tz))


def day_offsets(date: Column, tz: Column) -> dict[str, Column]:
    """Seconds the zone is ahead of UTC a day before a date begins and a day after it ends.

    They bracket every local time of that date, 2400 included.
    """
    midnight = F.unix_date(date).cast("bigint") * DAY_SECONDS
    eve, morrow = midnight - DAY_SECONDS, midnight + 2 * DAY_SECONDS
    return {"early_offset": reading(eve, tz) - eve, "late_offset": reading(morrow, tz) - morrow}


def local_to_utc(wall: Column, tz: Column) -> Column:
    """The UTC instant at which a clock of the zone shows ``wall`` (epoch seconds), as an expression of its own.

    Null in the spring gap, in the autumn overlap and for a null zone.  Offsets of a zone differ between a day before
    and a day after by the clock change at most, so only two instants can qualify.  Over many rows of few zones and
    dates, ``with_local_to_utc`` with a calendar of ``day_offsets`` looks rules up less often.
    """
    early = wall - (reading(wall - DAY_SECONDS, tz) - (wall - DAY_SECONDS))
    late = wall - (reading(wall + DAY_SECONDS, tz) - (wall + DAY_SECONDS))
    early_fits, late_fits = reading(early, tz) == wall, reading(late, tz) == wall
    instant = F.when(early == late, F.when(early_fits, early)).when(early_fits & ~late_fits, early).when(late_fits & ~early_fits, late)
    return F.timestamp_seconds(instant)


def with_local_to_utc(rows: DataFrame, wall: Column, tz: str, into: str) -> DataFrame:
    """Add the UTC instant at which the clock of zone column ``tz`` shows ``wall`` (epoch seconds).

    ``rows`` carries the ``day_offsets`` of the local date; they leave only two
    instants that can qualify.  The result is null when neither does (spring
    gap), when both do (autumn overlap), or when the zone is null.  Away from a
    clock change both are one and the zone is not looked up again.
    """
    # Steps of their own, so that no step is computed more than once per row.
    wall_s, early, late = (F.col(name) for name in ("_wall", "_early", "_late"))
    differ = early != late
    return (
        rows.withColumn("_wall", wall)
        .withColumns({"_early": wall_s - F.col("early_offset"), "_late": wall_s - F.col("late_offset")})
        .withColumns({
            "_early_fits": F.when(differ, reading(early, F.col(tz)) == wall_s).otherwise(True),
            "_late_fits": F.when(differ, reading(late, F.col(tz)) == wall_s).otherwise(False),
        })
        .withColumn(into, F.timestamp_seconds(
            F.when(F.col("_early_fits") & ~F.col("_late_fits"), early)
            .when(F.col("_late_fits") & ~F.col("_early_fits"), late)
        ))
        .drop("_wall", "_early", "_late", "_early_fits", "_late_fits")
    )


def plus_minutes(instant: Column, minutes: Column) -> Column:
    return F.timestamp_seconds(F.unix_seconds(instant) + minutes.cast("bigint") * 60)


def minutes_between(start: Column, end: Column) -> Column:
    """Whole minutes from start to end, negative when end comes first."""
    return int_div(F.unix_seconds(end) - F.unix_seconds(start), F.lit(60)).cast("int")


def epoch_minute(instant: Column) -> Column:
    return int_div(F.unix_seconds(instant), F.lit(60))
