"""Delay carried along an aircraft's whole chain of legs, not one leg to the next only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnline.operators.rotation import (
    LEG_ORDER, TIE_BREAKS, VALID, build_links, leg_slices, legs_of, with_utc_times,
)
from turnline.operators.sequence import HOT_ROWS, Running, hot_keys, placed, unplaced, with_running


def own_delay(arr_delay: Column, late_aircraft_delay: Column) -> Column:
    """Minutes of arrival delay that a leg did not inherit: what is not reported as due to a late aircraft."""
    return F.when(arr_delay.isNotNull(), F.greatest(F.lit(0), arr_delay - F.coalesce(late_aircraft_delay, F.lit(0))))


def with_carried_delay(legs: DataFrame, hot: DataFrame) -> DataFrame:
    """Add ``carried_delay_min`` and ``legs_carried`` to linked legs (``build_links``) placed by tail.

    Over a valid link, what reaches a leg is what reached the leg before it and that leg's own delay, less the scheduled
    turnaround, and never less than 0; any other link starts a new chain at 0.  ``legs_carried`` counts the links over
    which the delay came.

    Such a recursion is a scan in max-plus algebra: with S the running sum of the gains, the carried delay is S less
    the least S since the chain began.  Sums and maxima of slices combine, so a hot tail is cut like any other; a pair
    (chain, value) makes the maximum start over with each chain.
    """
    links = F.col("link_status") == VALID
    gain = F.col("prev_own_delay_min") - F.col("available_turnaround_buffer_min")
    rows = legs.withColumn("_gain", F.when(links, F.coalesce(gain, F.lit(0))).otherwise(0).cast("bigint")).withColumn(
        "_starts", F.when(links & gain.isNotNull(), 0).otherwise(1)
    )
    order = [name for name in (*LEG_ORDER, *TIE_BREAKS) if name in rows.columns]
    slices = leg_slices()
    summed = with_running(rows, ["tail_number"], order, slices, hot, {
        "_sum": Running("sum", F.col("_gain")), "_chain": Running("sum", F.col("_starts")),
        "_place": Running("sum", F.lit(1).cast("bigint")),
    })
    low = F.struct(F.col("_chain").alias("chain"), (-F.col("_sum")).alias("value"), F.col("_place").alias("place"))
    scanned = with_running(summed, ["tail_number"], order, slices, hot, {"_low": Running("max", low)})
    return scanned.withColumns({
        "carried_delay_min": F.col("_sum") + F.col("_low.value"),
        "legs_carried": F.col("_place") - F.col("_low.place"),
    }).drop("_gain", "_starts", "_sum", "_chain", "_place", "_low")


def carried_delays(flights: DataFrame, airports: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every leg of a known aircraft with its link status, the one-leg estimate, and the delay its chain carries to it."""
    legs = legs_of(flights)
    hot = hot_keys(legs, ["tail_number"], hot_rows)
    timed = placed(with_utc_times(legs, airports), ["tail_number"], leg_slices(), hot)
    own = timed.withColumn("own_delay_min", own_delay(F.col("arr_delay_minutes"), F.col("late_aircraft_delay")))
    linked = build_links(own, hot=hot, more_carried=("own_delay_min",))
    return unplaced(with_carried_delay(linked, hot), leg_slices()).select(
        "tail_number", "flight_date", "reporting_airline", "flight_number", "origin", "dest", "crs_dep_time", "link_status",
        "propagated_delay_estimate_min", "carried_delay_min", "legs_carried",
    )


def by_depth(carried: DataFrame) -> DataFrame:
    """Legs and minutes by the number of links a delay came over."""
    return carried.where("carried_delay_min > 0").groupBy("legs_carried").agg(
        F.count("*").alias("legs"), F.sum("carried_delay_min").alias("carried_minutes"), F.max("carried_delay_min").alias("most_minutes"),
    )
