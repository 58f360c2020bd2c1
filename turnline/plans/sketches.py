"""Distinct counts and delay quantiles per month from stored sketches that merge, with their stated error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnline.functions.numeric import count_rows

# HyperLogLog with 2**12 registers: relative standard error 1.04 / sqrt(2**12), some 1.6 %.
HLL_BITS = 12
DISTINCT_ERROR = 3 * 1.04 / 2 ** (HLL_BITS / 2)

# KLL with this parameter: the rank of a quantile is off by less than one part in a hundred, nearly always.
KLL_K = 800
RANK_ERROR = 0.01

QUANTILES = {"median": 0.5, "p90": 0.9}


def monthly_sketches(flights: DataFrame) -> DataFrame:
    """A row per month to be stored: flights, and sketches of aircraft, routes and arrival delays (some kilobytes each).

    Sketches are combined before the shuffle, so a month costs one small row per task, however many flights it has.
    """
    route = F.concat_ws("-", "origin", "dest")
    return flights.groupBy(F.trunc("flight_date", "month").alias("month")).agg(
        count_rows().alias("flights"),
        F.hll_sketch_agg("tail_number", HLL_BITS).alias("aircraft"),
        F.hll_sketch_agg(route, HLL_BITS).alias("routes"),
        F.kll_sketch_agg_bigint(F.col("arr_delay_minutes").cast("bigint"), KLL_K).alias("delays"),
    )


def merged(sketches: DataFrame, keys: dict[str, Column] | None = None) -> DataFrame:
    """Months put together, by ``keys`` or altogether: no flight is read again."""
    return sketches.groupBy(*[value.alias(name) for name, value in (keys or {}).items()]).agg(
        F.sum("flights").alias("flights"), F.hll_union_agg("aircraft").alias("aircraft"), F.hll_union_agg("routes").alias("routes"),
        F.kll_merge_agg_bigint("delays").alias("delays"),
    )


def estimates(sketches: DataFrame, keys: tuple[str, ...] = ("month",)) -> DataFrame:
    """What sketches say: distinct aircraft and routes, and delay quantiles (null where no delay is known)."""
    known = F.kll_sketch_get_n_bigint("delays") > 0
    quantiles = [
        F.when(known, F.kll_sketch_get_quantile_bigint("delays", F.lit(share))).alias(f"{name}_delay") for name, share in QUANTILES.items()
    ]
    return sketches.select(
        *keys, "flights", F.hll_sketch_estimate("aircraft").alias("distinct_aircraft"),
        F.hll_sketch_estimate("routes").alias("distinct_routes"), *quantiles,
    )


def estimates_by_month(stored: DataFrame) -> DataFrame:
    """Estimates of every stored month, and, as ``is_total``, of all months merged."""
    total = estimates(merged(stored), ()).withColumns({"month": F.lit(None).cast("date"), "is_total": F.lit(True)})
    return estimates(stored).withColumn("is_total", F.lit(False)).unionByName(total)


def compared(stored: DataFrame, flights: DataFrame) -> DataFrame:
    """Exact counts beside the estimates, and whether these lie within the stated errors, per month and in total.

    A quantile is right if its share of rows lies between those below it and those up to it, give or take ``RANK_ERROR``.
    """
    estimated = estimates_by_month(stored).select(
        F.col("month").alias("_month"), F.col("is_total").alias("_total"), "distinct_aircraft", "distinct_routes",
        *[f"{name}_delay" for name in QUANTILES],
    )
    month, levels = F.trunc("flight_date", "month"), F.explode(F.array(F.lit(False), F.lit(True))).alias("is_total")
    delays = flights.groupBy(month.alias("month"), "arr_delay_minutes").agg(count_rows().alias("n"))
    pairs = flights.select(month.alias("month"), "tail_number", F.concat_ws("-", "origin", "dest").alias("route")).distinct()

    def at_levels(rows: DataFrame) -> DataFrame:
        both = rows.select("*", levels)
        return both.withColumn("month", F.when(~F.col("is_total"), F.col("month")))

    exact = at_levels(pairs).groupBy("month", "is_total").agg(
        F.count_distinct("tail_number").alias("exact_aircraft"), F.count_distinct("route").alias("exact_routes")
    )
    joined = exact.join(estimated, F.col("month").eqNullSafe(F.col("_month")) & (F.col("is_total") == F.col("_total"))).drop("_month", "_total")
    keyed = joined.withColumnsRenamed({"month": "_month", "is_total": "_total"})
    ranked = at_levels(delays).join(F.broadcast(keyed), F.col("month").eqNullSafe(F.col("_month")) & (F.col("is_total") == F.col("_total")))  # a row per month
    known = F.sum(F.when(F.col("arr_delay_minutes").isNotNull(), F.col("n")))

    def within(name: str) -> Column:
        value, share = F.col(f"{name}_delay"), QUANTILES[name]
        below = F.sum(F.when(F.col("arr_delay_minutes") < value, F.col("n")).otherwise(0))
        upto = F.sum(F.when(F.col("arr_delay_minutes") <= value, F.col("n")).otherwise(0))
        return F.coalesce((below <= (share + RANK_ERROR) * known) & (upto >= (share - RANK_ERROR) * known), F.lit(True))

    def near(name: str) -> Column:
        return F.abs(F.first(f"distinct_{name}") - F.first(f"exact_{name}")) <= F.greatest(F.lit(1.0), DISTINCT_ERROR * F.first(f"exact_{name}"))

    return ranked.groupBy("month", "is_total").agg(
        F.sum("n").alias("flights"), F.first("exact_aircraft").alias("exact_aircraft"), F.first("exact_routes").alias("exact_routes"),
        near("aircraft").alias("aircraft_within_error"), near("routes").alias("routes_within_error"),
        *[within(name).alias(f"{name}_within_error") for name in QUANTILES],
    )
