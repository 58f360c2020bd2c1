"""Data-quality datasets over flights and links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnline.functions.numeric import count_rows
from turnline.operators.rotation import VALID, valid_links
from turnline.schema import (
    DELAY_CAUSES, FLIGHT_NAMES, NULLABLE_FLIGHT_COLUMNS, REQUIRED_FLIGHT_COLUMNS, REQUIRED_LINK_COLUMNS,
)

# The columns that should tell any two flights apart.
FLIGHT_KEY = ("flight_date", "reporting_airline", "flight_number", "origin", "dest", "crs_dep_time")

# Fixed value: the format of an airport code.
AIRPORT_CODE = "^[A-Z]{3}$"


def _as_rows(counts: DataFrame, name: str, value: str) -> DataFrame:
    """One row per column of a one-row frame."""
    return counts.unpivot([], counts.columns, name, value)


def _null_counts(table: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    counts = table.agg(*[F.count_if(F.col(name).isNull()).alias(name) for name in columns])
    return _as_rows(counts, "column_name", "null_rows")


def _checks(table: DataFrame, checks: dict[str, Column]) -> DataFrame:
    return _as_rows(table.agg(*[F.count_if(p).alias(name) for name, p in checks.items()]), "check_name", "bad_rows")


def month_coverage(flights: DataFrame) -> DataFrame:
    """Rows per month and in total; ``is_total`` tells the total from the rows without a date."""
    month = F.trunc("flight_date", "month").alias("month")
    by_month = flights.groupBy(month).agg(count_rows().alias("flights"))
    return by_month.rollup("month").agg(
        (F.grouping("month") == 1).alias("is_total"), F.sum("flights").alias("flights")
    )


def required_nulls(flights: DataFrame) -> DataFrame:
    return _null_counts(flights, REQUIRED_FLIGHT_COLUMNS)


def required_link_nulls(links: DataFrame) -> DataFrame:
    return _null_counts(links, REQUIRED_LINK_COLUMNS)


def nullable_profile(flights: DataFrame) -> DataFrame:
    return _null_counts(flights, NULLABLE_FLIGHT_COLUMNS)


def _counted_by_hash(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``n`` rows per different combination of the columns' values.

    Combinations are told apart by two 64-bit hashes of different seed and by which of their values are null, so only
    those are shuffled, however wide the rows; equal rows are combined before.  Two of n different combinations share
    all of it with a chance of about n^2 / 2^129.
    """
    nulls = F.lit(0)
    for place, name in enumerate(columns):
        nulls = nulls + F.when(F.col(name).isNull(), F.lit(1 << place).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    hashes = [F.xxhash64(F.lit(seed), *columns).alias(f"_hash{seed}") for seed in (1, 2)]
    return rows.select(nulls.alias("_nulls"), *hashes).groupBy("_nulls", "_hash1", "_hash2").agg(count_rows().alias("n"))


def full_row_duplicates(flights: DataFrame) -> DataFrame:
    """Rows beyond the first of each set of equal rows."""
    extra = F.sum(F.col("n") - 1)
    return _counted_by_hash(flights, FLIGHT_NAMES).agg(F.coalesce(extra, F.lit(0)).alias("duplicate_rows"))


def key_duplicates(flights: DataFrame) -> DataFrame:
    """Flight keys that occur more than once, and the rows that share them."""
    return _counted_by_hash(flights, FLIGHT_KEY).where(F.col("n") > 1).agg(
        count_rows().alias("duplicate_keys"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows_sharing_a_key"),
    )


def domain_violations(flights: DataFrame, year: int = 2024) -> DataFrame:
    return _checks(flights, {
        "bad_origin_code": ~F.col("origin").rlike(AIRPORT_CODE),
        "bad_dest_code": ~F.col("dest").rlike(AIRPORT_CODE),
        "nonpositive_distance": F.col("distance") <= 0,
        "outside_year": F.year("flight_date") != year,
        "negative_dep_delay": F.col("dep_delay_minutes") < 0,
        "negative_arr_delay": F.col("arr_delay_minutes") < 0,
    })


def cause_consistency(flights: DataFrame) -> DataFrame:
    """Flights whose five causes are only partly reported, or reported without a 15-minute delay."""
    reported = F.lit(0)
    for name in DELAY_CAUSES:
        reported = reported + F.col(name).isNotNull().cast("int")
    return _checks(flights, {
        "causes_partly_reported": (reported > 0) & (reported < len(DELAY_CAUSES)),
        "causes_without_delay": (reported > 0) & ~F.coalesce(F.col("arr_delay_minutes") >= 15, F.lit(False)),
    })


def cancel_divert(flights: DataFrame) -> DataFrame:
    return flights.agg(
        F.count_if("cancelled").alias("cancelled_flights"), F.count_if("diverted").alias("diverted_flights")
    )


def link_status_report(links: DataFrame) -> DataFrame:
    """Links per status and, under ``total``, altogether."""
    by_status = links.groupBy("link_status").agg(count_rows().alias("links"))
    return by_status.rollup("link_status").agg(F.sum("links").alias("links")).select(
        F.coalesce("link_status", F.lit("total")).alias("link_status"), "links"
    )


def valid_link_invariants(links: DataFrame) -> DataFrame:
    """Valid links without an input of the estimate, or with a negative estimate; both should be 0."""
    missing = F.col("scheduled_turnaround_min").isNull() | F.col("observed_turnaround_min").isNull()
    missing = missing | F.col("prior_leg_arr_delay_minutes").isNull()
    return _checks(valid_links(links), {
        "missing_inputs": missing | F.col("propagated_delay_estimate_min").isNull(),
        "negative_estimate": F.col("propagated_delay_estimate_min") < 0,
    })


def summary(flights: DataFrame, links: DataFrame) -> DataFrame:
    """The headline checks as rows: flight rows, months present, valid links."""
    months = F.count_distinct(F.trunc("flight_date", "month"))
    flight_rows = _as_rows(flights.agg(count_rows().alias("flight_rows"), months.alias("months_present")), "check_name", "result")
    link_rows = _as_rows(
        links.agg(
            count_rows().alias("tail_known_flights"),
            F.count_if(F.col("link_status") == VALID).alias("valid_links"),
        ),
        "check_name", "result",
    )
    return flight_rows.unionByName(link_rows)


def report(flights: DataFrame, links: DataFrame) -> DataFrame:
    """Every check as a row ``check_name``, ``result``: sizes, nulls, duplicates, domains, consistency, links."""

    def named(checks: DataFrame) -> DataFrame:
        name, value = checks.columns
        return checks.select(F.col(name).alias("check_name"), F.col(value).cast("bigint").alias("result"))

    def totalled(nulls: DataFrame, name: str) -> DataFrame:
        return nulls.agg(F.sum("null_rows").alias("result")).select(F.lit(name).alias("check_name"), "result")

    def as_checks(row: DataFrame) -> DataFrame:
        return _as_rows(row, "check_name", "result")

    parts = [
        summary(flights, links),
        totalled(required_nulls(flights), "required_flight_nulls"), totalled(required_link_nulls(links), "required_link_nulls"),
        as_checks(full_row_duplicates(flights)), as_checks(key_duplicates(flights)), as_checks(cancel_divert(flights)),
        *[named(checks) for checks in (domain_violations(flights), cause_consistency(flights), valid_link_invariants(links))],
    ]
    whole, *rest = parts
    for part in rest:
        whole = whole.unionByName(part)
    return whole


def set_aside(flights: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Flights that hold all required columns, and the others with the names of what they lack in ``missing``.

    Nothing is lost: every row is in one of the two.
    """
    lacking = F.filter(
        F.array(*[F.when(F.col(name).isNull(), F.lit(name)) for name in REQUIRED_FLIGHT_COLUMNS]), lambda name: name.isNotNull()
    )
    marked = flights.withColumn("missing", F.array_join(lacking, ","))
    return marked.where("missing = ''").drop("missing"), marked.where("missing <> ''")
