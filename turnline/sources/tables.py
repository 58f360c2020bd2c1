"""Month-partitioned Parquet tables of flights and links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnline.schema import FLIGHT_NAMES, LINK_NAMES, MONTH_COLUMNS


def with_month(table: DataFrame) -> DataFrame:
    return table.withColumns({
        MONTH_COLUMNS[0]: F.year("flight_date"),
        MONTH_COLUMNS[1]: F.month("flight_date"),
    })


def write_by_month(table: DataFrame, path: str, spread: bool = True) -> None:
    """Write the months the table holds, replacing those months and no others.

    The rebalance hint lets Spark merge small months into whole files and split a
    month that outgrows one task, however unevenly rows are spread.  Rows lie by
    origin and destination within a file, so a filter on an airport or a route
    skips most row groups; the writer has to sort by month anyway.  Without ``spread``
    the rows already lie so: whoever derives wide rows from narrow ones deals out those.
    """
    dated = with_month(table)
    (
        (dated.hint("rebalance", *MONTH_COLUMNS) if spread else dated)
        .sortWithinPartitions(*MONTH_COLUMNS, "origin", "dest")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*MONTH_COLUMNS)
        .parquet(path)
    )


def write_flights(flights: DataFrame, path: str, spread: bool = True) -> None:
    write_by_month(flights.select(*FLIGHT_NAMES), path, spread)


def write_links(links: DataFrame, path: str) -> None:
    write_by_month(links.select(*LINK_NAMES), path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def months_of(table: DataFrame) -> DataFrame:
    """The calendar months a table holds rows of."""
    if not all(name in table.columns for name in MONTH_COLUMNS):
        table = with_month(table)
    return table.select(*MONTH_COLUMNS).distinct()


def candidate_months(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    month = F.col("id")
    return spark.range(first_year * 12, (last_year + 1) * 12).select(
        (month / 12).cast("int").alias(MONTH_COLUMNS[0]),
        (month % 12 + 1).cast("int").alias(MONTH_COLUMNS[1]),
    )


def months_pending(candidates: DataFrame, table: DataFrame) -> DataFrame:
    """The candidate months of which the table has no row yet."""
    return candidates.join(months_of(table), list(MONTH_COLUMNS), "left_anti")
