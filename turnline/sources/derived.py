"""Flights and links derived from a data folder, stored once per session and read from there.

Deriving flights and linking rotations are the two heavy steps; everything else
reads their result, as a user would read the loaded tables.  The stored tables
lie in the session's shared folder, so a lost executor costs a re-read of files
and no rebuild.
"""

from __future__ import annotations

import hashlib
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from turnline.operators.rotation import rotation_links
from turnline.plans.ground import ground_stays
from turnline.session import shared_folder
from turnline.sources.lineitem import airports, flight_month, flights_from_lineitem, flights_of, numbered_lines
from turnline.sources.tables import read_table, write_flights, write_links

_paths: dict[tuple[str, str, str], str] = {}
_lock = threading.RLock()


def scratch_path(spark: SparkSession, data_dir: str, name: str) -> str | None:
    """A path for a derived table of this session and data folder, null without a shared folder."""
    folder = shared_folder(spark)
    if folder is None:
        return None
    digest = hashlib.sha256(data_dir.encode()).hexdigest()[:16]
    return f"{folder}/turnline/{spark.sparkContext.applicationId}/{digest}/{name}"


def _stored(
    spark: SparkSession, data_dir: str, name: str,
    build: Callable[[], DataFrame], write: Callable[[DataFrame, str], None],
) -> DataFrame:
    key = (spark.sparkContext.applicationId, data_dir, name)
    with _lock:
        if key not in _paths:
            path = scratch_path(spark, data_dir, name)
            if path is None:
                return build()
            write(build(), path)
            _paths[key] = path
        return read_table(spark, _paths[key])


def derive_flights(spark: SparkSession, data_dir: str) -> DataFrame:
    return flights_from_lineitem(spark.read.parquet(f"{data_dir}/lineitem.parquet"))


def flights(spark: SparkSession, data_dir: str) -> DataFrame:
    def spread() -> DataFrame:
        """The flights dealt out by month for the writer, as the few numbers they are derived from."""
        lines = numbered_lines(spark.read.parquet(f"{data_dir}/lineitem.parquet"))
        return flights_of(lines.withColumn("_month", flight_month(lines)).hint("rebalance", "_month"))

    if scratch_path(spark, data_dir, "flights") is None:
        return derive_flights(spark, data_dir)
    return _stored(spark, data_dir, "flights", spread, lambda rows, path: write_flights(rows, path, spread=False))


def links(spark: SparkSession, data_dir: str) -> DataFrame:
    def build() -> DataFrame:
        return rotation_links(flights(spark, data_dir), airports(spark))

    return _stored(spark, data_dir, "rotation_links", build, write_links)


def stays(spark: SparkSession, data_dir: str) -> DataFrame:
    def build() -> DataFrame:
        return ground_stays(flights(spark, data_dir), airports(spark))

    return _stored(spark, data_dir, "ground_stays", build, lambda rows, path: rows.write.mode("overwrite").parquet(path))
