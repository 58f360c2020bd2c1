"""The 18-column link table as CSV, for tools that do not read Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnline.schema import LINK_COLUMNS, LINK_NAMES
from turnline.sources.flights_csv import with_whole_numbers


def write_links_csv(links: DataFrame, path: str) -> None:
    links.select(*LINK_NAMES).write.mode("overwrite").option("header", True).csv(path)


def read_links_csv(spark: SparkSession, path: str) -> DataFrame:
    """Typed links; numbers may come as ``23`` or ``23.0``, an empty field is null."""
    raw = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    missing = [name for name in LINK_NAMES if name not in raw.columns]
    if missing:
        raise ValueError(f"columns missing from {path}: {', '.join(missing)}")

    numbered = with_whole_numbers(raw.select(*LINK_NAMES), [name for name, kind in LINK_COLUMNS if kind == "int"])
    return numbered.select(*[F.to_date(name).alias(name) if kind == "date" else name for name, kind in LINK_COLUMNS])
