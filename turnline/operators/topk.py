"""Top-k rows of an aggregated table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_k(rows: DataFrame, by: str, keys: Sequence[str], k: int) -> DataFrame:
    """The k rows with the largest ``by``; missing values come last, keys break ties."""
    return rows.orderBy(F.col(by).desc_nulls_last(), *keys).limit(k)


def ranked_top_k(rows: DataFrame, by: str, keys: Sequence[str], k: int, ranking: str) -> DataFrame:
    """``top_k`` with its ``ranking`` name and a ``rank`` from 1; only the k rows are ranked."""
    order = Window.partitionBy("ranking").orderBy(F.col(by).desc_nulls_last(), *keys)
    return (
        top_k(rows, by, keys, k)
        .withColumn("ranking", F.lit(ranking))
        .withColumn("rank", F.row_number().over(order))
    )
