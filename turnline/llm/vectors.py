"""Vectors as the operators see them: valid ones only, equal ones as one."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_valid(vector: Column) -> Column:
    """Not null, without null or non-finite components, and not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def named(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``id``, ``vector`` and ``node``, a 64-bit hash of the vector; ids that are null and vectors that are not valid are left out."""
    v = F.col(vector_column).cast("array<double>")
    kept = vectors.where(F.col(id_column).isNotNull() & is_valid(v))
    # Adding zero makes minus zero and zero the same vector.
    plain = F.transform(v, lambda x: x + F.lit(0.0))
    return kept.select(F.col(id_column).cast("long").alias("id"), plain.alias("vector")).withColumn("node", F.xxhash64("vector"))


def matrix(column: pa.Array) -> np.ndarray:
    """Equally long vectors as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)
