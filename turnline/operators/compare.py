"""Two loads of a table compared as bags of rows, and rows ranked over a whole table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnline.functions.numeric import count_rows

# Ranges of values that a whole table is ranked in.
RANGES = 256


def _marks(rows: DataFrame, names: Sequence[str]) -> tuple[list[Column], list[str]]:
    """What tells the values of these columns apart: two 64-bit hashes of different seed and which values are null.

    Two of n different rows share all of it with a chance of about n^2 / 2^129.  Nested columns, in which a hash would
    not see where a null stands, are given back to be compared as they are.
    """
    kinds = {name: rows.schema[name].dataType for name in names}
    nested = [name for name, kind in kinds.items() if isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType))]
    plain = [name for name in names if name not in nested]
    if not plain:
        return [], nested
    marks = [F.xxhash64(F.lit(seed), *plain).alias(f"_hash{seed}") for seed in (1, 2)]
    for first in range(0, len(plain), 60):
        nulls = F.lit(0).cast("bigint")
        for place, name in enumerate(plain[first:first + 60]):
            nulls = nulls + F.when(F.col(name).isNull(), F.lit(1 << place).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
        marks.append(nulls.alias(f"_nulls{first}"))
    return marks, nested


def bag_counts(before: DataFrame, after: DataFrame, columns: Sequence[str], shown: Sequence[str] | None = None) -> DataFrame:
    """Every different row with the number of its copies, ``n_before`` and ``n_after``.

    Copies are counted before the shuffle, so a row that occurs a million times travels once per task.  ``shown`` are the
    columns wanted of a row, all unless named; rows are still told apart by all ``columns``, but the others travel as the
    hashes of ``_marks`` only.
    """
    shown = list(columns if shown is None else shown)
    rest = [name for name in columns if name not in shown]
    both = before.select(*columns, F.lit(1).alias("_old"), F.lit(0).alias("_new")).unionByName(
        after.select(*columns, F.lit(0).alias("_old"), F.lit(1).alias("_new"))
    )
    marks, nested = _marks(both, rest)
    apart = [*shown, *nested, *[f"_hash{seed}" for seed in (1, 2) if marks], *[f"_nulls{first}" for first in range(0, 60 * (len(marks) - 2), 60)]]
    counted = both.select(*shown, *nested, *marks, "_old", "_new").groupBy(*apart)
    return counted.agg(F.sum("_old").alias("n_before"), F.sum("_new").alias("n_after")).select(*shown, "n_before", "n_after")


def bag_difference(before: DataFrame, after: DataFrame, columns: Sequence[str], shown: Sequence[str] | None = None) -> DataFrame:
    """Rows of which the two loads hold different numbers of copies, with ``n_before`` and ``n_after``.

    The rows that ``EXCEPT ALL`` gives either way, each with how often, and of them the columns ``shown``.
    """
    return bag_counts(before, after, columns, shown).where(F.col("n_before") != F.col("n_after"))


def keyed_difference(before: DataFrame, after: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """What became of every key: the keys, ``state``, and the copies ``removed``, ``added`` and ``kept``.

    ``state`` is ``added`` or ``removed`` for keys of one load only, ``unchanged`` if both hold the same bag of rows,
    else ``changed``.  Null keys are a key like any other.
    """
    counts = bag_counts(before, after, columns, keys)
    lost, won = F.greatest(F.col("n_before") - F.col("n_after"), F.lit(0)), F.greatest(F.col("n_after") - F.col("n_before"), F.lit(0))
    by_key = counts.groupBy(*keys).agg(
        F.sum("n_before").alias("_before"), F.sum("n_after").alias("_after"), F.sum(lost).alias("removed"), F.sum(won).alias("added"),
        F.sum(F.least("n_before", "n_after")).alias("kept"),
    )
    state = (
        F.when(F.col("_before") == 0, "added").when(F.col("_after") == 0, "removed")
        .when((F.col("removed") == 0) & (F.col("added") == 0), "unchanged").otherwise("changed")
    )
    return by_key.select(*keys, state.alias("state"), "removed", "added", "kept")


def with_percent_rank(rows: DataFrame, value: str, into: str = "percent_rank") -> DataFrame:
    """Add the percent rank of each row by ``value``, ascending, nulls first, and ``rank`` and ``of``, rows in all.

    A window over the whole table would be one task.  Here equal values are counted, each value gets the number of rows
    below it from sums per range of values and within its range, and rows get it back by their value.
    Values are numbers.
    """
    counted = rows.groupBy(value).agg(count_rows().alias("_n"))
    shares = [place / RANGES for place in range(1, RANGES)]
    cuts, total = counted.agg(F.percentile_approx(value, shares, 100 * RANGES), F.coalesce(F.sum("_n"), F.lit(0))).first()
    placed = _rows_below(counted, value, sorted(set(cuts or []))).select(
        F.col(value).alias("_value"), (F.col("_below") + 1).alias("rank"), F.lit(total).cast("bigint").alias("of")
    )
    joined = rows.join(placed, F.col(value).eqNullSafe(F.col("_value"))).drop("_value")
    return joined.withColumn(into, F.when(F.col("of") > 1, (F.col("rank") - 1) / (F.col("of") - 1)).otherwise(F.lit(0.0)))


def _rows_below(counted: DataFrame, value: str, cuts: list) -> DataFrame:
    """``counted`` with ``_below``, the rows of smaller values: sums within a range of values, after those of the ranges before.

    The ranges lie between approximate quantiles of the different values, a row of ``RANGES`` numbers; they decide how
    evenly the work is dealt out and nothing else.
    """
    ends = F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<double>")
    own = F.size(F.filter(ends, lambda cut: cut < F.col(value)))
    ranged = counted.withColumn("_range", F.when(F.col(value).isNull(), -1).otherwise(own))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_range").agg(F.sum("_n").alias("_rows")).select(  # RANGES + 1 rows
        "_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy("_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.withColumn("_inside", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(F.broadcast(offsets), "_range").select(
        value, "_n", (F.col("_offset") + F.col("_inside")).alias("_below")
    )
