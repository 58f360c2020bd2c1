"""Scans along an ordered key: previous row, running number, running sums, maxima and last values, without one task per key.

A plain window sends all rows of a key to one task.  A key with more rows than
``hot_rows`` is therefore cut along its own order into time slices: the window
runs by key and slice, and what a slice has to know of the slices before it is
worked out from one small row per slice and joined to it.  Ordinary keys are one
slice.  It is one plan for all keys: hot keys are found within it, and while there
are none, the part that carries results from slice to slice has no rows to read.

The hot keys are broadcast: there is at most one per ``hot_rows`` rows of input.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from turnline.functions.numeric import count_rows

# A key up to this many rows is left to one task, which spills if need be.  At 2 million
# rows a task took some 6 seconds, and cutting the key cost more than it saved.
HOT_ROWS = 4_000_000


def hot_keys(rows: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """The keys with more than ``hot_rows`` rows.  Null keys are never hot."""
    counted = rows.select(*keys).dropna().groupBy(*keys).agg(count_rows().alias("_rows"))
    return counted.where(F.col("_rows") > hot_rows).select(*keys, F.lit(True).alias("_hot"))


def _names(slices: Sequence[Column]) -> list[str]:
    return [f"_slice{position}" for position in range(len(slices))]


def _sliced(rows: DataFrame, keys: Sequence[str], slices: Sequence[Column], hot: DataFrame, how: str) -> DataFrame:
    marked = rows.join(F.broadcast(hot), list(keys), how)
    return marked.withColumns({name: F.when(F.col("_hot"), value) for name, value in zip(_names(slices), slices)})


def placed(rows: DataFrame, keys: Sequence[str], slices: Sequence[Column], hot: DataFrame) -> DataFrame:
    """Rows with the slice they lie in, which is null for ordinary keys.

    The functions below do this themselves.  Where several follow each other, place the rows first: the columns are
    then kept, and one shuffle serves all of them.
    """
    return rows if "_hot" in rows.columns else _sliced(rows, keys, slices, hot, "left")


def unplaced(rows: DataFrame, slices: Sequence[Column]) -> DataFrame:
    return rows.drop("_hot", *_names(slices))


def _ascending(names: Sequence[str]) -> list[Column]:
    return [F.col(name).asc_nulls_first() for name in names]


def _before_each_slice(
    rows: DataFrame, keys: Sequence[str], slices: Sequence[Column], hot: DataFrame,
    totals: dict[str, Column], gathered: Callable[[str, WindowSpec], Column],
) -> DataFrame:
    """For every slice of a hot key, what the slices before it leave: ``totals`` per slice, then ``gathered`` along the key."""
    names = _names(slices)
    per_slice = _sliced(unplaced(rows, slices), keys, slices, hot, "inner").groupBy(*keys, *names).agg(
        *[total.alias(name) for name, total in totals.items()]
    )
    # One small row per slice, and a key has no more slices than its calendar has.
    by_key = Window.partitionBy(*keys).orderBy(*names)
    return per_slice.select(*keys, *names, *[gathered(name, by_key).alias(name) for name in totals])


def with_previous(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    carried: Sequence[str],
    slices: Sequence[Column],
    hot: DataFrame,
) -> DataFrame:
    """Add ``prev_<name>`` for each carried column, and ``has_prev``, from the row before in its key.

    Rows are ordered by the ``order`` columns ascending, nulls first.  ``slices``
    must rise along that order; they are used for the keys in ``hot`` only, which
    comes from ``hot_keys``.  Slices may not be null.
    """
    names = _names(slices)
    here = Window.partitionBy(*keys, *names).orderBy(*_ascending(order))
    # One window for all of them.  Plain columns, not a struct, so that nothing is shuffled twice.
    found = F.coalesce(F.lag(F.lit(True), 1).over(here), F.lit(False))
    lags = {f"prev_{name}": F.lag(name, 1).over(here) for name in carried}
    inside = placed(rows, keys, slices, hot).withColumns({"has_prev": found, **lags})

    # The first row of a slice follows the last row of the slice before it.
    last = F.max_by(F.struct(*carried), F.struct(*order))
    before = _before_each_slice(rows, keys, slices, hot, {"_last": last}, lambda name, w: F.lag(name, 1).over(w))
    joined = inside.join(before, [*keys, *names], "left")
    carry = F.col("_hot") & ~F.col("has_prev")
    return joined.select(
        *[F.col(name) for name in rows.columns],
        (F.col("has_prev") | F.col("_last").isNotNull()).alias("has_prev"),
        *[F.when(carry, F.col("_last")[name]).otherwise(F.col(f"prev_{name}")).alias(f"prev_{name}") for name in carried],
    )


@dataclass(frozen=True)
class Running:
    """A running ``sum``, ``max`` or ``last`` (not null) value, up to and including the row, or up to the one before it."""

    kind: str
    value: Column
    before: bool = False

    def over(self, window: WindowSpec) -> Column:
        if self.kind == "last":
            return F.last(self.value, ignorenulls=True).over(window)
        return {"sum": F.sum, "max": F.max}[self.kind](self.value).over(window)

    def of_slice(self, order: Sequence[str]) -> Column:
        if self.kind == "last":
            return F.max_by(self.value, F.when(self.value.isNotNull(), F.struct(*order)))
        return {"sum": F.sum, "max": F.max}[self.kind](self.value)

    def gathered(self, name: str, slices_before: WindowSpec) -> Column:
        return Running(self.kind, F.col(name)).over(slices_before)

    def combined(self, before: Column, inside: Column) -> Column:
        if self.kind == "sum":
            return F.when(before.isNull(), inside).otherwise(before + F.coalesce(inside, before - before))
        return F.coalesce(inside, before) if self.kind == "last" else F.greatest(before, inside)


def with_running(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    slices: Sequence[Column],
    hot: DataFrame,
    totals: dict[str, Running],
) -> DataFrame:
    """Add the running totals of each key's rows in ascending order, nulls first; see ``with_previous``.

    Rows of equal order are taken one after the other: give an order that tells rows apart wherever it matters.
    """
    names = _names(slices)
    along = Window.partitionBy(*keys, *names).orderBy(*_ascending(order))
    inside = placed(rows, keys, slices, hot).withColumns({
        name: total.over(along.rowsBetween(Window.unboundedPreceding, -1 if total.before else 0)) for name, total in totals.items()
    })
    before = _before_each_slice(
        rows, keys, slices, hot, {f"_{name}_before": total.of_slice(order) for name, total in totals.items()},
        lambda name, w: totals[name[1:-7]].gathered(name, w.rowsBetween(Window.unboundedPreceding, -1)),
    )
    joined = inside.join(before, [*keys, *names], "left")
    return joined.select(
        *[F.col(name) for name in rows.columns],
        *[total.combined(F.col(f"_{name}_before"), F.col(name)).alias(name) for name, total in totals.items()],
    )


def with_row_number(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    slices: Sequence[Column],
    into: str,
    hot: DataFrame,
) -> DataFrame:
    """Number the rows of each key from 1 in ascending order, nulls first; see ``with_previous``."""
    one = Running("sum", F.lit(1).cast("bigint"))
    return with_running(rows, keys, order, slices, hot, {into: one})
