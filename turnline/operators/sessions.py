"""Sessions: rows of a key that follow each other without a gap, and sessions that late rows extend or join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnline.functions.numeric import int_div
from turnline.operators.sequence import HOT_ROWS, Running, hot_keys, placed, with_running

# A hot key's spans are cut into slices of this width (a day, where the unit is a minute).
SLICE_WIDTH = 1440


def sessions(
    spans: DataFrame, keys: Sequence[str], start: str, end: str, gap: int, totals: dict[str, Column],
    hot_rows: int = HOT_ROWS, slice_width: int = SLICE_WIDTH,
) -> DataFrame:
    """A row per session: the keys, ``start``, ``end`` and the totals.

    Spans (whole numbers, ``start <= end``) of a key belong together while none begins more than ``gap`` after the
    latest end before it; spans may overlap or lie within each other.  Spans without a start or an end are left out.
    Totals are aggregates of the spans' columns.  Since sessions are spans themselves, sessions of stored sessions and
    late spans are what a rebuild of all spans gives; see ``merged``.

    The latest end before a span and the number of its session are running values, so a hot key is cut into slices like
    any other scan, and sessions run across them.
    """
    rows = spans.dropna(subset=[*keys, start, end]).withColumns({start: F.col(start).cast("bigint"), end: F.col(end).cast("bigint")})
    slices = [int_div(F.col(start), F.lit(slice_width)) - (F.col(start) < 0).cast("int")]
    hot = hot_keys(spans, keys, hot_rows)
    order = [start, end]
    rows = placed(rows, keys, slices, hot)
    reached = with_running(rows, keys, order, slices, hot, {"_reach": Running("max", F.col(end), before=True)})
    # Of spans with equal start and end the one that begins a session comes first.
    late = F.coalesce(F.col(start) - F.col("_reach") <= gap, F.lit(False)).cast("int")
    numbered = with_running(
        reached.withColumn("_goes_on", late), keys, [*order, "_goes_on"], slices, hot,
        {"_session": Running("sum", 1 - F.col("_goes_on"))},
    )
    return numbered.groupBy(*keys, "_session").agg(
        F.min(start).alias(start), F.max(end).alias(end), *[total.alias(name) for name, total in totals.items()]
    ).drop("_session")


def merged(
    stored: DataFrame, late: DataFrame, keys: Sequence[str], start: str, end: str, gap: int, sums: Sequence[str],
    hot_rows: int = HOT_ROWS, slice_width: int = SLICE_WIDTH,
) -> DataFrame:
    """Stored sessions after late spans came: those that a late span touches grow or join, the others stay.

    Both sides hold the keys, ``start``, ``end`` and the ``sums``, of one late span or of a session.  Only the keys that
    late spans have are looked at again.
    """
    columns = [*keys, start, end, *sums]
    touched = late.select(*keys).dropna().distinct()
    before = stored.select(*columns)
    again = sessions(
        before.join(touched, list(keys), "left_semi").unionByName(late.select(*columns)), keys, start, end, gap,
        {name: F.sum(name) for name in sums}, hot_rows, slice_width,
    )
    return before.join(touched, list(keys), "left_anti").unionByName(again.select(*columns))
