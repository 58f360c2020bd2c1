"""As-of join: for every row the last row of another table at or before its time, by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnline.functions.numeric import int_div
from turnline.operators.sequence import HOT_ROWS, Running, hot_keys, with_running

# Width of the time slices a hot key is cut into.
SLICE_SECONDS = 600


def time_slices(time: str, seconds: int = SLICE_SECONDS) -> list[Column]:
    return [int_div(F.unix_seconds(time), F.lit(seconds))]


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[tuple[str, str]],
    left_time: str,
    right_time: str,
    carried: Sequence[str],
    prefix: str = "last_",
    strict: bool = False,
    within_seconds: int | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Every left row, with ``<prefix><name>`` of the last right row of equal keys whose time is not after its own.

    ``on`` pairs key columns of both sides; times are timestamps.  With ``strict`` the right row must be earlier;
    with ``within_seconds`` it may be no older than that.  Of right rows of the same time the one with the greatest
    carried values counts, in their order.  Left rows without a match, a key or a time keep nulls.

    Both sides are put together and sorted once, and the last right row runs along: no pair of rows is ever formed, so
    no key and no burst of arrivals makes the join grow beyond its input.  Keys with more than ``hot_rows`` rows on
    both sides together are cut into time slices; see ``sequence``.
    """
    keys = [name for name, _ in on]
    right_row = F.struct(*carried)
    known = right.dropna(subset=[*[name for _, name in on], right_time]).select(
        *[F.col(theirs).alias(f"_{ours}") for ours, theirs in on], F.col(right_time).alias("_at"), right_row.alias("_right")
    )
    can = F.lit(True)
    for name in (*keys, left_time):
        can = can & F.col(name).isNotNull()
    kind = known.schema["_right"].dataType
    asking = left.where(can).withColumns({"_asks": F.lit(True), "_at": F.col(left_time), "_right": F.lit(None).cast(kind)})
    given = known.select(
        *[F.col(f"_{name}").cast(left.schema[name].dataType).alias(name) if name in keys
          else F.lit(None).cast(left.schema[name].dataType).alias(name) for name in left.columns],
        F.lit(False).alias("_asks"), F.col("_at"), F.col("_right"),
    )
    events = asking.unionByName(given).withColumn("_seen", F.when(~F.col("_asks"), F.struct("_at", "_right")))
    # At one instant right rows come first, unless they have to be earlier.
    events = events.withColumn("_turn", F.col("_asks") != F.lit(strict))
    counted = left.select(*keys).unionByName(right.select(*[F.col(theirs).alias(ours) for ours, theirs in on]))
    hot = hot_keys(counted, keys, hot_rows)
    last = with_running(
        events, keys, ["_at", "_turn", "_right"], time_slices("_at"), hot, {"_last": Running("last", F.col("_seen"))}
    ).where("_asks")
    fresh = F.lit(True)
    if within_seconds is not None:
        fresh = F.unix_seconds("_at") - F.unix_seconds("_last._at") <= within_seconds
    found = last.select(*left.columns, *[F.when(fresh, F.col("_last._right")[name]).alias(f"{prefix}{name}") for name in carried])
    rest = left.where(~can).withColumns(
        {f"{prefix}{name}": F.lit(None).cast(found.schema[f"{prefix}{name}"].dataType) for name in carried}
    )
    return found.unionByName(rest)
