"""Links kept up to date: a new load relinks the tails it touches, most of them from their last leg alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnline.operators.rotation import LEG_ORDER, TIE_BREAKS, build_links, legs_of, with_utc_times
from turnline.operators.sequence import HOT_ROWS, hot_keys
from turnline.schema import LINK_NAMES


def timed_legs(flights: DataFrame, airports: DataFrame) -> DataFrame:
    """The legs that links are built from, as they are to be stored beside the links."""
    return with_utc_times(legs_of(flights), airports)


def _place(legs: DataFrame):
    return F.struct(*[name for name in (*LEG_ORDER, *TIE_BREAKS) if name in legs.columns])


def frontier(legs: DataFrame) -> DataFrame:
    """The last leg of every tail: all that links of later legs need to know."""
    columns = [name for name in legs.columns if name != "tail_number"]
    last = F.max_by(F.struct(*columns), _place(legs)).alias("last")
    return legs.groupBy("tail_number").agg(last).select("tail_number", "last.*")


def later_frontier(known: DataFrame, new_legs: DataFrame) -> DataFrame:
    """The frontier after new legs came."""
    return frontier(known.unionByName(new_legs.select(*known.columns)))


def links_after(
    links: DataFrame, legs: DataFrame, known: DataFrame, new_legs: DataFrame, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """The link table after ``new_legs``, given the ``links``, ``legs`` and frontier ``known`` from before.

    A tail whose new legs all depart after its last known leg (a new month, as a rule) gets links for them only: they are
    linked behind that one leg, and its stored links stay.  Tails with a late or undated leg among the new ones are linked
    anew from all their legs, and their stored links go.  Every other tail is left alone; of it nothing is read but its
    links.  The result is that of a full rebuild.
    """
    columns = legs.columns
    new_legs = new_legs.select(*columns)
    first = new_legs.groupBy("tail_number").agg(F.min(_place(new_legs)).alias("_first"))
    last = known.select("tail_number", _place(known).alias("_last"))
    touched = first.join(last, "tail_number", "left").select(
        "tail_number", F.coalesce(F.col("_first") <= F.col("_last"), F.lit(False)).alias("_late")
    )
    in_order = touched.where(~F.col("_late")).select("tail_number")
    late = touched.where("_late").select("tail_number")

    begun = known.join(in_order, "tail_number", "left_semi").select(*columns, F.lit(True).alias("_known"))
    fresh = new_legs.join(in_order, "tail_number", "left_semi").select(*columns, F.lit(False).alias("_known"))
    appended = build_links(
        begun.unionByName(fresh), hot=hot_keys(new_legs, ["tail_number"], hot_rows)
    ).where(~F.col("_known")).select(*LINK_NAMES)

    again = legs.join(late, "tail_number", "left_semi").unionByName(new_legs.join(late, "tail_number", "left_semi"))
    hot = hot_keys(legs.select("tail_number").unionByName(new_legs.select("tail_number")), ["tail_number"], hot_rows)
    relinked = build_links(again, hot=hot).select(*LINK_NAMES)
    kept = links.select(*LINK_NAMES).join(late, "tail_number", "left_anti")
    return kept.unionByName(appended).unionByName(relinked)
