"""Connected components of a large edge table by alternating large-star and small-star steps.

Every step is an aggregation and a join on the node, written to the shared
folder; nothing is gathered on the driver but a count and a checksum.  Sums and
minima are combined before the shuffle, and a hub's rows join as a skewed key
that adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnline.llm.common import drop_stored, stored


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Large-star links larger neighbours, small-star the node and smaller neighbours, to the least neighbour."""
    if larger:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
    linked = both.join(least, "a")
    if larger:
        linked = linked.where("b > a").select("b", "least")
    else:
        linked = linked.select("b", "least").unionByName(least.select(F.col("a").alias("b"), "least"))
    # Edges are two numbers each: one wave of tasks writes them, in as many files as there are cores.
    cores = edges.sparkSession.sparkContext.defaultParallelism
    return linked.where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct().coalesce(cores)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label``, the least node of its component, for every node of an edge (``a``, ``b``)."""
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(now)
    while True:
        after = stored(_star(_star(now, larger=True), larger=False), "edges")
        drop_stored(now)
        now, before, state = after, state, _state(after)
        if state == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("label"))
    ).distinct()
