"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

The weight of a source is its share of all tokens raised to an exponent and
normalised.  The exponent between 0 and 1 is found by bisection: the largest
whose weights have the target entropy (as a part of the largest possible), but
none so small that a source would be repeated more often than the limit.

A source's budget, its weight times the token budget, is dealt out in blocks.
A full block holds every document once; the last block holds the documents that
come first in a seeded permutation, as long as they fit what is left.  Where the
permutation is cut is found from sums per hash bucket and, within the one bucket
that the cut falls into, from sums per hash; no source is sorted in one task.

Tokens are words (``[^\\x20\\x09-\\x0D]+``).  Null texts have none.  A null source
is a source of its own.  A source without tokens has no weight and no rows.
Rows of equal source and id are taken or left together, ties in the permutation likewise.  Texts of any length are
counted whole.  An empty table gives no rows.  Kept columns may have any names; working columns get others.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnline.llm.common import fresh, stored

WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 4096
#: Hash values lie below 2**60.
HASH_BITS = 60
#: Sources whose totals the driver works with at most.
MAX_SOURCES = 1_000_000


@dataclass(frozen=True)
class Mix:
    target_entropy: float = 0.95
    max_repeats: float = 4.0
    #: Tokens to realise, as a part of all tokens.
    budget_share: float = 1.0
    seed: str = "mix"


def weights_at(totals: list[int], exponent: float) -> list[float]:
    whole = sum(totals)
    raised = [(t / whole) ** exponent if t else 0.0 for t in totals]
    norm = sum(raised)
    return [r / norm for r in raised]


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def solve_exponent(totals: list[int], mix: Mix) -> float:
    """To six digits."""
    live = [t for t in totals if t]
    if len(live) < 2:
        return 1.0
    budget, most = mix.budget_share * sum(live), math.log(len(live))

    def flat(exponent: float) -> bool:
        return entropy(weights_at(live, exponent)) >= mix.target_entropy * most

    def sparing(exponent: float) -> bool:
        return all(w * budget <= mix.max_repeats * t for w, t in zip(weights_at(live, exponent), live))

    def bisect(low: float, high: float, keep_low) -> float:
        for _ in range(40):
            middle = (low + high) / 2
            low, high = (middle, high) if keep_low(middle) else (low, middle)
        return low

    largest_flat = 1.0 if flat(1.0) else bisect(0.0, 1.0, flat)
    least_sparing = 0.0 if sparing(0.0) else 1 - bisect(0.0, 1.0, lambda x: sparing(1 - x))
    return round(max(largest_flat, least_sparing), 6)


def permuted(source: Column, doc: Column, seed: str) -> Column:
    text = F.concat_ws("|", F.lit(seed), F.coalesce(source.cast("string"), F.lit("\\N")), F.coalesce(doc.cast("string"), F.lit("\\N")))
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def plan(docs: DataFrame, mix: Mix = Mix(), id_column: str = "doc_id", source_column: str = "source", text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """What is known of each row (id, source, ``n_tokens``, ``order_key``), stored, and a row per source with its
    ``weight``, number of full ``blocks`` and the ``cut`` below which a row has one copy more."""
    spark = docs.sparkSession
    rows = stored(docs.select(
        F.col(id_column).alias("doc_id"), F.col(source_column).cast("string").alias("source"),
        F.regexp_count(F.coalesce(text_column, F.lit("")), F.lit(WORD)).cast("long").alias("n_tokens"),
        permuted(F.col(source_column), F.col(id_column), mix.seed).alias("order_key"),
    ), "mix-rows")
    bucket = F.shiftright("order_key", HASH_BITS - BUCKETS.bit_length() + 1)
    buckets = stored(rows.groupBy("source", bucket.alias("bucket")).agg(F.sum("n_tokens").alias("tokens")), "mix-buckets")
    totals = buckets.groupBy("source").agg(F.sum("tokens").alias("total")).orderBy("source").limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sizes = [r.total for r in totals]
    weights = weights_at(sizes, solve_exponent(sizes, mix)) if any(sizes) else [0.0] * len(sizes)
    budgets = [math.floor(w * mix.budget_share * sum(sizes)) for w in weights]
    sources = spark.createDataFrame(
        [(r.source, r.total, w, b // r.total if r.total else 0, b % r.total if r.total else 0)
         for r, w, b in zip(totals, weights, budgets)],
        "source string, total long, weight double, blocks long, rest long",
    )

    def cut(sums: DataFrame, key: str, rest: str) -> DataFrame:
        """Running sums in order of the key, within a source."""
        upto = Window.partitionBy("source").orderBy(key)
        before = F.sum("tokens").over(upto) - F.col("tokens")
        return sums.withColumn("before", before).where((F.col("before") <= F.col(rest)) & (F.col(rest) < F.col("before") + F.col("tokens")))

    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    crossed = cut(buckets.join(F.broadcast(sources), same(buckets, sources)).select(buckets["*"], "rest"), "bucket", "rest").select(
        "source", "bucket", (F.col("rest") - F.col("before")).alias("left")
    )
    inner = rows.withColumn("bucket_", bucket).join(
        crossed.withColumnRenamed("source", "source_"),
        F.col("source").eqNullSafe(F.col("source_")) & (F.col("bucket_") == F.col("bucket")),
    )
    sums = inner.groupBy("source", "order_key").agg(F.sum("n_tokens").alias("tokens"), F.first("left").alias("left"))
    # The cut is the hash of the first row that does not fit.
    cuts = cut(sums, "order_key", "left").groupBy("source").agg(F.min("order_key").alias("cut"))
    placed = sources.join(cuts, same(sources, cuts), "left").select(
        sources["source"], "weight", "blocks", F.coalesce("cut", F.lit(0)).alias("cut")
    )
    return rows, stored(placed.coalesce(1), "mix-plan")


def realise(
    rows: DataFrame, placed: DataFrame, order_key: Column, kept: list[str], source_column: str = "source",
    copy_column: str = "copy", weight_column: str = "weight",
) -> DataFrame:
    """The kept columns once per copy, with the number of the block (0 is the first) and the source's weight."""
    source, weight, blocks, cut, own, place, copies = fresh(
        kept, "mix_source", "mix_weight", "mix_blocks", "mix_cut", "row_source", "row_key", "mix_copies"
    )
    named = placed.select(
        F.col("source").alias(source), F.col("weight").alias(weight), F.col("blocks").alias(blocks), F.col("cut").alias(cut)
    )
    joined = rows.select(*kept, F.col(source_column).cast("string").alias(own), order_key.alias(place)).join(
        F.broadcast(named), F.col(own).eqNullSafe(F.col(source))
    )
    taken = F.col(blocks) + (F.col(place) < F.col(cut)).cast("long")
    return joined.withColumn(copies, taken).where(F.col(copies) > 0).select(
        *kept, F.explode(F.sequence(F.lit(0).cast("long"), F.col(copies) - 1)).alias(copy_column), F.col(weight).alias(weight_column)
    )


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The documents as they are, each as often as the mix takes it."""
    _, placed = plan(docs, mix)
    order_key = permuted(F.col("source"), F.col("doc_id"), mix.seed)
    copy, weight = fresh(docs.columns, "mix_copy", "mix_weight")
    return realise(docs, placed, order_key, docs.columns, copy_column=copy, weight_column=weight).select(*docs.columns)
