"""Exact rounding, means and correlations."""

import random
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from turnline.functions.numeric import correlation, mean, mean_of, pct, pct_of_rows


def half_up(numerator, denominator, digits):
    exact = Decimal(numerator) / Decimal(denominator)
    return float(exact.quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def test_pct_rounds_like_an_exact_decimal(spark):
    draw = random.Random(7)
    pairs = [(41, 4000), (1, 800), (0, 5), (5, 5)]
    pairs += [(draw.randrange(0, n + 1), n) for n in (800, 1600, 2000, 4000, 7, 999_983) for _ in range(200)]
    frame = spark.createDataFrame(pairs, "k bigint, n bigint")
    rows = frame.select("k", "n", pct(F.col("k"), F.col("n")).alias("two"), pct(F.col("k"), F.col("n"), 3).alias("three"))
    for row in rows.collect():
        assert row.two == half_up(100 * row.k, row.n, 2)
        assert row.three == half_up(100 * row.k, row.n, 3)


def test_mean_rounds_negative_values_away_from_zero(spark):
    draw = random.Random(8)
    pairs = [(-1, 8), (1, 8), (0, 3)] + [(draw.randrange(-10**6, 10**6), draw.randrange(1, 5000)) for _ in range(500)]
    rows = spark.createDataFrame(pairs, "s bigint, n bigint").select("s", "n", mean(F.col("s"), F.col("n")).alias("m"))
    for row in rows.collect():
        assert row.m == half_up(row.s, row.n, 2)


def test_empty_groups_give_null_not_an_error(spark):
    empty = spark.createDataFrame([], "x int, p boolean")
    row = empty.agg(
        mean_of(F.col("x")).alias("m"), pct_of_rows(F.col("p")).alias("p"),
        correlation(F.col("x"), F.col("x")).alias("c"),
    ).first()
    assert (row.m, row.p, row.c) == (None, None, None)


def test_null_counts_as_false_in_a_share_of_rows(spark):
    frame = spark.createDataFrame([(True,), (None,), (False,), (None,)], "p boolean")
    assert frame.agg(pct_of_rows(F.col("p")).alias("p")).first().p == 25.0


def test_correlation_is_pairwise_complete_and_null_at_zero_variance(spark):
    draw = random.Random(9)
    rows = [(i, draw.randrange(100), None if i % 7 == 0 else draw.randrange(50)) for i in range(400)]
    frame = spark.createDataFrame(rows, "i int, x int, y int")
    ours = frame.agg(correlation(F.col("x"), F.col("y")).alias("c")).first().c
    builtin = frame.where("y is not null").agg(F.corr("x", "y").alias("c")).first().c
    assert abs(ours - builtin) < 1e-12
    narrowed = frame.agg(correlation(F.col("x"), F.col("y"), F.col("i") < 100).alias("c")).first().c
    assert abs(narrowed - frame.where("y is not null and i < 100").agg(F.corr("x", "y").alias("c")).first().c) < 1e-12
    flat = frame.select(F.lit(3).alias("x"), "y")
    assert flat.agg(correlation(F.col("x"), F.col("y")).alias("c")).first().c is None
