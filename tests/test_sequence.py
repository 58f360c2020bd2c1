"""Previous row and row number: hot keys give the same rows as one plain window."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnline.operators.rotation import rotation_links
from turnline.operators.sequence import Running, hot_keys, with_previous, with_row_number, with_running
from turnline.sources.lineitem import airports, flights_from_lineitem


def _skewed(spark):
    """9,000 rows over 40 keys; key 0 holds a third of them, some without a time."""
    i = F.col("id")
    spread = F.pmod(F.xxhash64(i), F.lit(5000))
    return spark.range(9000).select(
        i.alias("i"),
        F.when(i % 3 == 0, 0).otherwise(F.pmod(F.xxhash64(i, F.lit(1)), F.lit(39)) + 1).alias("k"),
        F.when(i % 50 != 0, spread).alias("t"),
    )


def _slices():
    known = F.col("t").isNotNull()
    return [known, F.when(known, (F.col("t") / 100).cast("int")).otherwise(F.col("i").cast("int") % 1)]


@pytest.mark.parametrize("hot_rows", [10**9, 1000, 100, 0])
def test_previous_row_is_the_plain_windows(spark, hot_rows):
    rows = _skewed(spark)
    window = Window.partitionBy("k").orderBy(F.col("t").asc_nulls_first(), "i")
    expected = rows.select("i", F.lag("i").over(window).alias("p"), F.lag("t").over(window).alias("pt"))
    ours = with_previous(rows, ["k"], ["t", "i"], ["i", "t"], _slices(), hot_keys(rows, ["k"], hot_rows))
    found = {r.i: (r.has_prev, r.prev_i, r.prev_t) for r in ours.collect()}
    assert len(found) == 9000
    for row in expected.collect():
        assert found[row.i] == (row.p is not None, row.p, row.pt)


@pytest.mark.parametrize("hot_rows", [10**9, 1000, 0])
def test_row_number_is_the_plain_windows(spark, hot_rows):
    rows = _skewed(spark)
    window = Window.partitionBy("k").orderBy(F.col("t").asc_nulls_first(), "i")
    expected = {r.i: r.n for r in rows.select("i", F.row_number().over(window).alias("n")).collect()}
    ours = with_row_number(rows, ["k"], ["t", "i"], _slices(), "n", hot_keys(rows, ["k"], hot_rows))
    assert {r.i: r.n for r in ours.collect()} == expected


@pytest.mark.parametrize("hot_rows", [10**9, 1000, 0])
def test_running_totals_are_the_plain_windows(spark, hot_rows):
    rows = _skewed(spark).withColumn("v", F.when(F.col("i") % 4 != 0, F.pmod(F.xxhash64("i", F.lit(3)), F.lit(1000)) - 500))
    upto = Window.partitionBy("k").orderBy(F.col("t").asc_nulls_first(), "i").rowsBetween(Window.unboundedPreceding, 0)
    pair = F.when(F.col("v").isNotNull(), F.struct(F.col("v"), F.col("i").alias("w")))
    expected = rows.select(
        "i", F.sum("v").over(upto).alias("s"), F.max(pair).over(upto).alias("m"), F.last("v", ignorenulls=True).over(upto).alias("l"))
    ours = with_running(rows, ["k"], ["t", "i"], _slices(), hot_keys(rows, ["k"], hot_rows), {
        "s": Running("sum", F.col("v")), "m": Running("max", pair), "l": Running("last", F.col("v"))})
    assert ours.columns == [*rows.columns, "s", "m", "l"]
    assert sorted(map(tuple, ours.select("i", "s", "m", "l").collect())) == sorted(map(tuple, expected.collect()))


def test_null_keys_are_a_key_and_never_hot(spark):
    rows = spark.range(50).select(F.lit(None).cast("string").alias("k"), F.col("id").alias("t"), F.col("id").alias("i"))
    hot = hot_keys(rows, ["k"], 0)
    assert hot.isEmpty()
    numbered = with_row_number(rows, ["k"], ["t", "i"], _slices(), "n", hot)
    assert [r.n for r in numbered.orderBy("i").collect()] == list(range(1, 51))


def test_one_aircraft_with_a_third_of_all_flights(spark, flights):
    """A hot tail is cut by the hour and its links stay what one window gives."""
    skewed = flights.withColumn(
        "tail_number", F.when(F.col("flight_number") % 3 == 0, "HOT").otherwise(F.col("tail_number")))
    plain = rotation_links(skewed, airports(spark))
    sliced = rotation_links(skewed, airports(spark), hot_rows=500)
    assert plain.exceptAll(sliced).isEmpty() and sliced.exceptAll(plain).isEmpty()


def test_derived_flights_do_not_depend_on_slicing(spark, data_dir):
    lineitem = spark.read.parquet(f"{data_dir}/lineitem.parquet")
    skewed = lineitem.withColumn("l_suppkey", F.when(F.col("l_linenumber") < 3, 1).otherwise(F.col("l_suppkey")))
    plain, sliced = flights_from_lineitem(skewed), flights_from_lineitem(skewed, hot_rows=300)
    assert plain.exceptAll(sliced).isEmpty() and sliced.exceptAll(plain).isEmpty()


def test_one_plan_whose_hot_part_reads_nothing_while_no_key_is_hot(spark, flights):
    links = rotation_links(flights, airports(spark))
    links.write.format("noop").mode("overwrite").save()
    links.collect()
    plan = links._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("Window [") == 1 and "max_by" not in final and "Python" not in plan
    # Legs are shuffled once, and the join with the empty list of hot tails is gone.
    assert final.count("Exchange hashpartitioning(tail_number") == 1 and "HashJoin [tail_number" not in final
