"""As-of join against a plain search, with hot keys, bursts, ties, nulls and clashing names."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from turnline.operators.asof import asof_join

START = datetime(2024, 3, 1)


def at(minutes):
    return None if minutes is None else START + timedelta(minutes=minutes)


@pytest.fixture(scope="module")
def sides(spark):
    """Key A holds most rows; many right rows share an instant; some keys and times are null."""
    left, right = [], []
    for i in range(900):
        key = None if i % 40 == 0 else "A" if i % 3 else f"K{i % 11}"
        left.append((i, key, at(None if i % 50 == 7 else (i * 37) % 3000), "left"))
    for i in range(700):
        key = None if i % 45 == 0 else "A" if i % 2 else f"K{i % 13}"
        right.append((key, at(None if i % 60 == 5 else (i * 53) % 900 * 3), i % 17, None if i % 6 == 0 else f"r{i % 5}"))
    return left, right, (
        spark.createDataFrame(left, "id int, airport string, at timestamp, _right string"),
        spark.createDataFrame(right, "dest string, came timestamp, n int, name string"),
    )


def plain(left, right, strict, within):
    out = {}
    for i, key, when, _ in left:
        best = None
        for k, came, n, name in right:
            if key is None or when is None or k != key or came is None or came > when or (strict and came == when):
                continue
            rank = (came, came, n, (name is not None, name or ""))
            best = max(best, (rank, (came, n, name))) if best else (rank, (came, n, name))
        found = best[1] if best else (None, None, None)
        if best and within is not None and (when - found[0]).total_seconds() > within:
            found = (None, None, None)
        out[i] = found
    return out


@pytest.mark.parametrize("hot_rows", [10**9, 100, 0])
@pytest.mark.parametrize("strict,within", [(False, None), (True, None), (False, 3600)])
def test_asof_is_the_plain_search(spark, sides, hot_rows, strict, within):
    left, right, (l, r) = sides
    l = l.withColumnRenamed("_right", "note")
    got = asof_join(l, r, [("airport", "dest")], "at", "came", ["came", "n", "name"], "last_", strict, within, hot_rows)
    assert got.columns == [*l.columns, "last_came", "last_n", "last_name"]
    rows = got.collect()
    assert len(rows) == len(left)
    expected = plain(left, right, strict, within)
    for row in rows:
        assert (row.last_came, row.last_n, row.last_name) == expected[row.id]


def test_asof_of_empty_sides(spark, sides):
    _, _, (l, r) = sides
    l = l.drop("_right")
    none = asof_join(l, r.limit(0), [("airport", "dest")], "at", "came", ["n"])
    assert none.count() == l.count() and none.where("last_n is not null").isEmpty()
    assert asof_join(l.limit(0), r, [("airport", "dest")], "at", "came", ["n"]).isEmpty()


def test_the_plan_forms_no_pairs(spark, sides):
    _, _, (l, r) = sides
    plan = asof_join(l.drop("_right"), r, [("airport", "dest")], "at", "came", ["n"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    joins = [line for line in plan.split("== Initial Plan ==")[0].splitlines() if "Join" in line]
    assert all("_hot" in line or "_slice" in line or "Broadcast" in line for line in joins)
