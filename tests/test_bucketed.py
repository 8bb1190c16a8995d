"""Bucketed tables: joins equal the ordinary ones and move no rows."""

from __future__ import annotations

import pytest

from mixtext.operators import bucketed as B


def _sides(spark):
    left = [(i, f"l{i}") for i in range(200)] + [(7, f"hot{i}") for i in range(300)] + [(None, "x"), (None, "y")]
    right = [(i, i * 0.5) for i in range(0, 260, 2)] + [(7, 1.0), (7, 2.0), (8, 9.0), (None, 0.0)]
    return (spark.createDataFrame(left, "id long, a string"), spark.createDataFrame(right, "id long, b double"))


def _rows(df):
    return sorted(map(tuple, df.select("id", "a", "b").collect()), key=repr)


def test_joins_equal_the_ordinary_ones(spark):
    left, right = _sides(spark)
    pair = B.store(left, right, "id", 8)
    for how in ("inner", "left"):
        assert _rows(pair.join(how)) == _rows(left.join(right, "id", how))
    assert {r["id"] for r in pair.left_rest.collect()} == {7, None}
    assert 7 not in {r["id"] for r in pair.left.collect()}
    with pytest.raises(ValueError):
        pair.join("full")


def test_the_join_of_buckets_has_no_exchange(spark):
    left, right = _sides(spark)
    pair = B.store(left, right, "id", 8)
    joined = pair.left.hint("merge").join(pair.right, "id")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    ordinary = left.hint("merge").join(right, "id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in ordinary


def test_empty_sides_and_unfit_columns(spark):
    left, right = _sides(spark)
    assert B.store(left.limit(0), right, "id", 8).join("left").count() == 0
    assert B.store(left, right.limit(0), "id", 8).join("left").count() == left.count()
    with pytest.raises(ValueError, match="columns of both sides"):
        B.store(left, right.withColumnRenamed("b", "a"), "id", 8)
    with pytest.raises(ValueError, match="on one side"):
        B.store(left, right.selectExpr("cast(id as int) id", "b"), "id", 8)
