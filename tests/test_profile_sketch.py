"""Column profile by sketches: same roles as the exact profile, estimates within their bars."""

from __future__ import annotations

import pytest

from mixtext.operators import profile as PR


def _roles(profile):
    return tuple(PR.infer_roles(profile).first())


def _table(spark, n=4000):
    rows = [(f"row {i}", f"id{i:06d}", f"ab{i % 40:02d}", f"cd{i % 41:02d}", None if i % 3 else "", f"a longer text number {i % 900}") for i in range(n)]
    return spark.createDataFrame(rows, "r string, i string, x string, y string, e string, t string")


def test_roles_equal_the_exact_profile(spark):
    table = _table(spark)
    for columns in (["r", "i", "x", "y", "t"], ["x", "y"], ["y", "x", "e"], ["i", "r"], ["t", "x"]):
        df = table.select(*columns)
        assert _roles(PR.sketched_likeness(df)) == _roles(PR.label_likeness(df)), columns


def test_estimates_keep_their_bars_and_close_counts_are_exact(spark):
    df = _table(spark)
    exact = {r["column_name"]: r for r in PR.label_likeness(df).collect()}
    for r in PR.sketched_likeness(df).collect():
        e = exact[r["column_name"]]
        assert (r["position"], r["known_hits"], r["mean_length"]) == (e["position"], e["known_hits"], e["mean_length"])
        assert r["unique_ratio"] == pytest.approx(e["unique_ratio"], rel=4 * 1.04 / 2 ** 6)
        if r["column_name"] in ("x", "y"):  # equal lengths, 40 and 41 values
            assert r["unique_ratio"] == e["unique_ratio"]


def test_no_rows_and_one_column(spark):
    empty = _table(spark).limit(0)
    assert [(r["known_hits"], r["unique_ratio"], r["mean_length"]) for r in PR.sketched_likeness(empty).collect()] == [(0, 0.0, 0.0)] * 6
    with pytest.raises(ValueError, match="two columns"):
        PR.infer_columns(_table(spark).select("r"))
    assert PR.infer_columns(_table(spark).select("t", "x")) == ("t", "x")
