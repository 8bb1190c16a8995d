"""Counts taken while a table is written."""

from pyspark.sql import functions as F

from mixtext.operators import observe as OB


def rows(spark, n):
    return spark.range(n).select(F.col("id").alias("row_id"), F.when(F.col("id") % 5 == 0, "test").otherwise("train").alias("split")).repartition(6)


def test_counts_equal_those_of_the_table(spark, tmp_path):
    table, got = OB.write_observed(rows(spark, 1003), f"{tmp_path}/t", OB.split_metrics(), ("split",))
    assert got == {"processed_rows": 1003, "train_rows": 802, "test_rows": 201}
    assert table.agg(*[c.alias(n) for n, c in OB.split_metrics().items()]).first().asDict() == got
    assert OB.counts_row(table, got).first().asDict() == got


def test_trusted_counts_read_no_column(spark, tmp_path, monkeypatch):
    table, _ = OB.write_observed(rows(spark, 50), f"{tmp_path}/t", {})
    found = {OB.ROWS: 50, "test_rows": -7}
    metric = {"test_rows": F.count_if(F.col("split") == "test")}
    assert OB.trusted(table, found, metric) == {"test_rows": -7}  # taken as found: no second scan
    plan = table.groupBy().count()._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<>" in plan


def test_rows_counted_twice_are_counted_anew(spark, tmp_path):
    table, _ = OB.write_observed(rows(spark, 50), f"{tmp_path}/t", {})
    metric = {"test_rows": F.count_if(F.col("split") == "test")}
    assert OB.trusted(table, {OB.ROWS: 61, "test_rows": 12}, metric) == {"test_rows": 10}
    assert OB.trusted(table, {}, metric) == {"test_rows": 10}


def test_no_rows(spark, tmp_path):
    for name, df in (("a", rows(spark, 10).where("row_id > 99")), ("b", rows(spark, 10).limit(0))):
        table, got = OB.write_observed(df, f"{tmp_path}/{name}", OB.split_metrics())
        assert got == {"processed_rows": 0, "train_rows": 0, "test_rows": 0} and table.count() == 0
