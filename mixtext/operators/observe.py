"""Counts taken while a table is written (A3, S6, P2), instead of by a scan afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from mixtext.session import scratch_path

ROWS = "__rows"


def write_observed(df: DataFrame, path: str, metrics: dict[str, Column], partition_by: tuple[str, ...] = ()) -> tuple[DataFrame, dict]:
    """Write ``df`` as parquet and give the written table with ``metrics`` over its rows.

    The metrics are aggregates that Spark evaluates in the writing tasks. A task that ran
    again after a lost executor may be counted twice, and a plan that Spark proves empty takes
    no metrics at all; so the rows seen are held against the rows stored (a count that reads
    file footers only), and where they differ the metrics are computed from the table.
    """
    spark = df.sparkSession
    seen = Observation()
    watched = df.observe(seen, F.count(F.lit(1)).alias(ROWS), *[c.alias(n) for n, c in metrics.items()])
    watched.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    return table, trusted(table, dict(seen.get), metrics)


def trusted(table: DataFrame, found: dict, metrics: dict[str, Column]) -> dict:
    """The metrics found in flight, or those of the table if its rows are not the rows seen."""
    if set(found) == {ROWS, *metrics} and found[ROWS] == table.count():
        return {n: found[n] for n in metrics}
    return table.agg(*[c.alias(n) for n, c in metrics.items()]).first().asDict() if metrics else {}


def materialize_observed(df: DataFrame, name: str, metrics: dict[str, Column]) -> tuple[DataFrame, dict]:
    """``write_observed`` into a fresh folder of the shared scratch space."""
    return write_observed(df, scratch_path(df.sparkSession, name), metrics)


def raw_metrics() -> dict[str, Column]:
    return {"raw_rows": F.count(F.lit(1))}


def split_metrics() -> dict[str, Column]:
    """A3 over the split table."""
    return {"processed_rows": F.count(F.lit(1)), "train_rows": F.count_if(F.col("split") == "train"),
            "test_rows": F.count_if(F.col("split") == "test")}


def counts_row(like: DataFrame, counts: dict) -> DataFrame:
    """Counts already known as a one-row table."""
    schema = ", ".join(f"{n} long" for n in counts)
    return like.sparkSession.createDataFrame([tuple(int(v) for v in counts.values())], schema)
