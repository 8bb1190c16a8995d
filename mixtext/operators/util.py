"""Small DataFrame helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def side_by_side(*frames: DataFrame) -> DataFrame:
    """Put single-row results next to each other without a join.

    Each frame holds one row with distinct column names; the rows are stacked with
    the missing columns null and folded by ``first(ignorenulls)``.
    """
    fields = [(f.name, f.dataType) for df in frames for f in df.schema.fields]
    names = [n for n, _ in fields]
    parts = []
    for df in frames:
        own = set(df.columns)
        parts.append(df.select(*[F.col(n) if n in own else F.lit(None).cast(t).alias(n) for n, t in fields]))
    stacked = reduce(DataFrame.unionByName, parts)
    return stacked.agg(*[F.first(n, ignorenulls=True).alias(n) for n in names])
