"""Stored tables that join without a shuffle.

Two tables that are joined again and again by the same id are written once, dealt into the
same buckets of that id; every later join reads bucket by bucket and plans no exchange.

Buckets cannot be split at run time, so rows that would make one bucket large stay out of them:
rows without an id, and rows of ids that fill more than an average bucket by themselves (at
most as many ids as there are buckets, on each side). Those lie beside the buckets and are
joined in the ordinary way, where Spark splits large keys.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixtext.session import materialize, scratch_path

BUCKET_BYTES = 256 << 20
MIN_BUCKETS = 8


def buckets_for(df: DataFrame) -> int:
    """Buckets of about BUCKET_BYTES for the files that ``df`` reads (sizes only are looked at)."""
    files = df.inputFiles()
    size = df.sparkSession.read.format("binaryFile").load(files).agg(F.sum("length")).first()[0] if files else 0
    return max(MIN_BUCKETS, -(-int(size or 0) // BUCKET_BYTES))


@dataclass
class Pair:
    """Two stored tables: their bucketed rows and the rows beside the buckets."""

    key: str
    left: DataFrame
    right: DataFrame
    left_rest: DataFrame
    right_rest: DataFrame

    def join(self, how: str = "inner") -> DataFrame:
        """Inner or left equi-join; null ids match nothing. No other column may have one name
        on both sides."""
        if how not in ("inner", "left"):
            raise ValueError("inner and left joins only")
        within = self.left.join(self.right, self.key, how)
        return within.unionByName(self.left_rest.join(self.right_rest, self.key, how))


def _hot(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """Ids with more rows than an average bucket, fewer than ``buckets`` of them."""
    counts = materialize(df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__n")), "id-counts")
    rows = counts.agg(F.sum("__n")).first()[0] or 0
    # ids that occur once are no burden, however few rows there are
    return counts.where(F.col("__n") > max(1.0, rows / buckets)).select(key)


def _write(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """One file a bucket: rows are dealt by the same hash that the table's buckets use."""
    name = f"bucketed_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key) \
        .option("path", scratch_path(df.sparkSession, "bucketed")).format("parquet").saveAsTable(name)
    return df.sparkSession.table(name)


def store(left: DataFrame, right: DataFrame, key: str, buckets: int) -> Pair:
    """Write both tables for joins by ``key`` (of one type on both sides). Repeated ids give a
    row for each pair, as in any join; an empty side gives an empty table."""
    types = [dict(df.dtypes)[key] for df in (left, right)]
    if types[0] != types[1]:
        raise ValueError(f"{key} is {types[0]} on one side and {types[1]} on the other")
    shared = (set(left.columns) & set(right.columns)) - {key}
    if shared:
        raise ValueError(f"columns of both sides: {sorted(shared)}")
    hot = materialize(_hot(left, key, buckets).union(_hot(right, key, buckets)).distinct().withColumn("__hot", F.lit(True)), "hot-ids")
    parts = []
    for df in (left, right):
        # fewer than 2 * buckets ids, so the broadcast is bounded
        told = materialize(df.join(F.broadcast(hot), key, "left"), "dealt-rows")
        aside = F.col(key).isNull() | F.col("__hot").isNotNull()
        parts.append((_write(told.where(~aside).drop("__hot"), key, buckets), told.where(aside).drop("__hot")))
    (a, a_rest), (b, b_rest) = parts
    return Pair(key, a, b, a_rest, b_rest)
