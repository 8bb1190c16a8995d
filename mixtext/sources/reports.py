"""Report sources and sinks (S5-S10): split tables, dataset metadata, JSON reports, error CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mixtext.operators import prep
from mixtext.operators.observe import counts_row, split_metrics, write_observed
from mixtext.session import path_exists

# The cleaning steps recorded in the dataset metadata
CLEANING_STEPS = (
    "preserve Tamil Unicode",
    "lowercase ASCII English characters",
    "strip URLs",
    "strip @mentions",
    "collapse whitespace",
)


def write_split(split: DataFrame, path: str, csv: bool = False) -> None:
    """One table partitioned by ``split`` (partition pruning replaces separate files)."""
    writer = split.write.mode("overwrite").partitionBy("split")
    if csv:
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        writer.parquet(path)


def write_split_counted(split: DataFrame, path: str) -> dict:
    """S5 as parquet with A3's counts of the split taken while it is written."""
    return write_observed(split, path, split_metrics(), ("split",))[1]


def load_split(spark: SparkSession, path: str, part: str = "train") -> DataFrame:
    """One side of the split (only its partition directory is read); error if missing."""
    df = spark.read.parquet(path)
    if "split" not in df.columns:
        raise FileNotFoundError(f"Missing split partitions in {path}")
    out = df.where(F.col("split") == part)
    if out.limit(1).count() == 0:  # existence probe, one row at most
        raise FileNotFoundError(f"Missing '{part}' split in {path}")
    return out.drop("split")


def dataset_metadata(raw: DataFrame, split: DataFrame, source: str, text_col: str, label_col: str,
                     test_size: float, seed: int, stratified: bool, counts: dict | None = None) -> DataFrame:
    """The one-row metadata record (counts by A1 / A3 aggregates, or A3's taken in flight)."""
    counts = prep.row_counts(raw, split) if counts is None else counts_row(split, counts)
    dist = prep.label_distribution_map(split)
    from mixtext.operators.util import side_by_side

    return side_by_side(counts, dist).select(
        F.lit(source).alias("source_csv"), "raw_rows", "processed_rows",
        F.lit(text_col).alias("text_column"), F.lit(label_col).alias("label_column"), "label_distribution",
        F.lit(float(test_size)).alias("test_size"), F.lit(int(seed)).alias("random_state"),
        F.lit(bool(stratified)).alias("stratified_split"), "train_rows", "test_rows",
        F.array(*[F.lit(s) for s in CLEANING_STEPS]).alias("cleaning"),
    )


def write_json_report(df: DataFrame, path: str) -> None:
    """A (small) report table as JSON lines."""
    df.coalesce(1).write.mode("overwrite").json(path)


def read_json_report(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Read a report with a fixed schema; a missing report is an empty table."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", False).json(path)


def write_error_csv(errors: DataFrame, path: str) -> None:
    """The error list as CSV; the nested probabilities become a JSON string."""
    flat = errors.withColumn("top_probabilities", F.to_json("top_probabilities"))
    flat.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
