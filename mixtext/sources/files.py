"""File inventory and media manifest (S13, S14, C11, C12) from the binaryFile source.

Only metadata columns are selected, so file contents are never read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixtext.functions import text as T


def inventory(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, last_modified 'yyyy-MM-dd HH:mm:ss', size_bytes)."""
    reader = spark.read.format("binaryFile")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    files = reader.option("recursiveFileLookup", True).load(path)
    return files.select(
        "path", T.format_mtime(F.col("modificationTime")).alias("last_modified"),
        F.col("length").alias("size_bytes"),
    )


def media_manifest(files: DataFrame) -> DataFrame:
    """Lower-cased extension or '(none)', byte size, supported flag."""
    ext = T.file_suffix(F.col("path"))
    return files.select(
        "path", ext.alias("extension"), F.col("size_bytes"),
        ext.isin(*T.SUPPORTED_AUDIO_EXTENSIONS).alias("supported"),
    )
