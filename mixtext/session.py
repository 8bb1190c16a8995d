"""Session and shared-storage helpers.

Everything in the library takes a ``SparkSession`` from the caller. These helpers
only build a local session for tests / bench and locate the shared folder used to
cut lineage (``spark.checkpoint.dir``).
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "mixtext") -> SparkSession:
    """A local session configured like the cluster one (AQE on, UI off, Arrow on)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # documents run to 20,000 words: bound the Arrow batches sent to Python by bytes
        .config("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("MIXTEXT_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    With more than one process (any master but plain ``local`` / ``local[n]``) the setting
    must be present: a folder of one machine is lost with it and unseen by the others. A
    one-process session without the setting (tests, ad-hoc use) gets a folder of its own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder shared by the driver and all executors")
        configured = tempfile.mkdtemp(prefix="mixtext-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in the file system that its scheme names."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a parquet table in the shared folder and read it back.

    Cuts lineage (an executor loss re-reads files instead of recomputing the UDF and
    the dedupe shuffle) and, unlike an RDD checkpoint, later passes read only the
    columns they need.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the files that ``df`` reads, from a listing (no contents); 0 if it reads none."""
    files = df.inputFiles()
    return int(df.sparkSession.read.format("binaryFile").load(files).agg({"length": "sum"}).first()[0] or 0) if files else 0


def spread(df: DataFrame) -> DataFrame:
    """Round-robin the rows over the cluster when a scan yields fewer partitions than
    there are task slots (e.g. a file with one row group). Inputs already split finer
    than that (any large table) are left as they are, so no shuffle is added at scale."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < slots:
        return df.repartition(slots)
    return df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))
