"""Structured Streaming scoring (ST1-ST3).

File source with a fixed schema -> the same ``score()`` as batch -> ``foreachBatch``
writing three sinks: predictions, the low-confidence review queue and rejected
(empty) requests. Stateless; each sink write is keyed by batch id so a replayed
micro-batch overwrites its own output instead of duplicating it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mixtext.functions import scoring as S
from mixtext.operators.scoring import classes_col, score


TOP_N = 3  # probabilities in a record, as in the batch records


def _write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    # idempotent per batch: a retried batch replaces its own partition
    df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def start_scoring_stream(spark: SparkSession, source_dir: str, schema: StructType, model, out_dir: str,
                         checkpoint_dir: str, text_col: str = "text", key_cols=("row_id",), available_now=True):
    """ST1-ST3: returns the started query; sinks are ``out_dir``/{predictions,review,rejects}."""
    stream = spark.readStream.schema(schema).parquet(source_dir)

    def handle(batch: DataFrame, batch_id: int) -> None:
        valid = batch.where(F.length(F.col(text_col)) >= 1)  # P9 / ST3 payload gate
        rejects = batch.where(F.col(text_col).isNull() | (F.length(F.col(text_col)) < 1))
        keys = [F.col(c) for c in key_cols]
        records = score(valid, model, text_col).select(
            *keys, "predicted_label", "confidence", S.confidence_band(F.col("confidence")).alias("band"), "cleaned_text",
            F.lit("transformer" if model.model_type == "transformer" else "baseline").alias("model"),
            F.lit(model.model_name).alias("model_name"),
            S.ranked_probabilities(classes_col(model), F.col("probabilities"), TOP_N).alias("top_probabilities"),
        ).persist()  # read by two sinks
        try:
            _write_batch(records, f"{out_dir}/predictions", batch_id)
            _write_batch(records.where(F.col("band") == "low"), f"{out_dir}/review", batch_id)
            _write_batch(rejects.select(*keys), f"{out_dir}/rejects", batch_id)
        finally:
            records.unpersist()

    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint_dir)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
