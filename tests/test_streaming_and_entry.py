"""Streaming scoring equals batch scoring; the driver contract runs."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from mixtext.operators.scoring import function_word_scorer, score
from mixtext.plans import q_io

from conftest import SF001


def test_stream_equals_batch(spark):
    out = q_io._conversation_stream(spark, SF001)
    streamed = spark.read.parquet(f"{out}/predictions").select("row_id", "predicted_label", "confidence")
    conv = q_io.stream_rows(spark, SF001).where(F.length("text") >= 1).select("row_id", "text")
    batch = score(conv, function_word_scorer()).select("row_id", "predicted_label", "confidence")
    assert streamed.count() == batch.count()
    assert streamed.exceptAll(batch).count() == 0


def test_entry_and_registry(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert rows and df.columns == ["label", "count"]
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 90
