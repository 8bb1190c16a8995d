"""The lifecycle end to end: delimited input -> split -> baseline -> errors -> validation."""

from pyspark.sql import functions as F

from mixtext.operators import models as M
from mixtext.plans import jobs
from mixtext.session import read_table, scratch_path

from conftest import SF001


def test_lifecycle_is_consistent(spark):
    src = scratch_path(spark, "raw_csv")
    docs = read_table(spark, SF001, "documents").select(
        F.col("lang").alias("category"), F.col("text").alias("comment"))
    docs.coalesce(2).write.option("header", True).option("escape", '"').csv(src)
    root = scratch_path(spark, "project")
    out = jobs.preprocess(spark, src, f"{root}/processed")
    meta = spark.read.json(out["metadata"]).first()
    assert meta.text_column == "comment" and meta.label_column == "category"
    assert meta.train_rows + meta.test_rows == meta.processed_rows
    models, reports = f"{root}/models", f"{root}/reports"
    metrics = jobs.train_baseline(spark, out["split"], models, reports, max_iter=20).first()
    assert 0 <= metrics.accuracy <= 1
    model = M.TfidfModel.load(f"{models}/{M.BASELINE_NAME}")
    jobs.error_analysis(spark, out["split"], model, reports)
    rules = {r.rule: r.ok for r in jobs.validate(spark, out["split"], models, reports).collect()}
    assert all(rules.values()), rules
    jobs.train_embeddings(spark, out["split"], models, reports, M.hashing_encoder(32), max_iter=50)
    comp = spark.read.json(f"{reports}/model_comparison").first()
    assert comp.mode == "comparison" and len(comp.models) == 2
