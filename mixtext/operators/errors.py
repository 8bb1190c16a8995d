"""Error mining over scored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mixtext.functions import scoring as S
from mixtext.operators import evaluate as E
from mixtext.operators.scoring import classes_col
from mixtext.operators.util import side_by_side

HIST_BINS = 14  # fixed value: at most 14 equal bins on [0, 1]
LABEL_SHARE = 0.08  # fixed value: a cell is labelled when count >= 8 % of the largest


def wrong_only(pred: DataFrame, true: str = "label", predicted: str = "predicted_label") -> DataFrame:  # P3
    return pred.where(F.col(true) != F.col(predicted))


def drilldown(errors: DataFrame, true_label: str = "All", predicted_label: str = "All") -> DataFrame:  # P4
    out = errors
    if true_label != "All" and "true_label" in errors.columns:
        out = out.where(F.col("true_label") == true_label)
    if predicted_label != "All" and "predicted_label" in errors.columns:
        out = out.where(F.col("predicted_label") == predicted_label)
    return out


def existing_columns(df: DataFrame, wanted=("original_text", "true_label", "predicted_label", "confidence")):  # P5
    return df.select(*[c for c in wanted if c in df.columns])


def with_band(pred: DataFrame) -> DataFrame:  # P6
    band = S.confidence_band(F.col("confidence"))
    return pred.withColumn("band", band).withColumn("needs_review", band == "low")


def nonzero_cells(cells: DataFrame) -> DataFrame:  # P7
    return cells.where(F.col("count") > 0)


def cell_weights(cells: DataFrame) -> DataFrame:  # X8, over the k x k non-zero cells
    top = F.max("count").over(Window.partitionBy())  # k^2 rows at most
    nz = nonzero_cells(cells)
    return nz.withColumn("_max", top).select(
        "true_label", "pred_label", "count",
        (F.lit(8.0) + F.col("count") / F.col("_max") * 26.0).alias("size"),
        (F.col("count") >= F.col("_max") * LABEL_SHARE).alias("labelled"),
    )


def error_rows(scored: DataFrame, model, top_k: int = 3, true: str = "label") -> DataFrame:
    """The error record of every wrong row (row id, texts, labels, confidence, top-k probabilities)."""
    wrong = wrong_only(scored, true)
    return wrong.select(
        F.col("row_id").alias("row_index"),
        "original_text",
        "cleaned_text",
        F.col(true).alias("true_label"),
        "predicted_label",
        "confidence",
        S.ranked_probabilities(classes_col(model), F.col("probabilities"), top_k).alias("top_probabilities"),
    )


def hardest(errors: DataFrame, top_n: int = 20) -> DataFrame:  # T1 (top-k report: the limit is the feature)
    return errors.orderBy(F.col("confidence").desc(), F.col("row_index")).limit(int(top_n))


def error_share(totals: DataFrame) -> DataFrame:  # A14
    correct = F.greatest(F.col("total_examples") - F.col("total_wrong"), F.lit(0))
    return totals.select(
        correct.alias("correct"),
        F.col("total_wrong").alias("misclassified"),
        F.when(F.col("total_examples") > 0, correct / F.col("total_examples")).alias("correct_share"),
        F.when(F.col("total_examples") > 0, F.col("total_wrong") / F.col("total_examples")).alias("wrong_share"),
    )


def confidence_histogram(errors: DataFrame, bins: int = HIST_BINS) -> DataFrame:  # A15
    b = F.least(F.floor(F.col("confidence") * bins) + 1, F.lit(bins)).cast("int")
    return errors.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count")).select(
        "bin", ((F.col("bin") - 1) / bins).alias("lower"), (F.col("bin") / bins).alias("upper"), "count"
    )


def label_choices(errors: DataFrame) -> DataFrame:  # A16: distinct choices of each filter field
    t = errors.select(F.lit("true").alias("field"), F.col("true_label").alias("choice"))
    p = errors.select(F.lit("predicted").alias("field"), F.col("predicted_label").alias("choice"))
    return t.unionByName(p).where(F.col("choice").isNotNull()).distinct()


def error_analysis(scored: DataFrame, model, top_n: int = 20, true: str = "label") -> dict[str, DataFrame]:
    """Summary row, dense cells and the hardest errors. ``scored`` should be persisted:
    the summary, the cells and the error list all read it."""
    classes = model.classes
    cells = E.confusion_cells(scored, classes, true)
    totals = E.error_totals(scored, true)
    matrix = E.matrix_from_cells(cells)
    summary = side_by_side(totals, matrix).select(
        F.lit(model.model_name).alias("model_name"),
        F.lit("transformer" if model.model_type == "transformer" else "baseline").alias("model_family"),
        F.array(*[F.lit(c) for c in classes]).alias("labels"),
        "total_examples", "total_correct", "total_wrong", "derived_accuracy", "confusion_matrix",
        F.lit(int(top_n)).alias("top_n"),
    )
    errors = error_rows(scored, model, 3, true)
    return {"summary": summary, "cells": cells, "errors": errors, "hardest": hardest(errors, top_n)}
