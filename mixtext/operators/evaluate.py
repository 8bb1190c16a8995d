"""Evaluation algebra over prediction tables.

Every operator reduces the prediction table with one partially-aggregated shuffle to
a k- or k x k-row result; nothing row-level reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixtext.operators.util import side_by_side


def _classes(classes) -> Column:
    return F.array(*[F.lit(c) for c in classes])


def label_grid(spark, classes) -> DataFrame:
    """The k x k (true, predicted) grid of the model's classes, with 0-based indices."""
    arr = _classes(classes)
    return (
        spark.range(1)
        .select(F.posexplode(arr).alias("true_idx", "true_label"))
        .select("true_idx", "true_label", F.posexplode(arr).alias("pred_idx", "pred_label"))
    )


def confusion_cells(pred: DataFrame, classes, true: str = "label", predicted: str = "predicted_label") -> DataFrame:
    """Dense k x k confusion cells over the given label order; pairs outside it are ignored."""
    known = F.col(true).isin(*classes) & F.col(predicted).isin(*classes)
    counts = pred.where(known).groupBy(F.col(true).alias("true_label"), F.col(predicted).alias("pred_label")).agg(
        F.count(F.lit(1)).alias("count")
    )
    grid = label_grid(pred.sparkSession, classes)
    # pairs outside the class list are gone before: at most k x k rows
    return grid.join(F.broadcast(counts), ["true_label", "pred_label"], "left").select(
        "true_idx", "pred_idx", "true_label", "pred_label", F.coalesce("count", F.lit(0)).cast("long").alias("count")
    )


def matrix_from_cells(cells: DataFrame) -> DataFrame:
    """Cells -> one row holding the nested matrix array<array<long>> (row = true label)."""
    rows = cells.groupBy("true_idx").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pred_idx", "count"))), lambda s: s["count"]).alias("row")
    )
    return rows.agg(
        F.transform(F.array_sort(F.collect_list(F.struct("true_idx", "row"))), lambda s: s["row"]).alias(
            "confusion_matrix"
        )
    )


def flatten_matrix(df: DataFrame, matrix: str = "confusion_matrix", keep=()) -> DataFrame:
    """Nested matrix -> (i, j, count) by two posexplodes."""
    rows = df.select(*keep, F.posexplode(matrix).alias("i", "_row"))
    return rows.select(*keep, "i", F.posexplode("_row").alias("j", "count"))


def matrix_stats(df: DataFrame, matrix: str = "confusion_matrix", keep=()) -> DataFrame:
    """Total, correct (trace), wrong, derived accuracy (null when total is 0 or the matrix is missing)."""
    m = F.col(matrix)
    flat = F.flatten(m)
    total = F.aggregate(flat, F.lit(0).cast("long"), lambda acc, x: acc + x.cast("long"))
    trace = F.aggregate(
        F.sequence(F.lit(1), F.size(m)),
        F.lit(0).cast("long"),
        lambda acc, i: acc + F.coalesce(F.try_element_at(F.element_at(m, i), i).cast("long"), F.lit(0).cast("long")),
    )
    ok = m.isNotNull() & (F.size(m) > 0)
    total = F.when(ok, total)
    trace = F.when(ok, trace)
    return df.select(
        *keep,
        total.alias("total"),
        trace.alias("correct"),
        (total - trace).alias("wrong"),
        F.when(total > 0, trace / total).alias("derived_accuracy"),
    )


def class_counts(pred: DataFrame, true: str = "label", predicted: str = "predicted_label") -> DataFrame:
    """(label, support, predicted, tp) over the union of true and predicted labels (U1), one shuffle."""
    e = F.explode(
        F.array(
            F.struct(F.col(true).alias("lab"), F.lit(1).alias("s"), F.lit(0).alias("p"),
                     (F.col(true) == F.col(predicted)).cast("int").alias("t")),
            F.struct(F.col(predicted).alias("lab"), F.lit(0).alias("s"), F.lit(1).alias("p"), F.lit(0).alias("t")),
        )
    ).alias("e")
    return pred.select(e).groupBy(F.col("e.lab").alias("label")).agg(
        F.sum("e.s").cast("long").alias("support"),
        F.sum("e.p").cast("long").alias("predicted"),
        F.sum("e.t").cast("long").alias("tp"),
    )


def class_report(pred: DataFrame, true: str = "label", predicted: str = "predicted_label") -> DataFrame:
    """Per-class precision / recall / F1 / support; 0 where undefined."""
    c = class_counts(pred, true, predicted)
    tp, sup, prd = F.col("tp"), F.col("support"), F.col("predicted")
    return c.select(
        "label",
        F.when(prd > 0, tp / prd).otherwise(0.0).alias("precision"),
        F.when(sup > 0, tp / sup).otherwise(0.0).alias("recall"),
        F.when(sup + prd > 0, 2.0 * tp / (sup + prd)).otherwise(0.0).alias("f1"),
        "support",
        "predicted",
        "tp",
    )


def summary_metrics(report: DataFrame) -> DataFrame:
    """A8, A10, A11 from the k-row class report (plus macro / weighted precision and recall)."""
    sup = F.col("support")
    n = F.sum(sup)
    return report.agg(
        (F.sum("tp") / n).alias("accuracy"),
        F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("f1") * sup) / n).alias("weighted_f1"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        (F.sum(F.col("precision") * sup) / n).alias("weighted_precision"),
        (F.sum(F.col("recall") * sup) / n).alias("weighted_recall"),
        n.cast("long").alias("support"),
    )


def accuracy(pred: DataFrame, true: str = "label", predicted: str = "predicted_label") -> DataFrame:
    """A8 directly over rows."""
    return pred.agg(F.avg((F.col(true) == F.col(predicted)).cast("double")).alias("accuracy"))


def model_metrics(pred: DataFrame, model_name: str, model_family: str, classes,
                  true: str = "label", predicted: str = "predicted_label") -> DataFrame:
    """One metrics row: names, summary metrics, labels and the nested confusion matrix."""
    summary = summary_metrics(class_report(pred, true, predicted))
    matrix = matrix_from_cells(confusion_cells(pred, classes, true, predicted))
    return side_by_side(summary, matrix).select(
        F.lit(model_name).alias("model_name"),
        F.lit(model_family).alias("model_family"),
        "accuracy", "macro_f1", "weighted_f1", "macro_precision", "macro_recall",
        "weighted_precision", "weighted_recall", "support",
        _classes(classes).alias("labels"),
        "confusion_matrix",
    )


def error_totals(pred: DataFrame, true: str = "label", predicted: str = "predicted_label") -> DataFrame:
    """Examples, correct, wrong, derived accuracy (0.0 when empty)."""
    out = pred.agg(
        F.count(F.lit(1)).alias("total_examples"),
        F.count_if(F.col(true) == F.col(predicted)).alias("total_correct"),
    )
    return out.select(
        "total_examples",
        "total_correct",
        (F.col("total_examples") - F.col("total_correct")).alias("total_wrong"),
        F.when(F.col("total_examples") > 0, F.col("total_correct") / F.col("total_examples"))
        .otherwise(0.0)
        .alias("derived_accuracy"),
    )
