"""Evaluation algebra against the published confusion matrix and metrics."""

import math

from pyspark.sql import functions as F

from mixtext.operators import errors as ER
from mixtext.operators import evaluate as E

LABELS = ["Mixed_feelings", "Negative", "Positive", "not-Tamil", "unknown_state"]
MATRIX = [[92, 85, 128, 7, 46], [61, 187, 101, 9, 48], [252, 257, 1358, 27, 189], [2, 6, 9, 78, 4],
          [21, 34, 29, 8, 77]]


def _pred_rows(spark):
    cells = [(LABELS[i], LABELS[j], c) for i, row in enumerate(MATRIX) for j, c in enumerate(row)]
    df = spark.createDataFrame(cells, "label string, predicted_label string, c int")
    return df.select("label", "predicted_label", F.explode(F.sequence(F.lit(1), F.col("c"))).alias("_k")).drop("_k")


def test_published_metrics(spark):
    pred = _pred_rows(spark)
    s = E.summary_metrics(E.class_report(pred)).first()
    assert math.isclose(s.accuracy, 0.5752808988764045, abs_tol=1e-12)
    assert math.isclose(s.macro_f1, 0.4646595756086166, abs_tol=1e-12)
    assert math.isclose(s.weighted_f1, 0.6041238743665586, abs_tol=1e-12)
    assert math.isclose(s.macro_precision, 0.43909639034628045, abs_tol=1e-12)
    assert math.isclose(s.macro_recall, 0.52260375479442, abs_tol=1e-12)
    cells = E.confusion_cells(pred, LABELS)
    m = E.matrix_from_cells(cells).first()[0]
    assert m == MATRIX
    st = E.matrix_stats(E.matrix_from_cells(cells)).first()
    assert (st.total, st.correct, st.wrong) == (3115, 1792, 1323)
    t = E.error_totals(pred).first()
    assert (t.total_examples, t.total_correct, t.total_wrong) == (3115, 1792, 1323)


def test_matrix_stats_edge_cases(spark):
    df = spark.createDataFrame([([[1, 1], [0, 2]],), ([],), (None,)], "confusion_matrix array<array<long>>")
    rows = E.matrix_stats(df).collect()
    assert (rows[0].total, rows[0].correct, rows[0].wrong, rows[0].derived_accuracy) == (4, 3, 1, 0.75)
    assert rows[1].total is None and rows[2].derived_accuracy is None


def test_histogram_and_weights(spark):
    errs = spark.createDataFrame([(0.0,), (0.5,), (0.99,), (1.0,)], "confidence double")
    h = {r.bin: r["count"] for r in ER.confidence_histogram(errs).collect()}
    assert h == {1: 1, 8: 1, 14: 2}
    cells = spark.createDataFrame([("a", "a", 100), ("a", "b", 8), ("b", "a", 7), ("b", "b", 0)],
                                  "true_label string, pred_label string, count long")
    w = {(r.true_label, r.pred_label): (r.size, r.labelled) for r in ER.cell_weights(cells).collect()}
    assert w[("a", "a")] == (34.0, True) and w[("a", "b")][1] is True and w[("b", "a")][1] is False
    assert ("b", "b") not in w
