"""Queries for error mining."""

from __future__ import annotations

from pyspark.sql import functions as F

from mixtext.operators import errors as ER
from mixtext.operators import evaluate as E
from mixtext.operators.scoring import FUNCTION_WORDS, function_word_scorer
from mixtext.plans import documents as D
from mixtext.plans import oracle as O
from mixtext.plans.catalog import register
from mixtext.plans.documents import r6

PRED = O.SPLIT + ",\n" + O.scorer_ctes(FUNCTION_WORDS)
ALL = O.PREPARED + ",\n" + O.scorer_ctes(FUNCTION_WORDS, source="w1", where="true")
REPORT = PRED + ",\n" + O.report_ctes()
ERR = PRED + """,
err AS (SELECT row_id AS row_index, original_text, cleaned_text, label AS true_label, predicted_label, confidence
        FROM pred WHERE label <> predicted_label),
hard AS (SELECT * FROM err ORDER BY confidence DESC, row_index LIMIT 20)"""


def _errors(spark, sf_dir):
    model = function_word_scorer()
    return ER.error_rows(D.predictions(spark, sf_dir, model), model)


@register(
    "p3_wrong_only",
    O.with_(ERR, "SELECT row_index, true_label, predicted_label, round(confidence, 6) AS confidence FROM err"),
)
def p3_wrong_only(spark, sf_dir):
    return _errors(spark, sf_dir).select("row_index", "true_label", "predicted_label",
                                         r6(F.col("confidence")).alias("confidence"))


@register(
    "p4_drilldown",
    O.with_(ERR, "SELECT row_index, true_label, predicted_label FROM err WHERE true_label = 'es'"),
)
def p4_drilldown(spark, sf_dir):
    """Drill-down with true label 'es' and predicted label 'All' (no predicate)."""
    return ER.drilldown(_errors(spark, sf_dir), true_label="es", predicted_label="All").select(
        "row_index", "true_label", "predicted_label"
    )


@register(
    "p5_existing_columns",
    O.with_(ERR, "SELECT original_text, true_label, predicted_label, round(confidence, 6) AS confidence FROM err"),
)
def p5_existing_columns(spark, sf_dir):
    """The asked-for columns that exist; the last does not and is left out."""
    kept = ER.existing_columns(_errors(spark, sf_dir), ("original_text", "true_label", "predicted_label",
                                                        "confidence", "not_a_column"))
    return kept.withColumn("confidence", r6(F.col("confidence")))


@register(
    "p6_confidence_band",
    O.with_(
        ALL,
        """SELECT row_id, round(confidence, 6) AS confidence,
                  CASE WHEN confidence >= 0.70 THEN 'high' WHEN confidence >= 0.55 THEN 'medium' ELSE 'low' END AS band,
                  confidence < 0.55 AS needs_review FROM pred""",
    ),
)
def p6_confidence_band(spark, sf_dir):
    b = ER.with_band(D.scored_documents(spark, sf_dir))
    return b.select("row_id", r6(F.col("confidence")).alias("confidence"), "band", "needs_review")


@register("p7_nonzero_cells", O.with_(REPORT, "SELECT true_label, pred_label, count FROM cells WHERE count > 0"))
def p7_nonzero_cells(spark, sf_dir):
    model = function_word_scorer()
    cells = E.confusion_cells(D.predictions(spark, sf_dir, model), model.classes)
    return ER.nonzero_cells(cells).select("true_label", "pred_label", "count")


@register(
    "x8_cell_weights",
    O.with_(
        REPORT,
        """SELECT true_label, pred_label, count, round(8.0 + count / max(count) OVER () * 26.0, 6) AS size,
                  count >= max(count) OVER () * 0.08 AS labelled FROM cells WHERE count > 0""",
    ),
)
def x8_cell_weights(spark, sf_dir):
    model = function_word_scorer()
    cells = E.confusion_cells(D.predictions(spark, sf_dir, model), model.classes)
    w = ER.cell_weights(cells)
    return w.select("true_label", "pred_label", "count", r6(F.col("size")).alias("size"), "labelled")


@register(
    "x7_matrix_flatten",
    O.with_(REPORT, "SELECT CAST(true_idx AS INTEGER) AS i, CAST(pred_idx AS INTEGER) AS j, count FROM cells"),
)
def x7_matrix_flatten(spark, sf_dir):
    model = function_word_scorer()
    matrix = E.matrix_from_cells(E.confusion_cells(D.predictions(spark, sf_dir, model), model.classes))
    return E.flatten_matrix(matrix)


@register(
    "a12_matrix_stats",
    O.with_(
        REPORT,
        """SELECT sum(count) AS total, sum(count) FILTER (WHERE true_idx = pred_idx) AS correct,
                  sum(count) FILTER (WHERE true_idx <> pred_idx) AS wrong,
                  round(CASE WHEN sum(count) > 0 THEN sum(count) FILTER (WHERE true_idx = pred_idx) / sum(count) END, 6)
                    AS derived_accuracy
           FROM cells""",
    ),
)
def a12_matrix_stats(spark, sf_dir):
    model = function_word_scorer()
    matrix = E.matrix_from_cells(E.confusion_cells(D.predictions(spark, sf_dir, model), model.classes))
    st = E.matrix_stats(matrix)
    return st.select("total", "correct", "wrong", r6(F.col("derived_accuracy")).alias("derived_accuracy"))


@register(
    "t1_hardest_errors",
    O.with_(
        ERR,
        """SELECT row_index, original_text, cleaned_text, true_label, predicted_label,
                  round(confidence, 6) AS confidence FROM hard""",
    ),
)
def t1_hardest_errors(spark, sf_dir):
    h = ER.hardest(_errors(spark, sf_dir), 20)
    return h.select("row_index", "original_text", "cleaned_text", "true_label", "predicted_label",
                    r6(F.col("confidence")).alias("confidence"))


@register(
    "a14_error_share",
    O.with_(
        PRED,
        """SELECT greatest(count(*) - count(*) FILTER (WHERE label <> predicted_label), 0) AS correct,
                  count(*) FILTER (WHERE label <> predicted_label) AS misclassified,
                  round(CASE WHEN count(*) > 0 THEN greatest(count(*) - count(*) FILTER (WHERE label <> predicted_label), 0)
                        / count(*) END, 6) AS correct_share,
                  round(CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE label <> predicted_label) / count(*) END, 6)
                    AS wrong_share
           FROM pred""",
    ),
)
def a14_error_share(spark, sf_dir):
    s = ER.error_share(E.error_totals(D.predictions(spark, sf_dir)))
    return s.select("correct", "misclassified", r6(F.col("correct_share")).alias("correct_share"),
                    r6(F.col("wrong_share")).alias("wrong_share"))


@register(
    "a15_confidence_histogram",
    O.with_(
        ERR,
        """SELECT CAST(least(floor(confidence * 14) + 1, 14) AS INTEGER) AS bin, count(*) AS count
           FROM hard GROUP BY 1""",
    ),
)
def a15_confidence_histogram(spark, sf_dir):
    """Histogram of the hardest errors' confidences (the reference charts the top-n list)."""
    return ER.confidence_histogram(ER.hardest(_errors(spark, sf_dir), 20)).select("bin", "count")


@register(
    "a16_error_label_choices",
    O.with_(
        ERR,
        """SELECT DISTINCT 'true' AS field, true_label AS choice FROM err
           UNION SELECT DISTINCT 'predicted', predicted_label FROM err""",
    ),
)
def a16_error_label_choices(spark, sf_dir):
    return ER.label_choices(_errors(spark, sf_dir))


@register(
    "m10_error_analysis_summary",
    O.with_(
        PRED,
        """SELECT 'function_words' AS model_name, 'baseline' AS model_family, count(*) AS total_examples,
                  count(*) FILTER (WHERE label = predicted_label) AS total_correct,
                  count(*) FILTER (WHERE label <> predicted_label) AS total_wrong,
                  round(CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE label = predicted_label) / count(*)
                        ELSE 0.0 END, 6) AS derived_accuracy, 20 AS top_n
           FROM pred""",
    ),
)
def m10_error_analysis_summary(spark, sf_dir):
    model = function_word_scorer()
    out = ER.error_analysis(D.predictions(spark, sf_dir, model), model, top_n=20)
    return out["summary"].select("model_name", "model_family", "total_examples", "total_correct", "total_wrong",
                                 r6(F.col("derived_accuracy")).alias("derived_accuracy"), "top_n")
