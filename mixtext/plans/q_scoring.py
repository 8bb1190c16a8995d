"""Queries for scoring and evaluation on the frozen scorer (X1-X5, X10, M6, M7, T2,
A7-A11, A13, U1, J1, J5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from mixtext.functions import scoring as S
from mixtext.operators import bucketed as B
from mixtext.operators import evaluate as E
from mixtext.operators.scoring import FUNCTION_WORDS, function_word_scorer, prediction_records
from mixtext.plans import documents as D
from mixtext.plans import oracle as O
from mixtext.plans.catalog import ORACLE, register
from mixtext.plans.documents import r6

PRED = O.SPLIT + ",\n" + O.scorer_ctes(FUNCTION_WORDS)
# the same over every prepared document
ALL = O.PREPARED + ",\n" + O.scorer_ctes(FUNCTION_WORDS, source="w1", where="true")
REPORT = PRED + ",\n" + O.report_ctes()


@register(
    "x1_softmax",
    O.with_(ALL, "SELECT row_id, cls AS label, round(p, 6) AS probability FROM prob"),
)
def x1_softmax(spark, sf_dir):
    model = function_word_scorer()
    pred = D.scored_documents(spark, sf_dir, model)
    return pred.select("row_id", F.posexplode_outer("probabilities").alias("idx", "probability")).select(
        "row_id", F.element_at(F.array(*[F.lit(c) for c in model.classes]), F.col("idx") + 1).alias("label"),
        r6(F.col("probability")).alias("probability"),
    )


@register(
    "x2_x3_argmax_confidence",
    O.with_(ALL, "SELECT row_id, predicted_label, round(confidence, 6) AS confidence FROM pred"),
)
def x2_x3_argmax_confidence(spark, sf_dir):
    return D.scored_documents(spark, sf_dir).select("row_id", "predicted_label", r6(F.col("confidence")).alias("confidence"))


@register(
    "x5_label_probability_map",
    O.with_(ALL, "SELECT row_id, cls AS label, round(p, 6) AS probability FROM prob"),
)
def x5_label_probability_map(spark, sf_dir):
    model = function_word_scorer()
    pred = D.scored_documents(spark, sf_dir, model)
    m = S.label_probabilities(F.array(*[F.lit(c) for c in model.classes]), F.col("probabilities"))
    return pred.select("row_id", F.explode_outer(m).alias("label", "probability")).select(
        "row_id", "label", r6(F.col("probability")).alias("probability")
    )


_TOPN = """SELECT row_id, CAST(rk AS INTEGER) AS rank, cls AS label, round(p, 6) AS probability
FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY p DESC, idx) AS rk FROM prob) WHERE rk <= {n}"""


def _top_n_query(spark, sf_dir, n):
    model = function_word_scorer()
    rec = prediction_records(D.scored_documents(spark, sf_dir, model), model, top_n=n)
    # outer generator: the plain one makes Spark infer a size() > 0 filter that it pushes
    # below the projections, evaluating cleaning and scoring twice
    exploded = rec.select("row_id", F.posexplode_outer("top_probabilities").alias("pos", "tp"))
    return exploded.where(F.col("pos").isNotNull()).select(
        "row_id", (F.col("pos") + 1).alias("rank"), F.col("tp.label").alias("label"),
        r6(F.col("tp.probability")).alias("probability"),
    )


@register("t2_top3_probabilities", O.with_(ALL, _TOPN.format(n=3)))
def t2_top3_probabilities(spark, sf_dir):
    return _top_n_query(spark, sf_dir, 3)


@register("x10_top_n_clamped", O.with_(ALL, "SELECT row_id, predicted_label, 0 AS n_probabilities FROM pred"))
def x10_top_n_clamped(spark, sf_dir):
    """A negative top_n is clamped to 0: every record stands, without probabilities."""
    model = function_word_scorer()
    rec = prediction_records(D.scored_documents(spark, sf_dir, model), model, top_n=-2)
    return rec.select("row_id", F.col("sentiment").alias("predicted_label"), F.size("top_probabilities").alias("n_probabilities"))


@register("x10_top_n_beyond_classes", O.with_(ALL, _TOPN.format(n=10)))
def x10_top_n_beyond_classes(spark, sf_dir):
    """A top_n above the number of classes returns every class, ranked."""
    return _top_n_query(spark, sf_dir, 10)


@register(
    "m6_batch_scoring",
    O.with_(ALL, "SELECT row_id, cleaned_text, predicted_label, round(confidence, 6) AS confidence FROM pred"),
)
def m6_batch_scoring(spark, sf_dir):
    return D.scored_documents(spark, sf_dir).select(
        "row_id", "cleaned_text", "predicted_label", r6(F.col("confidence")).alias("confidence")
    )


@register(
    "m7_prediction_record",
    O.with_(
        ALL,
        """SELECT row_id, predicted_label AS sentiment, round(confidence, 6) AS confidence, 'baseline' AS model,
                  'function_words' AS model_name, cleaned_text,
                  CASE WHEN confidence >= 0.70 THEN 'high' WHEN confidence >= 0.55 THEN 'medium' ELSE 'low' END AS band
           FROM pred""",
    ),
)
def m7_prediction_record(spark, sf_dir):
    model = function_word_scorer()
    rec = prediction_records(D.scored_documents(spark, sf_dir, model), model)
    return rec.select("row_id", "sentiment", r6(F.col("confidence")).alias("confidence"), "model", "model_name",
                      "cleaned_text", "band")


@register(
    "j1_truth_prediction_join",
    O.with_(PRED, "SELECT row_id, label AS true_label, predicted_label, round(confidence, 6) AS confidence FROM pred"),
)
def j1_truth_prediction_join(spark, sf_dir):
    """Predictions stored apart from the truth, re-aligned by an equi-join on row_id."""
    stored = D.predictions(spark, sf_dir).select("row_id", "predicted_label", "confidence")
    truth = D.test_rows(spark, sf_dir).select("row_id", F.col("label").alias("true_label"))
    return truth.join(stored, "row_id").select(
        "row_id", "true_label", "predicted_label", r6(F.col("confidence")).alias("confidence")
    )


@register("j1_bucketed_truth_predictions", ORACLE["j1_truth_prediction_join"])
def j1_bucketed_truth_predictions(spark, sf_dir):
    """J1 over stored tables: truth and predictions lie bucketed by row_id."""
    stored = D.predictions(spark, sf_dir).select("row_id", "predicted_label", "confidence")
    truth = D.test_rows(spark, sf_dir).select("row_id", F.col("label").alias("true_label"))
    return B.store(truth, stored, "row_id", B.buckets_for(stored)).join().select(
        "row_id", "true_label", "predicted_label", r6(F.col("confidence")).alias("confidence"))


@register("a7_confusion_matrix", O.with_(REPORT, "SELECT true_label, pred_label, count FROM cells"))
def a7_confusion_matrix(spark, sf_dir):
    model = function_word_scorer()
    return E.confusion_cells(D.predictions(spark, sf_dir, model), model.classes).select(
        "true_label", "pred_label", "count"
    )


@register(
    "j5_label_grid",
    O.with_(O.PREPARED, """labs AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS idx FROM (SELECT DISTINCT label FROM w1))
    SELECT a.idx::INT AS true_idx, a.label AS true_label, b.idx::INT AS pred_idx, b.label AS pred_label FROM labs a, labs b""".replace("labs AS", ", labs AS", 1)),
)
def j5_label_grid(spark, sf_dir):
    """The grid of the labels that the documents have."""
    labels = D.prepared_table(spark, sf_dir).select("label").distinct().orderBy("label").collect()  # k labels
    return E.label_grid(spark, [r[0] for r in labels]).select(
        F.col("true_idx").cast("int"), "true_label", F.col("pred_idx").cast("int"), "pred_label"
    )


@register("a8_accuracy", O.with_(REPORT, "SELECT round(accuracy, 6) AS accuracy FROM summ"))
def a8_accuracy(spark, sf_dir):
    return E.accuracy(D.predictions(spark, sf_dir)).select(r6(F.col("accuracy")).alias("accuracy"))


@register(
    "a9_class_report",
    O.with_(
        REPORT,
        """SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
                  CAST(support AS BIGINT) AS support FROM rep""",
    ),
)
def a9_class_report(spark, sf_dir):
    rep = E.class_report(D.predictions(spark, sf_dir))
    return rep.select("label", r6(F.col("precision")).alias("precision"), r6(F.col("recall")).alias("recall"),
                      r6(F.col("f1")).alias("f1"), "support")


@register(
    "u1_label_universe",
    O.with_(PRED, "SELECT label FROM pred UNION SELECT predicted_label FROM pred"),
)
def u1_label_universe(spark, sf_dir):
    pred = D.predictions(spark, sf_dir)
    return pred.select("label").union(pred.select(F.col("predicted_label").alias("label"))).distinct()


@register(
    "a10_a11_summary_metrics",
    O.with_(
        REPORT,
        """SELECT round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1, round(weighted_f1, 6) AS weighted_f1,
                  round(macro_precision, 6) AS macro_precision, round(macro_recall, 6) AS macro_recall,
                  round(weighted_precision, 6) AS weighted_precision, round(weighted_recall, 6) AS weighted_recall,
                  support FROM summ""",
    ),
)
def a10_a11_summary_metrics(spark, sf_dir):
    s = E.summary_metrics(E.class_report(D.predictions(spark, sf_dir)))
    cols = ["accuracy", "macro_f1", "weighted_f1", "macro_precision", "macro_recall", "weighted_precision",
            "weighted_recall"]
    return s.select(*[r6(F.col(c)).alias(c) for c in cols], "support")


@register(
    "a13_error_totals",
    O.with_(
        PRED,
        """SELECT count(*) AS total_examples, count(*) FILTER (WHERE label = predicted_label) AS total_correct,
                  count(*) FILTER (WHERE label <> predicted_label) AS total_wrong,
                  round(CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE label = predicted_label) / count(*)
                        ELSE 0.0 END, 6) AS derived_accuracy
           FROM pred""",
    ),
)
def a13_error_totals(spark, sf_dir):
    t = E.error_totals(D.predictions(spark, sf_dir))
    return t.select("total_examples", "total_correct", "total_wrong", r6(F.col("derived_accuracy")).alias("derived_accuracy"))
