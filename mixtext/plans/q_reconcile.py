"""Queries for reconciliation (V0-V10, X6, J7) over the frozen-scorer artifacts."""

from __future__ import annotations

from pyspark.sql import functions as F

from mixtext.functions import scoring as S
from mixtext.operators import errors as ER
from mixtext.operators import models as M
from mixtext.operators import reconcile as RC
from mixtext.operators.scoring import article_scorer, function_word_scorer
from mixtext.plans import documents as D
from mixtext.plans import oracle as O
from mixtext.plans.catalog import register
from mixtext.plans.q_models import CANDS
from mixtext.session import scratch_path

RECON = CANDS + """,
champ AS (SELECT model_name, accuracy FROM cranked WHERE rank = 1),
allcells AS (SELECT 'function_words' AS model_name, * FROM a_cells UNION ALL SELECT 'articles', * FROM b_cells),
st AS (SELECT sum(count) AS total, sum(count) FILTER (WHERE true_idx = pred_idx) AS correct
       FROM allcells JOIN champ USING (model_name)),
allpred AS (SELECT 'function_words' AS model_name, label, predicted_label FROM a_pred
            UNION ALL SELECT 'articles', label, predicted_label FROM b_pred),
errs AS (SELECT count(*) AS err_total, count(*) FILTER (WHERE label <> predicted_label) AS err_wrong
         FROM allpred JOIN champ USING (model_name)),
trows AS (SELECT count(*) AS test_rows FROM split WHERE split = 'test'),
vals AS (SELECT * FROM champ, st, errs, trows),
rules AS (
  SELECT 'V1_test_split_present' AS rule, true AS ok, CAST(NULL AS DOUBLE) AS expected, CAST(NULL AS DOUBLE) AS actual,
         CAST(NULL AS VARCHAR) AS expected_name, CAST(NULL AS VARCHAR) AS actual_name
  UNION ALL SELECT 'V2_matrix_total_eq_test_rows', total = test_rows, test_rows, total, NULL, NULL FROM vals
  UNION ALL SELECT 'V3_error_total_eq_test_rows', err_total = test_rows, test_rows, err_total, NULL, NULL FROM vals
  UNION ALL SELECT 'V4_error_wrong_eq_matrix_wrong', err_wrong = total - correct, total - correct, err_wrong, NULL, NULL
            FROM vals
  UNION ALL SELECT 'V5_accuracy_eq_derived', coalesce(abs(correct / total - accuracy) <= 1e-8, false),
            round(correct / total, 6), round(accuracy, 6), NULL, NULL FROM vals
  UNION ALL SELECT 'V6_error_model_eq_champion', true, NULL, NULL, model_name, model_name FROM vals
  UNION ALL SELECT 'V7_error_summary_present', true, NULL, NULL, NULL, NULL
  UNION ALL SELECT 'V8_saved_champion_matches', true, NULL, NULL, model_name, model_name FROM vals
  UNION ALL SELECT 'V9_baseline_only_consistent', true, NULL, NULL, NULL, NULL)"""


def _artifacts(spark, sf_dir):
    """Metrics of both candidates, the comparison, the champion's error summary and registry."""
    models = {m.model_name: m for m in (function_word_scorer(), article_scorer())}
    metrics = [M.evaluate(D.predictions(spark, sf_dir, m), m) for m in models.values()]
    cands = M.candidates(*metrics)
    comp = M.comparison(cands)
    champion_name = comp.select("champion_model").first()[0]  # one name
    champion = models[champion_name]
    shown_src = cands.join(comp.select("champion_model", "mode", "baseline_only"),
                           cands.model_name == F.col("champion_model"))
    summary = ER.error_analysis(D.predictions(spark, sf_dir, champion), champion)["summary"]
    registry = M.register_model(spark, scratch_path(spark, "registry"), champion_name,
                                scratch_path(spark, "champion_model"), "baseline", champion=True)
    return shown_src, summary, registry


@register("v_reconciliation_rules", O.with_(RECON, """SELECT * FROM rules
UNION ALL SELECT 'V10_verdict', bool_and(ok), 0.0, CAST(count(*) FILTER (WHERE NOT ok) AS DOUBLE), NULL, NULL FROM rules"""))
def v_reconciliation_rules(spark, sf_dir):
    shown_src, summary, registry = _artifacts(spark, sf_dir)
    shown = RC.display_metrics(shown_src, None, None)
    return RC.reconcile(shown, D.test_rows(spark, sf_dir), summary, registry, transformer_metrics_present=False)


@register(
    "v0_display_metrics_source",
    O.with_(RECON, "SELECT model_name, round(accuracy, 6) AS accuracy, 'comparison' AS mode FROM champ"),
)
def v0_display_metrics_source(spark, sf_dir):
    shown_src, _, _ = _artifacts(spark, sf_dir)
    fallback = shown_src.select("model_name", "accuracy", "confusion_matrix")
    shown = RC.display_metrics(shown_src, fallback, fallback)
    return shown.select("model_name", F.round("accuracy", 6).alias("accuracy"), "mode")


@register(
    "x6_almost_equal",
    O.with_(RECON, """SELECT model_name, coalesce(abs(correct / total - accuracy) <= 1e-8, false) AS equal
                      FROM vals"""),
)
def x6_almost_equal(spark, sf_dir):
    """Reported accuracy vs trace / total of the reported matrix, 1e-8 absolute tolerance."""
    shown_src, _, _ = _artifacts(spark, sf_dir)
    from mixtext.operators import evaluate as E

    st = E.matrix_stats(shown_src, keep=["model_name", "accuracy"])
    return st.select("model_name", S.almost_equal(F.col("derived_accuracy"), F.col("accuracy")).alias("equal"))


@register(
    "j7_metrics_errors_split_join",
    O.with_(RECON + """,
    other AS (SELECT model_name AS o_model, count(*) AS o_total, count(*) FILTER (WHERE label <> predicted_label) AS o_wrong
              FROM allpred WHERE model_name NOT IN (SELECT model_name FROM champ) GROUP BY model_name)""",
            """SELECT 'same model' AS artifacts, model_name, total, err_total, test_rows, err_wrong, total - correct AS wrong FROM vals
    UNION ALL SELECT 'other model', model_name, total, NULL, test_rows, NULL, total - correct FROM vals
    UNION ALL SELECT 'other model', o_model, NULL, o_total, test_rows, o_wrong, NULL FROM other, trows"""),
)
def j7_metrics_errors_split_join(spark, sf_dir):
    """Reported metrics x error summary x split counts by model name (full outer join): once
    with the champion's own error summary, once with the other model's, which must not match."""
    from mixtext.operators import evaluate as E

    shown_src, summary, _ = _artifacts(spark, sf_dir)
    champion = shown_src.select("model_name").first()[0]  # one name
    other = next(m for m in (function_word_scorer(), article_scorer()) if m.model_name != champion)
    foreign = ER.error_analysis(D.predictions(spark, sf_dir, other), other)["summary"]
    st = E.matrix_stats(shown_src, keep=["model_name"]).select("model_name", "total", "wrong")
    tests = D.test_rows(spark, sf_dir).agg(F.count(F.lit(1)).alias("test_rows")).withColumn("_one", F.lit(1))
    out = None
    for name, err in (("same model", summary), ("other model", foreign)):
        err = err.select("model_name", F.col("total_examples").alias("err_total"), F.col("total_wrong").alias("err_wrong"))
        # the split count belongs to every row, matched or not
        rows = st.join(err, "model_name", "full_outer").withColumn("_one", F.lit(1)).join(tests, "_one") \
            .select(F.lit(name).alias("artifacts"), "model_name", "total", "err_total", "test_rows", "err_wrong", "wrong")
        out = rows if out is None else out.unionByName(rows)
    return out


BROKEN = {  # what is changed in the run's artifacts so that the rule of that number fails
    1: "the test split is missing", 2: "the matrix counts one row more", 3: "the error summary counts one row more",
    4: "it counts one error more", 5: "the stated accuracy is 0.01 higher", 6: "it names another model", 7: "it is missing",
    8: "the registry names another model", 9: "a baseline-only comparison stands beside embedding metrics",
}


@register(
    "v_rules_over_runs",
    O.with_(CANDS + """,
base AS (SELECT label, count(*) AS n, count(*) FILTER (WHERE label <> predicted_label) AS e FROM a_pred GROUP BY label),
r AS (SELECT label || '/' || k AS run, k, CASE WHEN k <> 1 THEN n END AS test_rows, n + (k = 2)::INT AS total, e AS wrong,
    (n - e) / n + CASE WHEN k = 5 THEN 0.01 ELSE 0 END AS accuracy, CASE WHEN k <> 7 THEN n + (k = 3)::INT END AS err_total,
    CASE WHEN k <> 7 THEN e + (k = 4)::INT END AS err_wrong, CASE WHEN k = 6 THEN 'other' WHEN k <> 7 THEN 'function_words' END AS err_model,
    CASE WHEN k = 8 THEN 'other' ELSE 'function_words' END AS saved FROM base, (SELECT unnest(range(0, 10)) AS k)),
v AS (SELECT run, 'V1_test_split_present' AS rule, test_rows IS NOT NULL AS ok, NULL::DOUBLE AS expected, NULL::DOUBLE AS actual, NULL AS expected_name, NULL AS actual_name FROM r
UNION ALL SELECT run, 'V2_matrix_total_eq_test_rows', test_rows IS NULL OR total = test_rows, test_rows, total, NULL, NULL FROM r
UNION ALL SELECT run, 'V3_error_total_eq_test_rows', err_total IS NULL OR test_rows IS NULL OR err_total = test_rows, test_rows, err_total, NULL, NULL FROM r
UNION ALL SELECT run, 'V4_error_wrong_eq_matrix_wrong', err_total IS NULL OR err_wrong = wrong, wrong, err_wrong, NULL, NULL FROM r
UNION ALL SELECT run, 'V5_accuracy_eq_derived', err_total IS NULL OR abs((total - wrong) / total - accuracy) <= 1e-8,
    round((total - wrong) / total, 6), round(accuracy, 6), NULL, NULL FROM r
UNION ALL SELECT run, 'V6_error_model_eq_champion', err_model IS NULL OR err_model = 'function_words', NULL, NULL, 'function_words', err_model FROM r
UNION ALL SELECT run, 'V7_error_summary_present', err_total IS NOT NULL, NULL, NULL, NULL, NULL FROM r
UNION ALL SELECT run, 'V8_saved_champion_matches', saved = 'function_words', NULL, NULL, 'function_words', saved FROM r
UNION ALL SELECT run, 'V9_baseline_only_consistent', k <> 9, NULL, NULL, NULL, NULL FROM r),
w AS (SELECT * FROM v UNION ALL SELECT run, 'V10_verdict', bool_and(ok), 0.0, count(*) FILTER (WHERE NOT ok), NULL, NULL FROM v GROUP BY run)""", """SELECT *, rule || CASE WHEN ok THEN ': ok' ELSE ': expected ' || coalesce(expected_name, expected::VARCHAR, 'nothing')
    || ', found ' || coalesce(actual_name, actual::VARCHAR, 'nothing') END AS message FROM w"""),
)
def v_rules_over_runs(spark, sf_dir):
    """V1-V10 over many runs at once: one run for each label of the test split and each entry of
    BROKEN (0: intact), all checked by one grouped aggregate; every rule fails somewhere."""
    preds = D.predictions(spark, sf_dir, function_word_scorer())
    base = preds.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("label") != F.col("predicted_label")).alias("e"))
    runs = base.select("*", F.explode(F.array(*[F.lit(k) for k in (0, *BROKEN)])).alias("k")) \
        .withColumn("run", F.concat_ws("/", "label", F.col("k").cast("string")))
    k = F.col("k")

    def artifact(kind, when=None, name=None, accuracy=None, total=None, wrong=None, flag=None):
        values = ((name, "model_name", "string"), (accuracy, "accuracy", "double"), (total, "total", "long"), (wrong, "wrong", "long"), (flag, "flag", "boolean"))
        s = F.struct(F.lit(kind).alias("artifact"), *[(F.lit(None) if v is None else v).cast(t).alias(c) for v, c, t in values])
        return s if when is None else F.when(when, s)

    model, other = F.lit("function_words"), F.lit("other")
    rows = F.array_compact(F.array(
        artifact("shown", name=model, accuracy=(F.col("n") - F.col("e")) / F.col("n") + F.when(k == 5, 0.01).otherwise(0.0),
                 total=F.col("n") + (k == 2).cast("int"), wrong=F.col("e"), flag=k == 9),
        artifact("test_split", when=k != 1, total=F.col("n")),
        artifact("error_summary", when=k != 7, name=F.when(k == 6, other).otherwise(model), total=F.col("n") + (k == 3).cast("int"),
                 wrong=F.col("e") + (k == 4).cast("int")),
        artifact("registry", name=F.when(k == 8, other).otherwise(model)),
        artifact("transformer_metrics", when=k == 9, flag=F.lit(True))))
    return RC.reconcile_runs(runs.select("run", F.explode(rows).alias("a")).select("run", "a.*"))
