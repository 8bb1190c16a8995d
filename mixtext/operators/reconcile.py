"""Cross-artifact reconciliation (V0-V10, X6, J7), re-aimed at tables.

Inputs are the small per-model / per-run tables (metrics rows, comparison row, error
summary row, registry) plus the test split, whose size is recomputed distributedly.
Output: one row per rule ``(rule, ok, expected, actual, expected_name, actual_name)``
and a verdict row ``V10``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixtext.functions import scoring as S
from mixtext.operators import evaluate as E
from mixtext.operators.util import side_by_side

def display_metrics(comparison: DataFrame | None, champion: DataFrame | None, baseline: DataFrame | None) -> DataFrame:
    """V0: comparison[champion], else the champion metrics, else the baseline metrics.

    Each input is a (possibly empty or missing) metrics table with ``model_name``,
    ``accuracy`` and ``confusion_matrix``; ``comparison`` also has ``champion_model`` and
    ``mode``. Returns at most one row with the chosen metrics and its ``source``.
    """
    parts = []
    if comparison is not None:
        parts.append(
            comparison.where(F.col("model_name") == F.col("champion_model")).select(
                "model_name", "accuracy", "confusion_matrix", F.col("mode"), F.col("baseline_only"),
                F.lit(0).alias("priority"),
            )
        )
    if champion is not None:
        parts.append(champion.select("model_name", "accuracy", "confusion_matrix",
                                     F.lit("champion_metrics_only").alias("mode"), F.lit(False).alias("baseline_only"),
                                     F.lit(1).alias("priority")))
    if baseline is not None:
        parts.append(baseline.select("model_name", "accuracy", "confusion_matrix", F.lit("baseline_only").alias("mode"),
                                     F.lit(True).alias("baseline_only"), F.lit(2).alias("priority")))
    stacked = reduce(DataFrame.unionByName, parts)
    best = F.min_by(F.struct("model_name", "accuracy", "confusion_matrix", "mode", "baseline_only", "priority"),
                    F.col("priority"))
    return stacked.agg(best.alias("m")).where(F.col("m").isNotNull()).select("m.*")


def _rule(name, ok, expected=None, actual=None, expected_name=None, actual_name=None):
    lit_null = F.lit(None)
    return F.struct(
        F.lit(name).alias("rule"),
        F.coalesce(ok, F.lit(False)).alias("ok"),
        (expected if expected is not None else lit_null).cast("double").alias("expected"),
        (actual if actual is not None else lit_null).cast("double").alias("actual"),
        (expected_name if expected_name is not None else lit_null).cast("string").alias("expected_name"),
        (actual_name if actual_name is not None else lit_null).cast("string").alias("actual_name"),
    )


def _rules(transformer) -> list:
    """V1-V9 over a row that holds what each artifact says; ``transformer``: whether metrics of
    an embedding model are there."""
    has_test = F.col("test_rows").isNotNull()
    has_err = F.coalesce(F.col("has_err"), F.lit(False))
    baseline_only = F.coalesce(F.col("baseline_only"), F.lit(False)) | (F.col("mode") == "baseline_only")
    return [
        _rule("V1_test_split_present", has_test),
        _rule("V2_matrix_total_eq_test_rows",
              ~has_test | F.col("total").isNull() | (F.col("total") == F.col("test_rows")),
              F.col("test_rows"), F.col("total")),
        _rule("V3_error_total_eq_test_rows",
              ~has_err | ~has_test | F.col("err_total").eqNullSafe(F.col("test_rows")),
              F.col("test_rows"), F.col("err_total")),
        _rule("V4_error_wrong_eq_matrix_wrong",
              ~has_err | F.col("wrong").isNull() | F.col("err_wrong").eqNullSafe(F.col("wrong")),
              F.col("wrong"), F.col("err_wrong")),
        _rule("V5_accuracy_eq_derived",
              ~has_err | S.almost_equal(F.col("derived_accuracy"), F.col("accuracy")),
              F.round(F.col("derived_accuracy"), 6), F.round(F.col("accuracy"), 6)),
        _rule("V6_error_model_eq_champion",
              ~has_err | F.col("err_model").isNull() | (F.col("err_model") == F.col("model_name")),
              expected_name=F.col("model_name"), actual_name=F.col("err_model")),
        _rule("V7_error_summary_present", has_err),
        _rule("V8_saved_champion_matches",
              F.col("saved_model").isNotNull() & (F.col("saved_model") == F.col("model_name")),
              expected_name=F.col("model_name"), actual_name=F.col("saved_model")),
        _rule("V9_baseline_only_consistent", ~(baseline_only & F.coalesce(transformer, F.lit(False)))),
    ]


# What each kind of artifact row of a run says, by the names the rules use.
ARTIFACTS = {
    "shown": {"model_name": "model_name", "accuracy": "accuracy", "total": "total", "wrong": "wrong", "baseline_only": "flag"},
    "test_split": {"test_rows": "total"},
    "error_summary": {"err_model": "model_name", "err_total": "total", "err_wrong": "wrong"},
    "registry": {"saved_model": "model_name"},
    "transformer_metrics": {"transformer": "flag"},
}
ARTIFACT_SCHEMA = "run string, artifact string, model_name string, accuracy double, total long, wrong long, flag boolean"


def reconcile_runs(artifacts: DataFrame) -> DataFrame:
    """V1-V10 for every run at once: (run, rule, ok, expected, actual, expected_name,
    actual_name, message).

    ``artifacts`` has the columns of ARTIFACT_SCHEMA, one row for each artifact that a run has
    (of several the largest value of each field counts). One aggregate grouped by run brings
    them together; a run without any artifact has no rows. V10 sums up its run.
    """
    facts = [F.max(F.when(F.col("artifact") == kind, F.col(column))).alias(name)
             for kind, fields in ARTIFACTS.items() for name, column in fields.items()]
    row = artifacts.groupBy("run").agg(*facts, F.bool_or(F.col("artifact") == "error_summary").alias("has_err"))
    derived = F.when(F.col("total") > 0, (F.col("total") - F.col("wrong")) / F.col("total"))
    row = row.withColumns({"derived_accuracy": derived, "mode": F.lit(None).cast("string")})
    rules = row.select("run", F.array(*_rules(F.col("transformer"))).alias("rules"))
    broken = F.size(F.filter("rules", lambda r: ~r["ok"]))
    verdict = _rule("V10_verdict", broken == 0, F.lit(0.0), broken)
    out = rules.select("run", F.explode(F.concat("rules", F.array(verdict))).alias("r")).select("run", "r.*")

    def said(number, name):
        return F.coalesce(F.col(name), F.col(number).cast("string"), F.lit("nothing"))

    message = F.when(F.col("ok"), F.concat("rule", F.lit(": ok"))).otherwise(
        F.concat("rule", F.lit(": expected "), said("expected", "expected_name"), F.lit(", found "), said("actual", "actual_name")))
    return out.withColumn("message", message)


def reconcile(shown: DataFrame, test_split: DataFrame | None, error_summary: DataFrame | None,
              registry: DataFrame | None, transformer_metrics_present: bool) -> DataFrame:
    """V1-V10 over one-row inputs (joined side by side, never a cross join)."""
    stats = E.matrix_stats(shown, keep=["model_name", "accuracy", "mode", "baseline_only"])
    frames = [stats]
    if test_split is not None:
        frames.append(test_split.agg(F.count(F.lit(1)).alias("test_rows")))
    if error_summary is not None:
        frames.append(error_summary.select(F.col("model_name").alias("err_model"),
                                           F.col("total_examples").alias("err_total"),
                                           F.col("total_wrong").alias("err_wrong"), F.lit(True).alias("has_err")))
    if registry is not None:
        frames.append(registry.where("champion").agg(F.max_by("model_name", "registered_at").alias("saved_model")))
    row = side_by_side(*frames)
    for c, t in (("test_rows", "long"), ("err_model", "string"), ("err_total", "long"), ("err_wrong", "long"),
                 ("has_err", "boolean"), ("saved_model", "string")):
        if c not in row.columns:
            row = row.withColumn(c, F.lit(None).cast(t))
    rules = _rules(F.lit(bool(transformer_metrics_present)))
    out = row.select(F.explode(F.array(*rules)).alias("r")).select("r.*")
    verdict = out.agg(
        F.bool_and("ok").alias("ok"),
        F.count_if(~F.col("ok")).cast("double").alias("actual"),
    ).select(F.lit("V10_verdict").alias("rule"), "ok", F.lit(0.0).alias("expected"), "actual",
             F.lit(None).cast("string").alias("expected_name"), F.lit(None).cast("string").alias("actual_name"))
    return out.unionByName(verdict)
