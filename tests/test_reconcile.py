"""Reconciliation rules: the reference's consistent baseline-only case, then one
mutation per rule (break one input, exactly that rule fails)."""

import pytest

from mixtext.operators import reconcile as RC

METRICS = "model_name string, accuracy double, confusion_matrix array<array<long>>, champion_model string, " \
          "mode string, baseline_only boolean"


def _inputs(spark, accuracy=0.75, matrix=([1, 1], [0, 2]), test_n=4, err_total=4, err_wrong=1,
            err_model="tfidf_baseline", saved="tfidf_baseline", mode="baseline_only"):
    comp = spark.createDataFrame([("tfidf_baseline", accuracy, [list(r) for r in matrix], "tfidf_baseline", mode,
                                   mode == "baseline_only")], METRICS)
    shown = RC.display_metrics(comp, None, None)
    test = spark.createDataFrame([(f"t{i}",) for i in range(test_n)], "text string")
    err = spark.createDataFrame([(err_model, err_total, err_wrong)],
                                "model_name string, total_examples long, total_wrong long")
    reg = spark.createDataFrame([(saved, True, 1.0)], "model_name string, champion boolean, registered_at double")
    return shown, test, err, reg


def _failed(spark, transformer=False, **kw):
    shown, test, err, reg = _inputs(spark, **kw)
    rows = RC.reconcile(shown, test, err, reg, transformer).collect()
    return {r.rule.split("_")[0] for r in rows if not r.ok and r.rule != "V10_verdict"}, rows


def test_consistent_state_is_ok(spark):
    failed, rows = _failed(spark)
    assert failed == set()
    verdict = [r for r in rows if r.rule == "V10_verdict"][0]
    assert verdict.ok is True


@pytest.mark.parametrize("kw,rule", [
    (dict(test_n=5, err_total=5), "V2"),
    (dict(err_total=3), "V3"),
    (dict(err_wrong=2), "V4"),
    (dict(accuracy=0.7), "V5"),
    (dict(err_model="other"), "V6"),
    (dict(saved="other"), "V8"),
])
def test_each_rule_catches_its_mutation(spark, kw, rule):
    failed, _ = _failed(spark, **kw)
    assert failed == {rule}


def test_baseline_only_with_transformer_metrics(spark):
    failed, _ = _failed(spark, transformer=True)
    assert failed == {"V9"}


def test_missing_inputs(spark):
    shown, test, err, reg = _inputs(spark)
    rows = RC.reconcile(shown, None, None, None, False).collect()
    failed = {r.rule.split("_")[0] for r in rows if not r.ok}
    assert failed == {"V1", "V7", "V8", "V10"}


def test_display_priority(spark):
    champ = spark.createDataFrame([("champ", 0.5, [[1]])], "model_name string, accuracy double, confusion_matrix array<array<long>>")
    base = spark.createDataFrame([("base", 0.4, [[1]])], "model_name string, accuracy double, confusion_matrix array<array<long>>")
    r = RC.display_metrics(None, champ, base).first()
    assert r.model_name == "champ" and r.mode == "champion_metrics_only"
    r = RC.display_metrics(None, None, base).first()
    assert r.model_name == "base" and r.mode == "baseline_only"


def test_every_rule_fails_in_some_run_and_says_why(spark):
    from mixtext.plans.q_reconcile import BROKEN, v_rules_over_runs

    rows = v_rules_over_runs(spark, "/root/testdata/sf0.001").collect()
    runs: dict = {}
    for r in rows:
        runs.setdefault(r.run, {})[int(r.rule[1:].split("_")[0])] = r
    assert all(len(rules) == 10 for rules in runs.values())
    for run, rules in runs.items():
        k = int(run.rsplit("/", 1)[1])
        if k == 0:
            assert all(r.ok and r.message.endswith(": ok") for r in rules.values())
        else:
            assert k in BROKEN and not rules[k].ok and not rules[10].ok and "expected" in rules[k].message
            assert rules[10].actual == sum(not r.ok for n, r in rules.items() if n < 10)


def test_runs_without_some_artifacts_and_no_runs(spark):
    from mixtext.operators import reconcile as RC

    empty = spark.createDataFrame([], RC.ARTIFACT_SCHEMA)
    assert RC.reconcile_runs(empty).count() == 0
    only = spark.createDataFrame([("r", "shown", "m", 0.5, 4, 2, None), ("r", "shown", "m", 0.5, 4, 2, None)], RC.ARTIFACT_SCHEMA)
    ok = {r.rule.split("_")[0]: r.ok for r in RC.reconcile_runs(only).collect()}
    assert not ok["V1"] and not ok["V7"] and not ok["V8"] and not ok["V10"] and ok["V2"] and ok["V5"] and ok["V9"]
