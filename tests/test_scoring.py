"""Scoring properties on the frozen scorer and the probability functions."""

import math

from pyspark.sql import functions as F

from mixtext.functions import scoring as S
from mixtext.operators.scoring import TermWeightScorer, function_word_scorer, prediction_records, score
from mixtext.plans import documents as D

from conftest import SF001


def test_probabilities_sum_to_one_and_argmax(spark):
    model = function_word_scorer()
    pred = D.predictions(spark, SF001, model)
    rows = pred.select("probabilities", "predicted_label", "confidence").collect()
    assert rows
    for r in rows:
        assert math.isclose(sum(r.probabilities), 1.0, abs_tol=1e-9)
        i = max(range(len(r.probabilities)), key=lambda k: (r.probabilities[k], -k))
        assert r.predicted_label == model.classes[i] and r.confidence == r.probabilities[i]


def test_ties_take_first_class_and_top_n(spark):
    model = TermWeightScorer("t", {"x": {"a": 1}, "y": {"b": 1}}, classes=["a", "b", "c"])
    df = spark.createDataFrame([(1, "x y"), (2, "nothing"), (3, "y y x")], "row_id long, text string")
    rec = {r.row_id: r for r in prediction_records(score(df, model), model, top_n=3).collect()}
    assert rec[1].sentiment == "a" and rec[2].sentiment == "a" and rec[3].sentiment == "b"
    assert [t.label for t in rec[1].top_probabilities] == ["a", "b", "c"]
    assert [t.label for t in rec[3].top_probabilities][:1] == ["b"]
    none = prediction_records(score(df, model), model, top_n=-1).first()
    assert none.top_probabilities == []


def test_band_thresholds(spark):
    df = spark.createDataFrame([(0.70,), (0.6999,), (0.55,), (0.5499,)], "c double")
    assert [r[0] for r in df.select(S.confidence_band(F.col("c"))).collect()] == ["high", "medium", "medium", "low"]


def test_almost_equal(spark):
    df = spark.createDataFrame([(0.75, 0.75 + 5e-9), (0.75, 0.7501), (None, 0.1)], "a double, b double")
    assert [r[0] for r in df.select(S.almost_equal(F.col("a"), F.col("b"))).collect()] == [True, False, False]
