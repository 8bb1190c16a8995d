"""Fitted models: the balanced softmax objective is minimised (KKT gradient test), the
TF-IDF pipeline scores, save / load round-trips, champion choice."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mixtext.operators import models as M
from mixtext.operators import prep
from mixtext.operators.scoring import score
from mixtext.plans import documents as D
from mixtext.session import materialize, scratch_path

from conftest import SF001


def test_embedding_lr_gradient_is_zero(spark):
    rng = np.random.default_rng(0)
    n, d, k = 300, 5, 3
    X = rng.normal(size=(n, d))
    y = rng.choice(k, size=n, p=[0.6, 0.3, 0.1])
    X += np.eye(k, d)[y] * 1.5
    rows = [(i, [float(v) for v in X[i]], str(y[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "row_id long, embedding array<double>, label string")
    model = M.EmbeddingModel.fit(df, max_iter=2000, tol=1e-10)
    lr = model.classifier.stages[-1]
    W = lr.coefficientMatrix.toArray()
    b = lr.interceptVector.toArray()
    Xn = X / np.linalg.norm(X, axis=1, keepdims=True)
    counts = np.bincount(y, minlength=k)
    w = n / (k * counts[y])
    Z = Xn @ W.T + b
    P = np.exp(Z - Z.max(axis=1, keepdims=True))
    P /= P.sum(axis=1, keepdims=True)
    Y = np.eye(k)[y]
    G = ((P - Y) * w[:, None]).T @ Xn / w.sum() + W / n
    gb = ((P - Y) * w[:, None]).sum(axis=0) / w.sum()
    assert np.abs(G).max() < 1e-5 and np.abs(gb).max() < 1e-5


def test_tfidf_model_scores_and_round_trips(spark):
    sp = materialize(D.split(spark, SF001), "t_split")
    train = sp.where("split = 'train'").drop("split")
    test = sp.where("split = 'test'").drop("split")
    model = M.TfidfModel.fit(train, max_iter=30)
    assert model.classes == sorted(model.classes)
    scored = score(test, model).select("row_id", "probabilities", "predicted_label")
    rows = scored.collect()
    assert rows and all(abs(sum(r.probabilities) - 1) < 1e-9 for r in rows)
    path = scratch_path(spark, "m")
    model.save(path)
    again = score(test, M.TfidfModel.load(path)).select("row_id", "predicted_label")
    assert again.exceptAll(scored.select("row_id", "predicted_label")).count() == 0
    metrics = M.evaluate(score(test, model), model).first()
    assert 0 <= metrics.accuracy <= 1 and len(metrics.confusion_matrix) == len(model.classes)


def test_champion_rank_ties_keep_candidate_order(spark):
    rows = [("a", "transformer", 0.5, 0.5, 0.5), ("b", "baseline", 0.5, 0.5, 0.5), ("c", "baseline", 0.9, 0.4, 0.9)]
    mets = [spark.createDataFrame([r], "model_name string, model_family string, accuracy double, macro_f1 double, "
                                       "weighted_f1 double") for r in rows]
    comp = M.comparison(M.candidates(*mets)).first()
    assert comp.champion_model == "a" and comp.mode == "comparison"
    only = M.comparison(M.candidates(mets[2])).first()
    assert only.mode == "baseline_only" and only.baseline_only


def test_encoder_udf_unit_vectors(spark):
    df = spark.createDataFrame([("a b c",), ("",)], "text string")
    enc = M.encoder_udf(M.hashing_encoder(16), batch_size=1)
    rows = df.select(enc(F.col("text")).alias("v")).collect()
    assert abs(np.linalg.norm(rows[0].v) - 1) < 1e-5 and np.linalg.norm(rows[1].v) == 0


def test_embedding_model_round_trips_under_its_name(spark):
    rows = [(i, [float(i % 3), 1.0, float(i % 2)], str(i % 3)) for i in range(60)]
    df = spark.createDataFrame(rows, "row_id long, embedding array<double>, label string")
    model = M.EmbeddingModel.fit(df, model_name="mine")
    path = scratch_path(spark, "m")
    model.save(path)
    loaded = M.EmbeddingModel.load(path)
    assert (loaded.model_name, loaded.classes, loaded.vector_col) == ("mine", model.classes, "embedding")
    a, b = ({r.row_id: r.probabilities for r in M.score_vectors(df, m).collect()} for m in (model, loaded))
    assert a == b
    with pytest.raises(FileNotFoundError):
        M.EmbeddingModel.load(path + "-none")


def test_feature_vocabulary_stays_a_table(spark):
    """Vectors by dictionary ids: equal rows stay apart, unseen terms drop out before the norm."""
    train = spark.createDataFrame([(1, "b a b"), (2, "a"), (2, "a"), (None, " ")], "row_id long, text string")
    fitted = M.TfidfModel.fit_features(train)
    known = {r["term"]: (r["term_id"], r["df"]) for r in fitted.dictionary.collect()}
    assert {t: df for t, (_, df) in known.items()} == {"a": 3, "b": 1, "b a": 1, "a b": 1}
    assert sorted(i for i, _ in known.values()) == [0, 1, 2, 3]

    def vector(**tf):
        w = {known[t][0]: n * (np.log(5 / (1 + known[t][1])) + 1) for t, n in tf.items()}
        norm = np.sqrt(sum(x * x for x in w.values()))
        return {i: x / norm for i, x in w.items()}

    want = [(1, vector(**{"a": 1, "b": 2, "b a": 1, "a b": 1})), (2, vector(a=1)), (2, vector(a=1)), (3, vector(b=1)), (4, {}), (None, {})]
    rows = train.where("row_id IS NOT NULL").unionByName(spark.createDataFrame([(3, "c b"), (4, "c"), (None, "")], train.schema))
    got = fitted.transform(rows)
    assert got.columns == ["row_id", "text", "features"]
    found = sorted(((r["row_id"], r["features"]) for r in got.collect()), key=lambda x: (x[0] is None, x[0]))
    assert [i for i, _ in found] == [i for i, _ in want]
    for (_, v), (_, w) in zip(found, want, strict=True):
        assert v.size == 4 and v.indices.tolist() == sorted(w)
        assert np.allclose(v.values, [w[i] for i in sorted(w)])
