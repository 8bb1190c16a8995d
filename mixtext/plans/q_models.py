"""Queries for models and champion selection.

Oracle-checked rows compare two frozen scorers (integer weights, exact in both engines);
fitted models are covered by rows-only checks and the property tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from mixtext.operators import bucketed as B
from mixtext.operators import models as M
from mixtext.operators import prep
from mixtext.operators.scoring import ARTICLES, FUNCTION_WORDS, article_scorer, function_word_scorer, score
from mixtext.plans import documents as D
from mixtext.plans import oracle as O
from mixtext.plans.catalog import ORACLE, register
from mixtext.plans.documents import r6
from mixtext.session import materialize, read_table, scratch_path

CANDS = (
    O.SPLIT + ",\n" + O.scorer_ctes(FUNCTION_WORDS, "a_") + ",\n" + O.report_ctes("a_") + ",\n"
    + O.scorer_ctes(ARTICLES, "b_") + ",\n" + O.report_ctes("b_") + """,
cand AS (SELECT 'function_words' AS model_name, 'baseline' AS model_family, 0 AS position, * FROM a_summ
         UNION ALL SELECT 'articles', 'baseline', 1, * FROM b_summ),
cranked AS (SELECT *, row_number() OVER (ORDER BY coalesce(macro_f1, 0.0) DESC, coalesce(weighted_f1, 0.0) DESC,
                                         coalesce(accuracy, 0.0) DESC, position) AS rank FROM cand)"""
)


def _candidates(spark, sf_dir):
    mods = [function_word_scorer(), article_scorer()]
    metrics = [M.evaluate(D.predictions(spark, sf_dir, m), m) for m in mods]
    return M.candidates(*metrics)


@register(
    "w4_champion_rank",
    O.with_(CANDS, """SELECT model_name, CAST(rank AS INTEGER) AS rank, round(macro_f1, 6) AS macro_f1,
                             round(weighted_f1, 6) AS weighted_f1, round(accuracy, 6) AS accuracy FROM cranked"""),
)
def w4_champion_rank(spark, sf_dir):
    r = M.champion_rank(_candidates(spark, sf_dir))
    return r.select("model_name", "rank", *[r6(F.col(c)).alias(c) for c in ("macro_f1", "weighted_f1", "accuracy")])


@register("u3_candidate_set", O.with_(CANDS, "SELECT model_name, model_family, position FROM cand"))
def u3_candidate_set(spark, sf_dir):
    return _candidates(spark, sf_dir).select("model_name", "model_family", "position")


@register(
    "m9_champion_selection",
    O.with_(CANDS, """SELECT 'comparison' AS mode, false AS baseline_only, model_name AS champion_model,
                             model_family AS champion_family FROM cranked WHERE rank = 1"""),
)
def m9_champion_selection(spark, sf_dir):
    return M.comparison(_candidates(spark, sf_dir)).select("mode", "baseline_only", "champion_model", "champion_family")


@register(
    "m8_baseline_only_champion",
    O.with_(CANDS, """SELECT 'baseline_only' AS mode, true AS baseline_only, model_name AS champion_model,
                             model_family AS champion_family FROM cand WHERE position = 0"""),
)
def m8_baseline_only_champion(spark, sf_dir):
    m = function_word_scorer()
    only = M.candidates(M.evaluate(D.predictions(spark, sf_dir, m), m))
    return M.comparison(only).select("mode", "baseline_only", "champion_model", "champion_family")


@register(
    "x9_model_map_explode",
    O.with_(CANDS, """SELECT model_name AS model, model_family AS family, round(accuracy, 6) AS accuracy,
                             round(macro_f1, 6) AS macro_f1, round(weighted_f1, 6) AS weighted_f1,
                             rank = 1 AS champion FROM cranked"""),
)
def x9_model_map_explode(spark, sf_dir):
    rows = M.explode_models(M.comparison(_candidates(spark, sf_dir)))
    return rows.select("model", "family", *[r6(F.col(c)).alias(c) for c in ("accuracy", "macro_f1", "weighted_f1")],
                       "champion")


@register(
    "j4_champion_metrics",
    O.with_(CANDS, """SELECT model_name, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1,
                             round(weighted_f1, 6) AS weighted_f1 FROM cranked WHERE rank = 1"""),
)
def j4_champion_metrics(spark, sf_dir):
    cands = _candidates(spark, sf_dir)
    out = M.champion_metrics(M.comparison(cands), cands)
    return out.select("model_name", *[r6(F.col(c)).alias(c) for c in ("accuracy", "macro_f1", "weighted_f1")])


@register(
    "u2_metrics_union",
    O.with_(CANDS, """SELECT model_name, model_family, round(macro_f1, 6) AS macro_f1, rank = 1 AS champion
                      FROM cranked"""),
)
def u2_metrics_union(spark, sf_dir):
    """Per-model reports stacked by name; the champion comes from the rank (not a fixed model)."""
    r = M.champion_rank(_candidates(spark, sf_dir))
    return r.select("model_name", "model_family", r6(F.col("macro_f1")).alias("macro_f1"),
                    (F.col("rank") == 1).alias("champion"))


@register(
    "j6_text_embedding_join",
    """SELECT d.doc_id, d.lang, e.label, len(e.embedding)::INT AS dims, round(list_sum(list_transform(e.embedding,
              lambda x: x::DOUBLE)), 6) AS total FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id""",
)
def j6_text_embedding_join(spark, sf_dir):
    """Every text with its stored vector; a text without one keeps its row."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang")
    emb = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "label", "embedding")
    total = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x)
    return docs.join(emb, "doc_id", "left").select("doc_id", "lang", "label", F.size("embedding").alias("dims"), r6(total).alias("total"))


@register("j6_bucketed_text_embeddings", ORACLE["j6_text_embedding_join"])
def j6_bucketed_text_embeddings(spark, sf_dir):
    """J6 over stored tables: both sides lie bucketed by id, so the join moves no rows."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang")
    emb = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "label", "embedding")
    total = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x)
    joined = B.store(docs, emb, "doc_id", B.buckets_for(emb)).join("left")
    return joined.select("doc_id", "lang", "label", F.size("embedding").alias("dims"), r6(total).alias("total"))


def fit_tfidf(spark, sf_dir):
    """M1 + M2 to the gradient test."""
    return M.TfidfModel.fit(D.train_rows(spark, sf_dir))  # the split is a written table


@register(
    "m2_tfidf_fit_gradient",
    O.with_(O.SPLIT, "SELECT count(*) AS train_rows, count(DISTINCT label) AS classes, true AS at_optimum FROM split WHERE split = 'train'"),
)
def m2_tfidf_fit_gradient(spark, sf_dir):
    """M2 over TF-IDF: no entry of the gradient, summed anew by term from the long table and
    the coefficients, exceeds 1e-4."""
    train = D.train_rows(spark, sf_dir)  # the split is a written table
    peak = M.TfidfModel.fit(train).gradient_peak(train)
    return train.agg(F.count("*").alias("train_rows"), F.count_distinct("label").alias("classes"),
                     F.lit(bool(peak <= 1.0001 * M.GRADIENT_TOL)).alias("at_optimum"))


@register("m3_fitted_tfidf_metrics")
def m3_fitted_tfidf_metrics(spark, sf_dir):
    """M1 + M2 + M3: fit TF-IDF + balanced softmax LR on train, evaluate on test."""
    model = fit_tfidf(spark, sf_dir)
    return M.evaluate(score(D.test_rows(spark, sf_dir), model), model).drop("labels", "confusion_matrix")


def embedding_split(spark, sf_dir):
    emb = read_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"), "embedding", F.col("label").cast("string").alias("label")
    )
    return prep.stratified_split(emb)


@register(
    "m2_fit_gradient",
    """WITH v AS (SELECT vec_id AS row_id, label::VARCHAR AS label FROM embeddings),
    """ + O.split_ctes(source="v").replace("r.row_id, r.original_text, r.text, r.label", "r.row_id, r.label") + """
    SELECT count(*) AS train_rows, count(DISTINCT label) AS classes, true AS at_optimum FROM split WHERE split = 'train'""",
)
def m2_fit_gradient(spark, sf_dir):
    """M2: the fit on the given vectors ends at its optimum: no entry of the gradient of the
    mean weighted loss plus penalty, computed anew over the training rows, exceeds 1e-4."""
    train = materialize(embedding_split(spark, sf_dir).where("split = 'train'"), "train")
    model = M.EmbeddingModel.fit(train)
    weighted, n, classes = M._weighted(train, "label")
    peak = M.gradient_peak(model.classifier, M.EmbeddingModel._features(weighted, "embedding"), n)
    return train.agg(F.count("*").alias("train_rows"), F.count_distinct("label").alias("classes"),
                     F.lit(bool(peak <= M.GRADIENT_TOL)).alias("at_optimum"))


@register("m4_embedding_model_metrics")
def m4_embedding_model_metrics(spark, sf_dir):
    """M4: balanced softmax LR on stored, L2-normalised vectors; evaluated on its test split."""
    sp = embedding_split(spark, sf_dir)
    model = M.EmbeddingModel.fit(sp.where("split = 'train'"))
    scored = M.score_vectors(sp.where("split = 'test'"), model)
    return M.evaluate(scored, model).drop("labels", "confusion_matrix")


@register("m5_encoder_udf")
def m5_encoder_udf(spark, sf_dir):
    """M5: texts -> unit vectors through the per-worker cached encoder (Arrow batches)."""
    docs = D.prepared(spark, sf_dir)
    enc = M.encoder_udf(M.hashing_encoder(64), batch_size=32)
    return docs.select("row_id", enc(F.col("text")).alias("embedding"))


@register("s11_model_roundtrip")
def s11_model_roundtrip(spark, sf_dir):
    """Save the fitted model to the shared folder, load it, score the test split."""
    model = fit_tfidf(spark, sf_dir)
    path = scratch_path(spark, "model")
    model.save(path)
    loaded = M.TfidfModel.load(path)
    return score(D.test_rows(spark, sf_dir), loaded).select("row_id", "predicted_label", "confidence")


@register(
    "s12_run_log",
    O.with_(CANDS, """SELECT model_name AS run_name, 'frozen' AS kind, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1,
                             round(weighted_f1, 6) AS weighted_f1, true AS timed FROM cand"""),
)
def s12_run_log(spark, sf_dir):
    """One run per candidate appended to a runs table (params, metrics, artifacts)."""
    runs = scratch_path(spark, "runs")
    out = None
    for m in (function_word_scorer(), article_scorer()):
        row = M.evaluate(D.predictions(spark, sf_dir, m), m).first()  # one metrics row
        out = M.log_run(spark, runs, m.model_name, {"kind": m.kind, "terms": len(m.weights)},
                        {k: row[k] for k in ("accuracy", "macro_f1", "weighted_f1")}, [])
    return out.select("run_name", F.col("params.kind").alias("kind"),
                      *[r6(F.col("metrics")[k]).alias(k) for k in ("accuracy", "macro_f1", "weighted_f1")],
                      (F.col("ts") > 0).alias("timed"))
