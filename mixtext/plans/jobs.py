"""End-to-end jobs: the reference's lifecycle as Spark jobs over tables.

preprocess -> train_baseline -> (train_embeddings) -> error_analysis -> validate.
Stage boundaries are tables / JSON reports under caller-given (shared) directories.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixtext.operators import errors as ER
from mixtext.operators import models as M
from mixtext.operators import prep
from mixtext.operators import reconcile as RC
from mixtext.operators.observe import materialize_observed, raw_metrics
from mixtext.operators.scoring import score
from mixtext.session import materialize, path_exists
from mixtext.sources import delimited as DL
from mixtext.sources import reports as RP


# the comparison report's map must not be inferred as a struct
COMPARISON_SCHEMA = (
    "experiment_name string, mode string, baseline_only boolean, champion_model string, champion_family string, "
    "models map<string, struct<model_family: string, accuracy: double, macro_f1: double, weighted_f1: double>>"
)


def preprocess(spark: SparkSession, input_path: str, output_dir: str, text_col=None, label_col=None,
               test_size: float = 0.2, random_state: int = 42, first_only: bool = False) -> dict[str, str]:
    """Delimited input -> split table + metadata."""
    if first_only:  # S2: the reference reads only the first file by name
        input_path = DL.list_inputs(spark, input_path)[0]
    raw, t, lab = DL.load_dataset(spark, input_path, text_col, label_col)
    raw, counts = materialize_observed(raw, "raw", raw_metrics())
    prepared = materialize(prep.prepare(raw, t, lab), "prepared")
    smallest = prep.min_class(prepared).first()  # one row
    if smallest["min_class_count"] is None:
        raise ValueError("No rows left after cleaning and filtering")
    stratified = bool(smallest["stratified"])
    split = prep.stratified_split(prepared, test_size, random_state, stratify=stratified)
    split_path = f"{output_dir}/split"
    counts |= RP.write_split_counted(split, split_path)
    meta = RP.dataset_metadata(raw, spark.read.parquet(split_path), input_path, t, lab, test_size, random_state,
                               stratified, counts)
    meta_path = f"{output_dir}/dataset_metadata"
    RP.write_json_report(meta, meta_path)
    return {"split": split_path, "metadata": meta_path}


def _metrics_report(metrics: DataFrame, path: str) -> DataFrame:
    RP.write_json_report(metrics, path)
    return metrics.sparkSession.read.schema(metrics.schema).json(path)


def train_baseline(spark: SparkSession, split_path: str, models_dir: str, reports_dir: str,
                   max_iter: int = 2000, tol: float = 1e-4) -> DataFrame:
    """Fit, evaluate, save, register; baseline-only champion when no
    embedding model has been trained."""
    train = RP.load_split(spark, split_path, "train")
    test = RP.load_split(spark, split_path, "test")
    model = M.TfidfModel.fit(train, max_iter=max_iter, tol=tol)
    model_path = f"{models_dir}/{model.model_name}"
    model.save(model_path)
    metrics = _metrics_report(M.evaluate(score(test, model), model), f"{reports_dir}/baseline_metrics")
    registry = f"{models_dir}/registry"
    M.register_model(spark, registry, model.model_name, model_path, "baseline")
    embedded = path_exists(spark, f"{reports_dir}/transformer_metrics") and path_exists(spark, f"{models_dir}/{M.TRANSFORMER_NAME}")
    if not embedded:  # its report and its model: one of them alone does not make a comparison
        comp = M.comparison(M.candidates(metrics))
        _finish_comparison(spark, comp, metrics, models_dir, reports_dir, {model.model_name: model_path})
    row = metrics.first()  # one metrics row
    M.log_run(spark, f"{models_dir}/runs", model.model_name,
              {"vectorizer": "CountVectorizer+IDF", "ngram_range": "1,2", "classifier": "LogisticRegression",
               "class_weight": "balanced", "max_iter": max_iter},
              {k: row[k] for k in ("accuracy", "macro_f1", "weighted_f1")}, [f"{reports_dir}/baseline_metrics"])
    return metrics


def _finish_comparison(spark, comp: DataFrame, metrics: DataFrame, models_dir: str, reports_dir: str,
                       paths: dict[str, str]) -> None:
    RP.write_json_report(comp, f"{reports_dir}/model_comparison")
    champion = comp.select("champion_model", "champion_family").first()  # one row
    champ_metrics = M.champion_metrics(comp, metrics)
    RP.write_json_report(champ_metrics, f"{reports_dir}/champion_metrics")
    M.register_model(spark, f"{models_dir}/registry", champion["champion_model"], paths[champion["champion_model"]],
                     champion["champion_family"], champion=True)


def train_embeddings(spark: SparkSession, split_path: str, models_dir: str, reports_dir: str, encoder_factory,
                     batch_size: int = 32, max_iter: int = 2000, tol: float = 1e-4) -> DataFrame:
    """Encoder -> balanced LR -> metrics -> champion over both candidates
    (the embedding model first: it wins ties, as in the reference)."""
    train = RP.load_split(spark, split_path, "train")
    test = RP.load_split(spark, split_path, "test")
    model = M.EmbeddingModel.fit(train, encoder=encoder_factory, batch_size=batch_size, max_iter=max_iter, tol=tol)
    model_path = f"{models_dir}/{model.model_name}"
    model.save(model_path)
    metrics = _metrics_report(M.evaluate(score(test, model), model), f"{reports_dir}/transformer_metrics")
    cands = [metrics]
    paths = {model.model_name: model_path}
    if path_exists(spark, f"{reports_dir}/baseline_metrics"):
        base = spark.read.schema(metrics.schema).json(f"{reports_dir}/baseline_metrics")
        cands.append(base)
        paths[M.BASELINE_NAME] = f"{models_dir}/{M.BASELINE_NAME}"
    allm = M.candidates(*cands)
    _finish_comparison(spark, M.comparison(allm), allm, models_dir, reports_dir, paths)
    return metrics


def error_analysis(spark: SparkSession, split_path: str, model, reports_dir: str, top_n: int = 20) -> dict:
    """M10 + S9 + S10: summary and hardest errors as JSON, the error list as CSV."""
    test = RP.load_split(spark, split_path, "test")
    scored = materialize(score(test, model), "scored")  # read by the summary and the error list
    out = ER.error_analysis(scored, model, top_n)
    RP.write_json_report(out["summary"], f"{reports_dir}/error_analysis")
    RP.write_json_report(out["hardest"], f"{reports_dir}/error_analysis_hardest")
    RP.write_error_csv(out["hardest"], f"{reports_dir}/error_analysis_top{top_n}_csv")
    return out


def validate(spark: SparkSession, split_path: str, models_dir: str, reports_dir: str) -> DataFrame:
    """V0-V10 over the written reports, registry and test split (missing inputs fail their rule)."""
    def read(name, schema=None):
        path = f"{reports_dir}/{name}"
        if not path_exists(spark, path):
            return None
        return spark.read.schema(schema).json(path) if schema else spark.read.json(path)

    comp = read("model_comparison", COMPARISON_SCHEMA)
    champ, base = read("champion_metrics"), read("baseline_metrics")
    comparison_rows = None
    if comp is not None:
        rows = comp.select("champion_model", "mode", "baseline_only", F.explode("models").alias("model_name", "m"))
        # the comparison map carries summary metrics; the matrix comes from the champion report
        if champ is not None:
            comparison_rows = rows.join(champ.select("model_name", "accuracy", "confusion_matrix"), "model_name")
    if comparison_rows is None and champ is None and base is None:
        return spark.createDataFrame(
            [("V0_metrics_present", False, None, None, None, None)],
            "rule string, ok boolean, expected double, actual double, expected_name string, actual_name string")
    shown = RC.display_metrics(comparison_rows, champ, base)
    # a missing test part fails its rule, it does not end the check
    test = RP.load_split(spark, split_path, "test") if path_exists(spark, f"{split_path}/split=test") else None
    err = read("error_analysis")
    registry = spark.read.parquet(f"{models_dir}/registry") if path_exists(spark, f"{models_dir}/registry") else None
    return RC.reconcile(shown, test, err, registry, path_exists(spark, f"{reports_dir}/transformer_metrics"))
