"""The document dataset used by the registered queries.

``documents(doc_id, text, lang, ...)`` stands in for the reference's raw delimited file:
``text`` is the text role, ``lang`` the label role and ``doc_id`` the row identity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixtext.operators import prep
from mixtext.session import materialize, read_table

TEST_SIZE = 0.2
SEED = 42


def raw_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "text", "lang")


def projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.project_clean(raw_documents(spark, sf_dir), "text", "lang")


def filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.keep_nonempty(projected(spark, sf_dir))


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.prepare(raw_documents(spark, sf_dir), "text", "lang")


# paths of tables already written in this application, by (app id, state of the input, params)
_WRITTEN: dict[tuple, str] = {}


def input_state(spark: SparkSession, path: str) -> str:
    """A digest of the names, sizes and times of a table's files (a listing, no contents)."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")
    return files.agg(F.md5(F.array_join(F.sort_array(F.collect_list(F.concat_ws("|", "path", "length", "modificationTime"))), ","))).first()[0]


def _table(spark: SparkSession, key: tuple, build) -> DataFrame:
    # the input's schema, files and sizes are part of the key: a changed input is written anew
    state = input_state(spark, f"{key[1].rstrip('/')}/documents.parquet")
    full = (spark.sparkContext.applicationId, state) + key
    if full not in _WRITTEN:
        df = materialize(build(), key[0])
        _WRITTEN[full] = df.inputFiles()[0].rsplit("/", 1)[0]
    return spark.read.parquet(_WRITTEN[full])


def prepared_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prepared rows written once to the shared folder (the cleaning UDF and the
    dedupe shuffle run once per application and input)."""
    return _table(spark, ("prepared", sf_dir), lambda: prepared(spark, sf_dir))


def split(spark: SparkSession, sf_dir: str, test_size: float = TEST_SIZE, seed: int = SEED) -> DataFrame:
    """Prepared rows with their split; the split's passes read the written prepared
    table, not the cleaning lineage, and the result is written once too."""
    return _table(spark, ("split", sf_dir, test_size, seed),
                  lambda: prep.stratified_split(prepared_table(spark, sf_dir), test_size=test_size, seed=seed))


def test_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split(spark, sf_dir).where(F.col("split") == "test").drop("split")


def train_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split(spark, sf_dir).where(F.col("split") == "train").drop("split")


def predictions(spark: SparkSession, sf_dir: str, model=None) -> DataFrame:
    """Test split scored by ``model`` (default: the frozen function-word scorer).

    Frozen scorers' predictions are written once per application, input and weights: the
    error queries filter them (wrong rows, drill-downs), and a Filter above the scoring
    projection would make the optimizer evaluate the scorer again inside the filter.
    """
    from mixtext.operators.scoring import TermWeightScorer, function_word_scorer, score

    model = model or function_word_scorer()
    if isinstance(model, TermWeightScorer):
        key = ("predictions", sf_dir, model.model_name, tuple(model.classes), tuple(model.weight_rows()),
               tuple(sorted(model.bias.items())))
        return _table(spark, key, lambda: score(test_rows(spark, sf_dir), model))
    return score(test_rows(spark, sf_dir), model)


def scored_documents(spark: SparkSession, sf_dir: str, model=None) -> DataFrame:
    """All prepared documents (not the test split alone) scored by a frozen scorer, written once."""
    from mixtext.operators.scoring import function_word_scorer, score

    model = model or function_word_scorer()
    key = ("scored", sf_dir, model.model_name, tuple(model.classes), tuple(model.weight_rows()), tuple(sorted(model.bias.items())))
    return _table(spark, key, lambda: score(prepared_table(spark, sf_dir), model))


def r6(c):
    """Round a derived double to 6 places for engine-independent comparison."""
    return F.round(c, 6)
