"""From raw documents to sampled piece sequences, stage by stage.

Each stage takes what the stage before it kept, written as Parquet, and returns a table with
the columns of ``documents``; the last returns the pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixtext.llm import language_id
from mixtext.llm.common import read, tokenizer_file
from mixtext.llm.jaccard_join import CONTRACT, Rule, jaccard_components
from mixtext.llm.mixing import mixed
from mixtext.llm.piece_sampling import pieces
from mixtext.llm.queries import piece_digest
from mixtext.llm.secret_scan import masked, secrets
from mixtext.session import materialize

PIECES = "piece_bpe_32k.model"
NEAR = Rule(shingle=5, num=80)  # near copies of the stage; op10 keeps its contract


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is undetermined (no letters) go."""
    found = docs.withColumn("__language", language_id.predicted(spark, language_id.fit(docs), F.col("text")))
    return found.where(F.col("__language.lang_pred") != language_id.UNDETERMINED).select(*docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str, rule: Rule = CONTRACT) -> DataFrame:
    """Of each group of near copies the row with the smallest doc_id (null ids last) stays, then
    that with the smallest hash of its text, then of its other columns; of equal rows, one.

    Rows are told apart by id and text, so a repeated id joins no groups and texts without an
    id meet their copies too.
    """
    told = docs.withColumns({"__row": F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text"),
                             "__all": F.xxhash64(*[F.col(c).isNull() for c in docs.columns], *docs.columns)})
    classes = jaccard_components(told.select("__row", "text"), "__row", rule=rule).select(F.col("doc_id").alias("__row"), "component_id").distinct()
    keys = told.select("__row", "__all", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("t"), "__all").alias("first"))
    best = keys.join(classes, "__row").groupBy("component_id").agg(F.min(F.struct("first", "__row", "__all")).alias("m"))
    kept = told.join(best.select("m.__row", "m.__all"), ["__row", "__all"], "left_semi").dropDuplicates(["__row", "__all"])
    return kept.select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``deduplicate`` by the stage's rule: five words and 80 %."""
    return deduplicate(spark, docs, sf_dir, NEAR)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret in a text becomes ``<secret>``; n_chars follows; no document goes."""
    found = secrets(docs)
    some = F.size("secrets") > 0
    changed = found.withColumn("text", masked(F.col("text"), F.col("secrets")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed = changed.withColumn("n_chars", F.when(some, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return changed.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them (not at all to three times)."""
    return mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the encoding's length and checksum, whether it decodes to the text, and two
    sampled segmentations with their inclusion scores."""
    return piece_digest(pieces(docs.select("doc_id", "text"), tokenizer_file(PIECES), spare=True))


STAGES = [
    ("language_id", identify),
    ("jaccard_join", near_copies),
    ("secret_scan", mask_secrets),
    ("source_mix", mix_sources),
    ("pieces", encode),
]

# Learned models, compression and hashed draws have no SQL form: see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
