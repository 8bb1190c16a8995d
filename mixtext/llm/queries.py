"""One thin query per operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixtext.llm import language_id, toxicity
from mixtext.llm.centroids import cluster, with_inertia
from mixtext.llm.codebooks import compress, with_group_sum
from mixtext.llm.common import held_out, read, tokenizer_file
from mixtext.llm.jaccard_join import jaccard_components
from mixtext.llm.licenses import licenses
from mixtext.llm.mixing import mix
from mixtext.llm.neighbours import nearest
from mixtext.llm.oracle import ORACLE as ORACLE
from mixtext.llm.pii import BASE, count, personal_data, span_list
from mixtext.llm.piece_sampling import pieces
from mixtext.llm.quality_rules import quality
from mixtext.llm.secret_scan import secrets
from mixtext.llm.token_files import token_files


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id", *[count(F.col("pii"), k).alias(f"n_{k}") for k in BASE],
        F.sha2(span_list(base), 256).alias("base_sha256"), span_list(F.col("pii")).alias("spans"),
        F.array_join(F.transform("pii", lambda s: s["score"].cast("string")), ",").alias("scores"))


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return toxicity.toxicity(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs)
    return language_id.language(docs.select("doc_id", "text"), model) \
        .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                                "n_repeat_words", "base_failed", "kept", "failed_rules")


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets(read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["kind"] != "novel")
    return found.select(
        "doc_id", *[count(F.col("secrets"), k).alias(f"n_{k}") for k in ("assign", "access", "hex", "novel")],
        F.sha2(span_list(base), 256).alias("base_sha256"), span_list(F.col("secrets")).alias("spans"))


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return piece_digest(pieces(docs, tokenizer_file("piece_bpe_32k.model")))


def piece_digest(found: DataFrame) -> DataFrame:
    """One narrow row per document: ids as their count and crc32 (of the packed ids)."""
    drawn = F.transform("pieces.samples", lambda s: F.struct(
        s["n_ids"].alias("n_ids"), F.crc32(s["ids"]).alias("ids_crc32"), s["log_prob"].alias("log_prob"),
        s["perturbed"].alias("perturbed"), s["log_inclusion"].alias("log_inclusion")))
    return found.select("doc_id", F.col("pieces.n_ids").alias("n_ids"), F.crc32("pieces.ids").alias("ids_crc32"),
                        F.col("pieces.round_trip").alias("round_trip"), drawn.alias("samples"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return token_files(docs, tokenizer_file("word_bpe_49k.json"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses(read(spark, sf_dir, "documents").select("doc_id", "text"))
    places = F.col("licenses.places")
    base = F.filter(places, lambda p: p["base"])

    def names(of):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda p: p["label"]))), ",")

    return found.select(
        "doc_id", F.col("licenses.n_words").alias("n_words"), F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda p: p["start"])).alias("first_word"),
        F.array_max(F.transform(base, lambda p: p["start"])).alias("last_word"),
        names(base).alias("base_labels"), names(places).alias("labels"),
        F.coalesce(F.array_max(F.transform(places, lambda p: p["score"])), F.lit(0.0)).alias("score"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_inertia(cluster(read(spark, sf_dir, "embeddings")))
    return found.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_codebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compress(read(spark, sf_dir, "embeddings"))
    return with_group_sum(found.rows, "label", "error", "label_error") \
        .select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(found.sha256()).alias("codebooks_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_pii, op2_nearest, op3_toxicity, op4_language_id, op5_quality_rules, op6_source_mix, op7_secrets, op8_pieces, op9_token_files, op10_jaccard_join,
                             op11_licenses, op12_centroids, op13_codebooks)
}
