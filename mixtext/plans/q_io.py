"""Queries for sources / sinks (S1-S14), profiling (R1-R6), media gates
and streaming (ST1-ST3)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from mixtext.functions import text as T
from mixtext.operators import errors as ER
from mixtext.operators import models as M
from mixtext.operators import prep
from mixtext.operators import profile as PR
from mixtext.operators.scoring import FUNCTION_WORDS, function_word_scorer
from mixtext.plans import documents as D
from mixtext.plans import oracle as O
from mixtext.plans.catalog import ORACLE, register
from mixtext.plans.documents import r6
from mixtext.plans.q_errors import ERR
from mixtext.session import read_table, scratch_path, stored_bytes
from mixtext.sources import delimited as DL
from mixtext.sources import files as FI
from mixtext.sources import reports as RP
from mixtext.streaming.scoring import start_scoring_stream


CSV_PART_BYTES = 32 << 20  # stored bytes of documents in one delimited file, where 4 files would hold more


def _documents_csv(spark, sf_dir, sep=";", header_names=None, parts=4):
    """documents written as delimited text by Spark (the stand-in for the raw input file), in
    ``parts`` files or as many more as keep a file near CSV_PART_BYTES."""
    docs = read_table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string"), "lang", "text"
    )
    if header_names:
        docs = docs.toDF(*header_names)
    parts = max(parts, -(-stored_bytes(docs) // CSV_PART_BYTES))
    path = scratch_path(spark, "csv")
    (docs.repartition(parts).write.option("sep", sep).option("header", bool(header_names)).option("escape", '"')
     .option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(path))
    return path


@register(
    "s1_delimited_scan",
    "SELECT CAST(doc_id AS VARCHAR) AS _c0, lang AS _c1, text AS _c2 FROM documents",
)
def s1_delimited_scan(spark, sf_dir):
    """Separator probing (sniffed, tab, comma, semicolon, pipe; widest wins), one scan."""
    path = _documents_csv(spark, sf_dir, sep=";")
    return DL.read_delimited(spark, path, header=False).drop("_order")


@register("s2_input_discovery")
def s2_input_discovery(spark, sf_dir):
    path = _documents_csv(spark, sf_dir, sep="|")
    files = DL.list_inputs(spark, path, "*.csv")
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path).select(
        "path", "length").where(F.col("path").isin(files))


@register(
    "s3_header_roles",
    O.with_(O.PREPARED, "SELECT label, count(*) AS count FROM w1 GROUP BY label"),
)
def s3_header_roles(spark, sf_dir):
    """Header mode with recognised role names (comment / category): label distribution of
    the prepared rows read back from the delimited file."""
    path = _documents_csv(spark, sf_dir, sep=",", header_names=["id", "category", "comment"])
    raw, text_col, label_col = DL.load_dataset(spark, path)
    return prep.label_distribution(prep.prepare(raw, text_col, label_col))


@register("s4_prune_null_columns", "SELECT doc_id, lang, source FROM documents")
def s4_prune_null_columns(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select(
        "doc_id", "lang", "source", F.lit(None).cast("string").alias("empty_column"))
    return DL.prune_null_columns(docs)


def _write_split(spark, sf_dir):
    path = scratch_path(spark, "processed")
    RP.write_split(D.split(spark, sf_dir), path)
    return path


@register("s5_write_split", O.with_(O.SPLIT, "SELECT split, count(*) AS count FROM split GROUP BY split"))
def s5_write_split(spark, sf_dir):
    path = _write_split(spark, sf_dir)
    return spark.read.parquet(path).groupBy("split").count()


@register("s6_dataset_metadata", O.with_(O.SPLIT, """SELECT (SELECT count(*) FROM documents) AS raw_rows, count(*) AS processed_rows,
    'text' AS text_column, 'lang' AS label_column, (SELECT string_agg(label || '=' || n, ',' ORDER BY label) FROM
    (SELECT label, count(*) AS n FROM split GROUP BY label)) AS label_distribution, 0.2::DOUBLE AS test_size, 42::INT AS random_state,
    true AS stratified_split, count(*) FILTER (WHERE split = 'train') AS train_rows, count(*) FILTER (WHERE split = 'test') AS test_rows,
    5::INT AS cleaning_steps FROM split"""))
def s6_dataset_metadata(spark, sf_dir):
    raw = D.raw_documents(spark, sf_dir)
    meta = RP.dataset_metadata(raw, D.split(spark, sf_dir), f"{sf_dir}/documents.parquet", "text", "lang",
                               D.TEST_SIZE, D.SEED, True)
    labels = F.transform(F.map_entries("label_distribution"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return meta.select("raw_rows", "processed_rows", "text_column", "label_column", F.array_join(F.array_sort(labels), ",").alias("label_distribution"),
                       "test_size", "random_state", "stratified_split", "train_rows", "test_rows", F.size("cleaning").alias("cleaning_steps"))


@register(
    "s7_load_split",
    O.with_(O.SPLIT, "SELECT row_id, label FROM split WHERE split = 'train'"),
)
def s7_load_split(spark, sf_dir):
    return RP.load_split(spark, _write_split(spark, sf_dir), "train").select("row_id", "label")


@register("s8_s9_json_report")
def s8_s9_json_report(spark, sf_dir):
    """S9 then S8: the comparison report written as JSON and read back with its schema."""
    mods = [function_word_scorer()]
    comp = M.comparison(M.candidates(*[M.evaluate(D.predictions(spark, sf_dir, m), m) for m in mods]))
    path = scratch_path(spark, "reports")
    RP.write_json_report(comp, path)
    return RP.read_json_report(spark, path, comp.schema)


@register(
    "s10_error_csv",
    O.with_(ERR, "SELECT row_index, original_text, true_label, predicted_label, round(confidence, 6) AS confidence FROM hard"),
)
def s10_error_csv(spark, sf_dir):
    model = function_word_scorer()
    hardest = ER.hardest(ER.error_rows(D.predictions(spark, sf_dir, model), model), 20)
    path = scratch_path(spark, "errors_csv")
    RP.write_error_csv(hardest, path)
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return back.select(F.col("row_index").cast("long"), "original_text", "true_label", "predicted_label",
                       r6(F.col("confidence").cast("double")).alias("confidence"))


@register("s13_file_inventory")
def s13_file_inventory(spark, sf_dir):
    return FI.inventory(spark, sf_dir, "*.parquet")


@register("s14_media_manifest")
def s14_media_manifest(spark, sf_dir):
    """Every given table file checked against the audio gate (all rejected: '.parquet')."""
    return FI.media_manifest(FI.inventory(spark, sf_dir))


@register(
    "r1_normalize_name",
    f"""SELECT page_id, regexp_replace(regexp_replace(lower({O.py_strip('url')}), '[^a-z0-9]+', '_', 'g'),
                                       '^_+|_+$', '', 'g') AS name FROM pages""",
)
def r1_normalize_name(spark, sf_dir):
    return read_table(spark, sf_dir, "pages").select("page_id", T.normalize_name(F.col("url")).alias("name"))


@register("r2_r3_resolve_roles", """SELECT 'text' AS text_column, 'Label ' AS label_column, 'lang' AS by_position,
    count(*) AS rows FROM documents""")
def r2_r3_resolve_roles(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    t, lab = PR.named_roles(docs.withColumnRenamed("lang", "Label "))
    return docs.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(t).alias("text_column"), F.lit(lab).alias("label_column"),
        F.lit(PR.resolve_column(docs, "2")).alias("by_position"), "rows")


_R4_COLS = ["doc_id", "text", "lang", "source", "n_chars"]


def _r4_sql():
    known = ", ".join(O.q(v) for v in PR.KNOWN_LABEL_VALUES)
    parts = []
    for i, c in enumerate(_R4_COLS):
        v = O.py_strip(O.null_to_empty(c))
        parts.append(
            f"""SELECT '{c}' AS column_name, {i} AS position,
                  count(*) FILTER (WHERE lower({v}) IN ({known})) AS known_hits,
                  round(count(DISTINCT {v}) / greatest(count(*), 1), 6) AS unique_ratio,
                  round(coalesce(avg(length({v})), 0.0), 6) AS mean_length FROM documents"""
        )
    return "\nUNION ALL ".join(parts)


@register("r4_label_likeness", _r4_sql())
def r4_label_likeness(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select(*_R4_COLS)
    p = PR.label_likeness(docs)
    return p.select("column_name", "position", "known_hits", r6(F.col("unique_ratio")).alias("unique_ratio"),
                    r6(F.col("mean_length")).alias("mean_length"))


@register(
    "r5_role_inference",
    f"""WITH prof AS ({_r4_sql()}),
    lab AS (SELECT column_name FROM prof ORDER BY known_hits DESC, unique_ratio, mean_length, position LIMIT 1),
    txt AS (SELECT column_name FROM prof WHERE column_name NOT IN (SELECT column_name FROM lab)
            ORDER BY mean_length DESC, unique_ratio DESC, known_hits, position LIMIT 1)
    SELECT (SELECT column_name FROM txt) AS text_column, (SELECT column_name FROM lab) AS label_column""",
)
def r5_role_inference(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select(*_R4_COLS)
    return PR.infer_roles(PR.label_likeness(docs))


@register("r5_roles_by_sketch", ORACLE["r5_role_inference"])
def r5_roles_by_sketch(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select(*_R4_COLS)
    return PR.infer_roles(PR.sketched_likeness(docs))


@register("r6_inspect", O.with_(O.PREPARED, "SELECT row_id, original_text, text, label FROM w1 ORDER BY row_id LIMIT 5"))
def r6_inspect(spark, sf_dir):
    return PR.inspect(D.prepared(spark, sf_dir))


@register(
    "p8_language_hint",
    f"""SELECT doc_id, CASE WHEN lang IS NULL OR lower({O.py_strip('lang')}) IN ('', 'auto', 'detect') THEN NULL
                            ELSE lower({O.py_strip('lang')}) END AS hint,
               lang IS NULL OR lower({O.py_strip('lang')}) IN ('', 'auto', 'detect', 'ta', 'en') AS is_valid
        FROM documents""",
)
def p8_language_hint(spark, sf_dir):
    hint, valid = T.language_hint(F.col("lang"))
    return read_table(spark, sf_dir, "documents").select("doc_id", hint.alias("hint"), valid.alias("is_valid"))


@register(
    "p9_nonempty_payload",
    f"""WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN '' WHEN turn % 4 = 2 THEN '  ' ELSE text END AS text FROM conversations)
    SELECT conv_id, turn, {O.py_strip("text")} <> '' AS has_words FROM t WHERE length(text) >= 1""",
)
def p9_nonempty_payload(spark, sf_dir):
    """The request gate (at least one character) and the trimmed gate of spoken output, over
    conversations of which some turns are derived to be empty or blank."""
    text = F.when(F.col("turn") % 4 == 3, "").when(F.col("turn") % 4 == 2, "  ").otherwise(F.col("text"))
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("text"))
    return turns.where(F.length("text") >= 1).select("conv_id", "turn", (T.py_strip("text") != "").alias("has_words"))


@register(
    "c11_file_suffix",
    """SELECT page_id, CASE WHEN s = '' THEN '(none)' ELSE s END AS extension FROM (
         SELECT page_id, lower(regexp_extract(regexp_extract(url, '([^/]*)$', 1), '^.+(\\.[^.]+)$', 1)) AS s FROM pages)""",
)
def c11_file_suffix(spark, sf_dir):
    return read_table(spark, sf_dir, "pages").select("page_id", T.file_suffix(F.col("url")).alias("extension"))


@register("c12_mtime_format", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts_text FROM events")
def c12_mtime_format(spark, sf_dir):
    return read_table(spark, sf_dir, "events").select("event_id", T.format_mtime(F.col("ts")).alias("ts_text"))


CONV_SCHEMA = StructType([
    StructField("row_id", LongType()), StructField("conv_id", LongType()), StructField("turn", LongType()),
    StructField("text", StringType()),
])


def stream_rows(spark, sf_dir):
    """The conversations as stream input; every fourth turn is derived to be empty, so that the
    payload gate has something to reject."""
    text = F.when(F.col("turn") % 4 == 3, "").otherwise(F.col("text"))
    return read_table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1_000_000 + F.col("turn")).alias("row_id"), "conv_id", "turn", text.alias("text"))


def _conversation_stream(spark, sf_dir):
    src = scratch_path(spark, "stream_in")
    stream_rows(spark, sf_dir).repartition(4).write.parquet(src)  # several files -> several micro-batch inputs
    out = scratch_path(spark, "stream_out")
    q = start_scoring_stream(spark, src, CONV_SCHEMA, function_word_scorer(), out, scratch_path(spark, "stream_ckpt"))
    q.awaitTermination()
    return out


_STREAM = """turns AS (SELECT conv_id * 1000000 + turn AS row_id, CASE WHEN turn % 4 = 3 THEN '' ELSE text END AS text FROM conversations),
conv AS (SELECT row_id, text AS original_text, text, '' AS label FROM turns WHERE length(text) >= 1),
""" + O.scorer_ctes(FUNCTION_WORDS, source="conv", where="true") + """,
banded AS (SELECT row_id, predicted_label, round(confidence, 6) AS confidence, cleaned_text, 'baseline' AS model,
    'function_words' AS model_name, CASE WHEN confidence >= 0.70 THEN 'high' WHEN confidence >= 0.55 THEN 'medium' ELSE 'low' END AS band FROM pred),
tops AS (SELECT row_id, string_agg(cls, '|' ORDER BY p DESC, idx) AS top_labels FROM (SELECT *, row_number() OVER
    (PARTITION BY row_id ORDER BY p DESC, idx) AS rk FROM prob) WHERE rk <= 3 GROUP BY row_id)"""


def _records(df):
    return df.select("row_id", "predicted_label", r6(F.col("confidence")).alias("confidence"), "band", "cleaned_text", "model",
                     "model_name", F.array_join("top_probabilities.label", "|").alias("top_labels"))


@register("st1_streaming_scoring", O.with_(_STREAM, "SELECT banded.*, top_labels FROM banded JOIN tops USING (row_id)"))
def st1_streaming_scoring(spark, sf_dir):
    return _records(spark.read.parquet(f"{_conversation_stream(spark, sf_dir)}/predictions"))


@register("st2_review_sink", O.with_(_STREAM, "SELECT banded.*, top_labels FROM banded JOIN tops USING (row_id) WHERE band = 'low'"))
def st2_review_sink(spark, sf_dir):
    return _records(spark.read.parquet(f"{_conversation_stream(spark, sf_dir)}/review"))


@register("st3_reject_sink", O.with_(_STREAM, "SELECT row_id FROM turns WHERE text IS NULL OR length(text) < 1"))
def st3_reject_sink(spark, sf_dir):
    return spark.read.parquet(f"{_conversation_stream(spark, sf_dir)}/rejects").select("row_id")
