"""Queries for text functions (C), projection / filter (P1, P2), dedupe (W1),
class counts (A1-A3), the split (W2, U4) and the first rows (T3)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mixtext.functions import text as T
from mixtext.operators import observe as OB
from mixtext.operators import prep
from mixtext.plans import documents as D
from mixtext.plans import oracle as O
from mixtext.plans.catalog import ORACLE, register
from mixtext.session import materialize, read_table


def _pages_text(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages")
    return pages.select("page_id", F.concat_ws(" ", "url", "html").alias("raw"))


_PAGES = "pages_raw AS (SELECT page_id, concat_ws(' ', url, html) AS raw FROM pages)"


def _c_query(key: str, spark_fn, sql_fn):
    @register(key, O.with_(_PAGES, f"SELECT page_id, {sql_fn('raw')} AS value FROM pages_raw"))
    def _q(spark, sf_dir):
        return _pages_text(spark, sf_dir).select("page_id", spark_fn(F.col("raw")).alias("value"))

    return _q


_c_query("c0_null_to_empty", T.null_to_empty, O.null_to_empty)
_c_query("c2_strip_urls", T.strip_urls, O.strip_urls)
_c_query("c3_strip_mentions", T.strip_mentions, O.strip_mentions)
_c_query("c4_strip_hash", T.strip_hash, O.strip_hash)
_c_query("c5_lower_ascii", T.lower_ascii, O.lower_ascii)
_c_query("c6_collapse_spaces", T.collapse_spaces, O.collapse)
_c_query("c7_strip_spaces", lambda c: T.strip_spaces(T.collapse_spaces(c)), lambda e: O.strip_spaces(O.collapse(e)))
_c_query("c8_py_strip", T.py_strip, O.py_strip)
_c_query("c_clean_text", T.clean_text, O.clean)


@register("c1_nfkc", O.with_(_PAGES, "SELECT page_id, raw AS value FROM pages_raw"))
def c1_nfkc(spark, sf_dir):
    """NFKC through the Arrow UDF over whole page texts (the given texts are their own
    NFKC form; crafted texts that are not are in the tests)."""
    return _pages_text(spark, sf_dir).select("page_id", T.nfkc(F.col("raw")).alias("value"))


@register(
    "c9_tokenize",
    O.with_(
        O.PREPARED,
        f"""SELECT row_id, CAST(len(tk) AS BIGINT) AS n_tokens, md5(array_to_string(tk, '|')) AS tokens_md5
        FROM (SELECT row_id, {O.tokens('text')} AS tk FROM w1)""",
    ),
)
def c9_tokenize(spark, sf_dir):
    tk = T.tokens(F.col("text"))
    return D.prepared(spark, sf_dir).select(
        "row_id", F.size(tk).cast("long").alias("n_tokens"), F.md5(F.array_join(tk, "|")).alias("tokens_md5")
    )


@register(
    "c10_ngrams",
    O.with_(
        O.PREPARED,
        f"""SELECT row_id, CAST(len(ng) AS BIGINT) AS n_terms, md5(array_to_string(ng, '|')) AS terms_md5
        FROM (SELECT row_id, list_concat(tk, list_transform(range(1, len(tk)), lambda i: tk[i] || ' ' || tk[i + 1])) AS ng
              FROM (SELECT row_id, {O.tokens('text')} AS tk FROM w1))""",
    ),
)
def c10_ngrams(spark, sf_dir):
    toks = D.prepared(spark, sf_dir).select("row_id", T.tokens(F.col("text")).alias("_tok"))
    ng = F.concat(F.col("_tok"), T.bigrams(F.col("_tok")))
    return toks.select(
        "row_id", F.size(ng).cast("long").alias("n_terms"), F.md5(F.array_join(ng, "|")).alias("terms_md5")
    )


@register("p1_project", O.with_(O.P1, "SELECT row_id, original_text, text, label FROM p1"))
def p1_project(spark, sf_dir):
    return D.projected(spark, sf_dir)


@register("p2_nonempty", O.with_(O.P1 + ",\n" + O.P2, "SELECT row_id, original_text, text, label FROM p2"))
def p2_nonempty(spark, sf_dir):
    return D.filtered(spark, sf_dir)


@register("w1_keep_first_dedupe", O.with_(O.PREPARED, "SELECT row_id, original_text, text, label FROM w1"))
def w1_keep_first_dedupe(spark, sf_dir):
    return D.prepared(spark, sf_dir)


@register(
    "a1_label_distribution",
    O.with_(O.PREPARED, "SELECT label, count(*) AS count FROM w1 GROUP BY label ORDER BY label"),
)
def a1_label_distribution(spark, sf_dir):
    return prep.label_distribution(D.prepared(spark, sf_dir))


@register(
    "a2_min_class",
    O.with_(
        O.PREPARED,
        """SELECT min(n) AS min_class_count, coalesce(min(n) >= 2, false) AS stratified
        FROM (SELECT label, count(*) AS n FROM w1 GROUP BY label)""",
    ),
)
def a2_min_class(spark, sf_dir):
    return prep.min_class(D.prepared(spark, sf_dir))


@register(
    "a3_row_counts",
    O.with_(
        O.SPLIT,
        """SELECT (SELECT count(*) FROM documents) AS raw_rows, count(*) AS processed_rows,
                  count(*) FILTER (WHERE split = 'train') AS train_rows,
                  count(*) FILTER (WHERE split = 'test') AS test_rows
        FROM split""",
    ),
)
def a3_row_counts(spark, sf_dir):
    return prep.row_counts(D.raw_documents(spark, sf_dir), D.split(spark, sf_dir))


@register("a3_counts_in_flight", ORACLE["a3_row_counts"])
def a3_counts_in_flight(spark, sf_dir):
    """A3 taken while the raw and the split table are written."""
    _, counts = OB.materialize_observed(D.raw_documents(spark, sf_dir), "raw", OB.raw_metrics())
    split, more = OB.materialize_observed(D.split(spark, sf_dir), "split", OB.split_metrics())
    return OB.counts_row(split, counts | more)


@register("w2_stratified_split", O.with_(O.SPLIT, "SELECT row_id, label, split FROM split"))
def w2_stratified_split(spark, sf_dir):
    return D.split(spark, sf_dir).select("row_id", "label", "split")


@register(
    "w2_class_quotas",
    O.with_(
        O.SPLIT,
        """SELECT label, count(*) AS class_rows, count(*) FILTER (WHERE split = 'test') AS test_quota,
                  count(*) FILTER (WHERE split = 'train') AS train_quota
        FROM split GROUP BY label""",
    ),
)
def w2_class_quotas(spark, sf_dir):
    counts = D.prepared(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return prep.class_quotas(counts, D.TEST_SIZE)


@register("u4_split_check", "SELECT 0::BIGINT AS overlap, 0::BIGINT AS missing, 0::BIGINT AS extra, 0::BIGINT AS repeated, true AS ok")
def u4_split_check(spark, sf_dir):
    return prep.split_check(D.prepared(spark, sf_dir), D.split(spark, sf_dir))


@register(
    "t3_first_rows",
    O.with_(O.PREPARED, "SELECT row_id, original_text, text, label FROM w1 ORDER BY row_id LIMIT 5"),
)
def t3_first_rows(spark, sf_dir):
    return D.prepared(spark, sf_dir).orderBy("row_id").limit(5)


@register(
    "w3_row_index",
    O.with_(O.PREPARED, "SELECT row_id, CAST(row_number() OVER (ORDER BY row_id) - 1 AS BIGINT) AS row_index FROM w1"),
)
def w3_row_index(spark, sf_dir):
    """Dense 0-based position of each prepared row (only on request; row_id is the carried
    identity). A range-partitioned sort keeps partitions in order; a row's index is its place in
    the partition plus the sizes of the partitions before: no window over data rows."""
    ordered = materialize(D.prepared_table(spark, sf_dir).select("row_id").orderBy("row_id").withColumn(
        "_at", F.monotonically_increasing_id()), "row_index")
    # position in the partition plus the rows of all partitions before it (one row per partition)
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    bases = ordered.groupBy(part.alias("_p")).agg(F.count("*").alias("n")).withColumn("_base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return ordered.withColumn("_p", part).join(F.broadcast(bases.select("_p", "_base")), "_p") \
        .select("row_id", (F.col("_base") + place).alias("row_index"))
