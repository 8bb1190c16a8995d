"""Queries for features: term counts, IDF, TF-IDF, class weights, L2 normalisation
(A4-A6, J2, J3, X4) and M1's fitted feature stages checked against the same SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from mixtext.functions import scoring as S
from mixtext.operators import dictionary as DI
from mixtext.operators import features as FE
from mixtext.operators import models as M
from mixtext.plans import documents as D
from mixtext.plans import oracle as O
from mixtext.plans.catalog import register
from mixtext.plans.documents import r6
from mixtext.session import materialize, read_table, scratch_path

TRAIN = O.SPLIT + f""",
tr AS (SELECT row_id, text, label FROM split WHERE split = 'train'),
tk AS (SELECT row_id, {O.tokens('text')} AS tk FROM tr),
ng AS (SELECT row_id, unnest(list_concat(tk, list_transform(range(1, len(tk)), lambda i: tk[i] || ' ' || tk[i + 1])))
         AS term FROM tk),
tf AS (SELECT row_id, term, count(*) AS tf FROM ng GROUP BY 1, 2),
dfq AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
idf AS (SELECT term, df, ln((1 + (SELECT count(*) FROM tr)) / (1 + df)) + 1 AS idf FROM dfq),
tw AS (SELECT tf.row_id, tf.term, tf.tf * idf.idf AS w FROM tf JOIN idf USING (term)),
nrm AS (SELECT row_id, sqrt(sum(w * w)) AS n FROM tw GROUP BY row_id),
tfidf AS (SELECT row_id, term, CASE WHEN n > 0 THEN w / n ELSE 0.0 END AS weight FROM tw JOIN nrm USING (row_id)),
cw AS (SELECT label, count(*) AS n_c FROM tr GROUP BY label),
cwt AS (SELECT label, n_c, sum(n_c) OVER () / (count(*) OVER () * n_c) AS weight FROM cw)"""


def _train_tf(spark, sf_dir):
    train = D.train_rows(spark, sf_dir)
    return train, FE.term_counts(train)


@register("a4_term_counts", O.with_(TRAIN, "SELECT row_id, term, tf FROM tf"))
def a4_term_counts(spark, sf_dir):
    return _train_tf(spark, sf_dir)[1]


@register("a5_smoothed_idf", O.with_(TRAIN, "SELECT term, df, round(idf, 6) AS idf FROM idf"))
def a5_smoothed_idf(spark, sf_dir):
    train, tf = _train_tf(spark, sf_dir)
    n_docs = train.count()  # one number
    idf = FE.smoothed_idf(tf, n_docs)
    return idf.select("term", "df", r6(F.col("idf")).alias("idf"))


@register("j3_tfidf_weights", O.with_(TRAIN, "SELECT row_id, term, round(weight, 6) AS weight FROM tfidf"))
def j3_tfidf_weights(spark, sf_dir):
    out = FE.tfidf_from_docs(D.train_rows(spark, sf_dir), table=materialize)
    return out.select("row_id", "term", r6(F.col("weight")).alias("weight"))


@register("a6_class_weights", O.with_(TRAIN, "SELECT label, n_c, round(weight, 6) AS weight FROM cwt"))
def a6_class_weights(spark, sf_dir):
    w = FE.class_weights(D.train_rows(spark, sf_dir))
    return w.select("label", "n_c", r6(F.col("weight")).alias("weight"))


@register(
    "j2_row_class_weight",
    O.with_(TRAIN, "SELECT tr.row_id, tr.label, round(cwt.weight, 6) AS weight FROM tr JOIN cwt USING (label)"),
)
def j2_row_class_weight(spark, sf_dir):
    train = D.train_rows(spark, sf_dir)
    out = FE.with_class_weight(train, FE.class_weights(train))
    return out.select("row_id", "label", r6(F.col("weight")).alias("weight"))


@register(
    "x4_l2_normalize",
    """WITH sc AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * (label + 2)) AS v FROM embeddings),
    nn AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM sc),
    ex AS (SELECT vec_id, unnest(range(len(v))) AS i, unnest(v) AS x, n FROM nn)
    SELECT vec_id, CAST(i AS INTEGER) AS i, round(CASE WHEN n > 0 THEN x / n ELSE 0.0 END, 6) AS value FROM ex""",
)
def x4_l2_normalize(spark, sf_dir):
    """Embeddings scaled by (label + 2), then L2-normalised back to unit length."""
    emb = read_table(spark, sf_dir, "embeddings")
    scaled = emb.select("vec_id", F.transform("embedding", lambda x: x.cast("double") * (F.col("label") + 2)).alias("v"))
    normed = scaled.select("vec_id", S.l2_normalize(F.col("v")).alias("u"))
    return normed.select("vec_id", F.posexplode_outer("u").alias("i", "value")).select(
        "vec_id", F.col("i").cast("int"), r6(F.col("value")).alias("value")
    )


@register(
    "m1_tfidf_pipeline_features",
    O.with_(TRAIN, """SELECT tr.row_id, count(t.term) AS n_terms, round(coalesce(sum(t.weight), 0.0), 6) AS sum_weight,
                             round(coalesce(max(t.weight), 0.0), 6) AS max_weight
                      FROM tr LEFT JOIN tfidf t USING (row_id) GROUP BY tr.row_id"""),
)
def m1_tfidf_pipeline_features(spark, sf_dir):
    """M1's feature stages (Spark ML tokenizer and 2-grams, counts over a distributed vocabulary,
    smoothed IDF, L2) fitted on the training split; each row's vector must equal the relational TF-IDF."""
    train = D.train_rows(spark, sf_dir).select("row_id", "text")  # all columns would come along
    vec = M.TfidfModel.fit_features(train).transform(train).select("row_id", F.unwrap_udt("features").alias("f"))
    vec = vec.select("row_id", F.filter("f.values", lambda x: x != 0).alias("v"))
    return vec.select("row_id", F.size("v").cast("long").alias("n_terms"), r6(F.aggregate("v", F.lit(0.0), lambda a, x: a + x)).alias("sum_weight"),
                      r6(F.coalesce(F.array_max("v"), F.lit(0.0))).alias("max_weight"))


# a term's place in the dictionary's order
PLACE = "substr(md5(term), 1, 3), term"
DICT = TRAIN + f""",
dict AS (SELECT term, row_number() OVER (ORDER BY {PLACE}) - 1 AS term_id, df FROM dfq)"""


def _train_dictionary(spark, sf_dir):
    train = D.train_rows(spark, sf_dir)
    tf = DI.keyed_counts(train)
    return train, tf, materialize(DI.build(tf), "dictionary")


@register("a5_term_dictionary", O.with_(DICT, "SELECT term, term_id, df FROM dict"))
def a5_term_dictionary(spark, sf_dir):
    return _train_dictionary(spark, sf_dir)[2].select("term", "term_id", "df")


@register(
    "a5_dictionary_versions",
    O.with_(O.SPLIT + f""",
tk AS (SELECT row_id, split, {O.tokens('text')} AS tk FROM split),
ng AS (SELECT row_id, split, unnest(list_concat(tk, list_transform(range(1, len(tk)), lambda i: tk[i] || ' ' || tk[i + 1])))
         AS term FROM tk),
dv AS (SELECT term, CASE WHEN bool_or(split = 'train') THEN 1 ELSE 2 END AS since, count(DISTINCT row_id) AS df FROM ng GROUP BY term)""",
            f"SELECT term, row_number() OVER (ORDER BY since, {PLACE}) - 1 AS term_id, df, since FROM dv"),
)
def a5_dictionary_versions(spark, sf_dir):
    """Version 1 holds the training rows' terms; version 2 counts the test rows in."""
    path = scratch_path(spark, "dictionary-versions")
    for rows in (D.train_rows(spark, sf_dir), D.test_rows(spark, sf_dir)):
        DI.save_next(path, DI.keyed_counts(rows))
    return DI.load(spark, path).select("term", "term_id", "df", "since")


@register("a4_encoded_term_counts", O.with_(DICT, "SELECT row_id, term_id, tf FROM tf JOIN dict USING (term)"))
def a4_encoded_term_counts(spark, sf_dir):
    _, tf, known = _train_dictionary(spark, sf_dir)
    return DI.encode(tf, known).select("row_id", "term_id", "tf")


@register("j3_tfidf_by_term_id", O.with_(DICT, "SELECT row_id, term_id, round(weight, 6) AS weight FROM tfidf JOIN dict USING (term)"))
def j3_tfidf_by_term_id(spark, sf_dir):
    out = DI.tfidf_from_docs(D.train_rows(spark, sf_dir))
    return out.select("row_id", "term_id", r6(F.col("weight")).alias("weight"))
