"""Split quotas (golden from the published class sizes), equality with the plain rank,
disjointness and coverage, independence of partitioning."""

import contextlib
import io

from pyspark.sql import functions as F

from mixtext.operators import prep
from mixtext.plans import documents as D

from conftest import SF01


def test_published_quotas(spark):
    sizes = {"Mixed_feelings": 1790, "Negative": 2031, "Positive": 10416, "not-Tamil": 492, "unknown_state": 846}
    counts = spark.createDataFrame(list(sizes.items()), "label string, n long")
    q = {r.label: r.test_quota for r in prep.class_quotas(counts, 0.2).collect()}
    assert q == {"Mixed_feelings": 358, "Negative": 406, "Positive": 2083, "not-Tamil": 99, "unknown_state": 169}
    assert sum(q.values()) == 3115


def test_two_phase_equals_plain_rank(spark):
    p = D.prepared(spark, SF01).cache()
    a = prep.stratified_split(p).select("row_id", "split")
    b = prep.stratified_split_plain(p).select("row_id", "split")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    chk = prep.split_check(p, prep.stratified_split(p)).first()
    assert chk.ok
    c = prep.stratified_split(p.repartition(3)).select("row_id", "split")
    assert c.exceptAll(a).count() == 0


def test_unstratified_fallback(spark):
    rows = [(i, f"t{i}", "big") for i in range(20)] + [(99, "solo", "one")]
    df = spark.createDataFrame(rows, "row_id long, text string, label string")
    out = prep.stratified_split(df, test_size=0.25)
    assert out.where("split = 'test'").count() == 6  # ceil(0.25 * 21), one stratum


def test_dedupe_keeps_first(spark):
    df = spark.createDataFrame([(3, "o3", "x", "a"), (1, "o1", "x", "a"), (2, "o2", "x", "b")],
                               "row_id long, original_text string, text string, label string")
    out = {(r.text, r.label): (r.row_id, r.original_text) for r in prep.dedupe_keep_first(df).collect()}
    assert out == {("x", "a"): (1, "o1"), ("x", "b"): (2, "o2")}


def test_hot_key_dedupe_and_hot_class_split(spark):
    n = 30_000
    df = spark.range(n).select(
        F.col("id").alias("row_id"),
        F.when(F.col("id") % 3 == 0, F.lit("same text")).otherwise(F.concat(F.lit("t"), F.col("id").cast("string")))
        .alias("text"),
        F.when(F.col("id") % 3 == 0, F.lit("orig")).otherwise(F.lit("o")).alias("original_text"),
        F.when(F.col("id") % 10 < 7, F.lit("hot")).otherwise(F.lit("cold")).alias("label"),
    ).repartition(16)
    dd = prep.dedupe_keep_first(df)
    same = dd.where("text = 'same text'").orderBy("label").collect()
    assert [(r.label, r.row_id) for r in same] == [("cold", 9), ("hot", 0)]
    assert dd.count() == n - n // 3 + 2
    sp = prep.stratified_split(df)
    got = {r.label: r["count"] for r in sp.where("split = 'test'").groupBy("label").count().collect()}
    counts = df.groupBy("label").count()
    want = {r.label: r.test_quota for r in prep.class_quotas(counts.withColumnRenamed("count", "n"), 0.2).collect()}
    assert got == want
    plain = prep.stratified_split_plain(df).select("row_id", "split")
    assert sp.select("row_id", "split").exceptAll(plain).count() == 0


def test_split_joins_one_row_per_class_only(spark):
    """No row is looked up by its id: the wide table meets its class's cut-off, nothing else."""
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        prep.stratified_split(D.prepared_table(spark, SF01)).explain("formatted")
    keys = [line for line in buf.getvalue().splitlines() if "keys" in line.lower() and "row_id" in line]
    assert not keys


def test_prepare_drops_empty_groups_like_a_filter(spark):
    rows = [(1, "  ", "a"), (2, "x", " "), (3, "x", "a"), (4, "X", "a"), (5, None, "b"), (6, "@m", "b"),
            (7, "y", None), (0, "y", "b")]
    raw = spark.createDataFrame(rows, "row_id long, t string, l string")
    fused = prep.prepare(raw, "t", "l")
    staged = prep.dedupe_keep_first(prep.keep_nonempty(prep.project_clean(raw, "t", "l")))
    got = sorted(tuple(r) for r in fused.collect())
    assert got == sorted(tuple(r) for r in staged.select(*fused.columns).collect())
    assert [(r[0], r[2], r[3]) for r in got] == [(0, "y", "b"), (3, "x", "a")]
