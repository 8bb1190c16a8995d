"""Preparation: projection, filter, keep-first dedupe, class counts and the exact
stratified split (P1, P2, W1, A1-A3, W2, U4).

Row identity is an explicit ``row_id`` column (the reference relies on position).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mixtext.functions import text as T

# hex digits of the md5 used as the split histogram bucket: 20 bits, 1,048,576 buckets
# per class. The boundary bucket, the only one that is ranked, then holds about n_c / 2^20
# rows (about 100k rows per class at 10^11 rows).
SPLIT_BUCKET_HEX = 5


def project_clean(raw: DataFrame, text_col: str, label_col: str, row_id: str = "row_id",
                  normalize: bool = True) -> DataFrame:
    """(row_id, stripped original text, cleaned text, stripped label)."""
    return raw.select(
        F.col(row_id).alias("row_id"),
        T.py_strip(T.null_to_empty(text_col)).alias("original_text"),
        T.clean_text(text_col, normalize=normalize).alias("text"),
        T.py_strip(T.null_to_empty(label_col)).alias("label"),
    )


def nonempty() -> Column:
    """P2's condition: non-empty cleaned text and label."""
    return (F.col("text") != "") & (F.col("label") != "")


def keep_nonempty(df: DataFrame) -> DataFrame:
    """Non-empty cleaned text and label."""
    return df.where(nonempty())


def dedupe_keep_first(df: DataFrame, keys=("text", "label"), only: Column | None = None) -> DataFrame:
    """One row per key, the one with the smallest row_id (its original text survives).

    A plain aggregation, so Spark combines duplicates map-side before the shuffle:
    a key holding a third of all rows reaches its reducer as one row per map task.
    ``only`` (a condition on the keys) keeps just the groups that satisfy it. It is
    evaluated inside the aggregate on the columns as they arrive: as a Filter below a
    projection the optimizer would substitute the projected expressions into it and
    evaluate them twice (for P2 that is the whole cleaning chain).
    """
    keys = list(keys)
    others = [c for c in df.columns if c not in keys and c != "row_id"]
    row = F.struct(F.col("row_id"), *[F.col(c) for c in others])
    first = F.min(row if only is None else F.when(only, row)).alias("_first")
    out = df.groupBy(*keys).agg(first)
    if only is not None:
        out = out.where(F.col("_first").isNotNull())
    return out.select(
        F.col("_first.row_id").alias("row_id"), *[F.col(f"_first.{c}").alias(c) for c in others], *keys
    )


def prepare(raw: DataFrame, text_col: str, label_col: str, row_id: str = "row_id",
            normalize: bool = True) -> DataFrame:
    """P1 -> P2 -> W1: (row_id, original_text, text, label); P2 is applied per group in W1."""
    out = dedupe_keep_first(project_clean(raw, text_col, label_col, row_id, normalize), only=nonempty())
    return out.select("row_id", "original_text", "text", "label")


def label_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """A1: (label, count) sorted by label."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("count")).orderBy(label)


def label_distribution_map(df: DataFrame, label: str = "label") -> DataFrame:
    """A1 in its map form (one row)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(label), F.col("n"))))).alias("label_distribution")
    )


def min_class(df: DataFrame, label: str = "label") -> DataFrame:
    """A2: smallest class size and whether the split can be stratified (>= 2)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.min("n").alias("min_class_count")).select(
        "min_class_count", F.coalesce(F.col("min_class_count") >= 2, F.lit(False)).alias("stratified")
    )


def _split_hash(seed: int, row_id: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), row_id.cast("string")))


def class_quotas(counts: DataFrame, test_size: float, label: str = "label") -> DataFrame:
    """Exact per-class test quotas for a k-row (label, n) table.

    n_test = ceil(test_size * n); train seats per class = floor(n_c * n_train / n), the
    remaining seats go to the largest remainders (ties by label); test = n_c - train.
    """
    every = Window.partitionBy()  # k rows (classes), not data rows
    n = F.sum("n").over(every)
    n_test = F.ceil(F.lit(float(test_size)) * n)
    q = counts.select(label, "n", n.alias("_total"), n_test.alias("_n_test"))
    q = q.withColumn("_n_train", F.col("_total") - F.col("_n_test"))
    prod = F.col("n").cast("decimal(38,0)") * F.col("_n_train").cast("decimal(38,0)")
    q = q.withColumn("_base", F.floor(prod / F.col("_total")).cast("long")).withColumn(
        "_rem", (prod % F.col("_total")).cast("decimal(38,0)")
    )
    q = q.withColumn("_left", F.col("_n_train") - F.sum("_base").over(every))
    q = q.withColumn("_seat", F.row_number().over(Window.orderBy(F.col("_rem").desc(), F.col(label))))
    q = q.withColumn("train_quota", F.col("_base") + F.when(F.col("_seat") <= F.col("_left"), 1).otherwise(0))
    return q.select(label, F.col("n").alias("class_rows"), (F.col("n") - F.col("train_quota")).alias("test_quota"),
                    "train_quota")


def stratified_split(df: DataFrame, test_size: float = 0.2, seed: int = 42, label: str = "label",
                     stratify: bool | None = None) -> DataFrame:
    """Adds ``split`` ('train' / 'test') with exact per-class quotas, seeded.

    Membership inside a class = order of (md5(seed|row_id), row_id): a row is a test row if it
    does not come after its class's last test row. That cut-off, one (hash, row_id) per class,
    is found without ranking a class: a (class, 20-bit hash bucket) histogram gives the bucket
    in which the quota ends, and only that bucket (about 1/2^20 of a class) is ranked, on
    narrow columns. The wide table is then read once and compared map-only with its class's
    cut-off, so pass a materialized table, not a long lineage. When the smallest class has
    fewer than 2 rows the split falls back to one unstratified stratum, as the reference does.
    """
    narrow = df.select("row_id", label).withColumn("_h", _split_hash(seed, F.col("row_id"))).withColumn(
        "_b", F.conv(F.substring("_h", 1, SPLIT_BUCKET_HEX), 16, 10).cast("int"))
    by_class = narrow.groupBy(F.col(label), "_b").agg(F.count(F.lit(1)).alias("_cnt"))
    if stratify is None:
        smallest = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n")).first()[0]  # one number
        stratify = smallest is not None and smallest >= 2
    strata = F.col(label) if stratify else F.lit("")
    hist = by_class.groupBy(strata.alias("_s"), "_b").agg(F.sum("_cnt").alias("_cnt"))
    quotas = class_quotas(hist.groupBy("_s").agg(F.sum("_cnt").alias("n")), test_size, label="_s")
    run = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = hist.withColumn("_incl", F.sum("_cnt").over(run)).withColumn("_before", F.col("_incl") - F.col("_cnt"))
    boundary = cum.join(quotas.select("_s", "test_quota"), "_s").where(
        (F.col("_before") < F.col("test_quota")) & (F.col("_incl") >= F.col("test_quota"))
    ).select("_s", F.col("_b").alias("_bstar"), (F.col("test_quota") - F.col("_before")).alias("_need"))
    # one row per class on the right side of both joins: broadcast, so that no class's rows are
    # dealt by label (Spark itself would not, with far more shuffle partitions than classes)
    edge = narrow.withColumn("_s", strata).join(F.broadcast(boundary), "_s").where(F.col("_b") == F.col("_bstar"))
    rank = F.row_number().over(Window.partitionBy("_s").orderBy("_h", "row_id"))
    cuts = edge.withColumn("_rank", rank).where(F.col("_rank") == F.col("_need")).select(
        F.col("_s").alias("_cs"), F.struct(F.col("_h"), F.col("row_id")).alias("_cut"))
    place = F.struct(_split_hash(seed, F.col("row_id")).alias("_h"), F.col("row_id"))
    out = df.join(F.broadcast(cuts), strata == F.col("_cs"), "left")
    # a class without a cut-off has no test rows
    return out.select(*[df[c] for c in df.columns], F.when(place <= F.col("_cut"), "test").otherwise("train").alias("split"))


def stratified_split_plain(df: DataFrame, test_size: float = 0.2, seed: int = 42,
                           label: str = "label") -> DataFrame:
    """W2 reference form: full rank per class (one task per class; oracle / tests only)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    quotas = class_quotas(counts, test_size, label=label)
    rank = F.row_number().over(Window.partitionBy(label).orderBy(_split_hash(seed, F.col("row_id")), "row_id"))
    return df.join(F.broadcast(quotas.select(label, "test_quota")), label).withColumn(
        "split", F.when(rank <= F.col("test_quota"), "test").otherwise("train")
    ).drop("test_quota")


def row_counts(raw: DataFrame, split: DataFrame) -> DataFrame:
    """A3: raw / processed / train / test row counts, one pass over each input."""
    tags = raw.select(F.lit("raw").alias("_t")).unionByName(split.select(F.col("split").alias("_t")))
    return tags.agg(
        F.count_if(F.col("_t") == "raw").alias("raw_rows"),
        F.count_if(F.col("_t") != "raw").alias("processed_rows"),
        F.count_if(F.col("_t") == "train").alias("train_rows"),
        F.count_if(F.col("_t") == "test").alias("test_rows"),
    )


def split_check(prepared: DataFrame, split: DataFrame) -> DataFrame:
    """U4: train and test are disjoint, hold no row twice and together cover the input.

    One shuffle on row_id over the tagged union; no self-join.
    """
    tagged = prepared.select("row_id", F.lit("base").alias("_t")).unionByName(
        split.select("row_id", F.col("split").alias("_t"))
    )
    per_row = tagged.groupBy("row_id").agg(
        F.count_if(F.col("_t") == "base").alias("b"),
        F.count_if(F.col("_t") == "train").alias("tr"),
        F.count_if(F.col("_t") == "test").alias("te"),
    )
    out = per_row.agg(
        F.count_if((F.col("tr") > 0) & (F.col("te") > 0)).alias("overlap"),
        F.count_if((F.col("b") > 0) & (F.col("tr") + F.col("te") == 0)).alias("missing"),
        F.count_if((F.col("b") == 0) & (F.col("tr") + F.col("te") > 0)).alias("extra"),
        F.count_if(F.col("tr") + F.col("te") > 1).alias("repeated"),
    )
    return out.withColumn(
        "ok", (F.col("overlap") == 0) & (F.col("missing") == 0) & (F.col("extra") == 0) & (F.col("repeated") == 0)
    )
