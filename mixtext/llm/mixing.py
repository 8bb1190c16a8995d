"""Mixing sources to target weights by hash-threshold histograms.

A document takes part once more than its source's whole copies when its hash lies below the
source's threshold. The threshold is found on sums of words by (source, hash bucket): the
first histogram finds the boundary bucket of each source, a second one over finer buckets
refines that bucket only. Documents are neither sorted nor ranked, and smaller budgets take
a subset of what larger ones take (nested thresholds).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mixtext.llm.common import words
from mixtext.session import materialize

MAX_COPIES = 3


def _buckets(id_col: str, text_col: str, source_col: str) -> list[Column]:
    """The two bucket numbers of a document: 16 bits each of a hash of its id, text and source,
    so that documents which share an id are still taken one by one."""
    parts = [F.coalesce(F.col(id_col).cast("string"), F.lit(""))] + [F.coalesce(F.md5(F.col(c)), F.lit("")) for c in (text_col, source_col)]
    digest = F.md5(F.concat_ws("|", *parts))

    def bits(start: int) -> Column:
        return F.conv(F.substring(digest, start, 4), 16, 10).cast("int")

    return [bits(1).alias("coarse"), bits(5).alias("fine")]


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size (words) and the two bucket numbers of each document's hash."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                       F.size(words(F.col(text_col))).cast("long").alias("size"), *_buckets(id_col, text_col, source_col))


def targets(per_source: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Adds ``target`` to (source, source_size): weights repeat over the sources by code point
    (null last), shares stop at 3 times a source's size, the excess goes to the others by weight.

    The level at which the shares settle is read off the sources ordered by the level they
    stop at: all before the first source that stays below its stop are full. One row per
    source: this window never sees documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    pattern = F.array(*[F.lit(w) for w in weights])
    s = per_source.withColumn("weight", F.get(pattern, (F.row_number().over(by_name) - 1) % len(weights)))
    s = s.withColumn("full", (F.col("source_size") * MAX_COPIES).cast("double"))
    s = s.withColumn("stop", F.col("full") / F.col("weight"))
    by_stop = Window.orderBy("stop", F.col("source").asc_nulls_last())
    before = by_stop.rowsBetween(Window.unboundedPreceding, -1)
    after = by_stop.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    s = s.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("full").over(before), F.lit(0.0)))
                     / F.sum("weight").over(after))
    # the first level that its own source does not exceed holds for all
    s = s.withColumn("settled", F.min(F.when(F.col("level") <= F.col("stop"), F.struct("stop", "level"))).over(everything)["level"])
    share = F.col("weight") * F.col("settled")
    return s.withColumn("target", F.when(F.col("settled").isNull() | (share >= F.col("full")), F.col("full")).otherwise(share)) \
        .select("source", "source_size", "target")


def _edge(histogram: DataFrame, bucket: str) -> DataFrame:
    """Where the running sum of words first passes a source's budget, and what is left there."""
    order = Window.partitionBy("source").orderBy(bucket)
    upto = F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    h = histogram.withColumn("upto", upto).withColumn("left", F.col("budget") - (F.col("upto") - F.col("words")))
    return (h.where(F.col("upto") > F.col("budget"))
            .groupBy("source").agg(F.min(F.struct(bucket, "left", "words")).alias("b"))
            .select("source", f"b.{bucket}", F.col("b.left").alias("left"), F.col("b.words").alias("words")))


def boundary(histogram: DataFrame, bucket: str) -> DataFrame:
    """The bucket of each source in which its budget runs out, and what is left for it.

    ``histogram``: source, budget, <bucket> (16 bits), words; written, as it is read twice.
    Buckets before the boundary are taken whole. Blocks of 256 buckets are summed first and
    only the boundary block is opened, so a window holds at most 256 rows of a source.
    """
    block = F.shiftright(bucket, 8)
    blocks = _edge(histogram.groupBy("source", "budget", block.alias("block")).agg(F.sum("words").alias("words")), "block")
    opened = _with_plan(histogram.drop("budget"), blocks.select("source", F.col("block").alias("__block"), F.col("left").alias("budget")))
    return _edge(opened.where(block == F.col("__block")).drop("__block"), bucket)


def _with_plan(df: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows with their source's row of a table that has one row per source (null included)."""
    plan = plan.withColumnRenamed("source", "__source")
    return df.join(plan, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")


def cuts(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """One row per source of ``sizes`` rows: source, source_size, target, whole copies, what is
    left for one more (budget), and the threshold (__coarse, __fine) below which a document's
    hash takes part in it; no threshold: none or, with a budget, all."""
    coarse = materialize(docs.groupBy("source", "coarse").agg(F.sum("size").alias("words")), "mix-histogram")
    plan = materialize(targets(coarse.groupBy("source").agg(F.sum("words").alias("source_size")), weights)
                       .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
                       .withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")), "mix-plan")
    first = boundary(_with_plan(coarse, plan.select("source", "budget")), "coarse").drop("words")
    first = materialize(first.withColumnsRenamed({"coarse": "__coarse", "left": "budget"}), "mix-boundary")
    inside = _with_plan(docs, first).where(F.col("coarse") == F.col("__coarse"))
    second = boundary(materialize(inside.groupBy("source", "budget", "fine").agg(F.sum("size").alias("words")), "mix-fine"), "fine")
    # the boundary cell (about 2^-32 of a source) goes in if that ends nearer to the budget
    second = second.select("source", (F.col("fine") + F.when(F.col("left") * 2 > F.col("words"), 1).otherwise(0)).alias("__fine"))
    cut = _with_plan(plan, first.select("source", "__coarse")
                     .withColumnRenamed("source", "s").join(second.withColumnRenamed("source", "t"), F.expr("s <=> t"))
                     .select(F.col("s").alias("source"), "__coarse", "__fine"))
    rest = plan.join(first.select(F.col("source").alias("__source")), F.expr("source <=> __source"), "left_anti")
    return materialize(cut.unionByName(rest, allowMissingColumns=True), "mix-cuts")


def copies() -> Column:
    """How often a document (with its buckets and its source's cut) is taken."""
    below = (F.col("coarse") < F.col("__coarse")) | ((F.col("coarse") == F.col("__coarse")) & (F.col("fine") < F.col("__fine")))
    extra = F.when(F.col("__coarse").isNull(), F.when(F.col("budget") > 0, 1).otherwise(0)).when(below, 1).otherwise(0)
    return F.col("whole") + extra


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), id_col: str = "doc_id",
        text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken (size x copies) per document.

    Null text has size 0; a null source is a source of its own; an empty table gives no rows;
    sources without words have target 0 and take none of their (empty) documents; rows with
    a common id are told apart by their texts and sources, and only rows equal in all three
    are taken together. The same input gives the same mix.
    """
    narrow = materialize(sizes(docs, id_col, text_col, source_col), "mix-sizes")
    out = _with_plan(narrow, cuts(narrow, weights)).withColumn("copies", copies())
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), id_col: str = "doc_id",
          text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with their own columns only. The
    texts are not shuffled: each row meets the cut of its source, one row per source."""
    narrow = materialize(sizes(docs, id_col, text_col, source_col), "mix-sizes")
    held = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), *_buckets(id_col, text_col, source_col), F.col(source_col).alias("source"))
    taken = _with_plan(held, cuts(narrow, weights)).withColumn("copies", copies()).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
