"""Column functions over probability vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Confidence band thresholds of the reference
HIGH_CONFIDENCE = 0.70
MEDIUM_CONFIDENCE = 0.55
# absolute tolerance of the near-equality check
TOLERANCE = 1e-8


def softmax_exp(z: Column) -> Column:
    """exp(z - max z), the unnormalised half of the softmax."""
    return F.transform(z, lambda x: F.exp(x.cast("double") - F.array_max(z)))


def normalise(e: Column) -> Column:
    total = F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(e, lambda x: x / total)


def softmax(z: Column) -> Column:  # X1
    """exp(z - max z) / sum; JVM-side higher-order functions, no UDF. Apply to a
    column reference (not an inline expression) so z is evaluated once."""
    return normalise(softmax_exp(z))


def argmax_index(p: Column) -> Column:  # X2 (1-based, first index on ties)
    return F.array_position(p, F.array_max(p)).cast("int")


def confidence(p: Column) -> Column:  # X3
    return F.array_max(p)


def label_probabilities(classes: Column, p: Column) -> Column:  # X5
    return F.map_from_arrays(classes, p)


def ranked_probabilities(classes: Column, p: Column, n) -> Column:  # T2 + X10
    """Top-n array<struct<label, probability>> by probability desc, ties by class index."""
    items = F.transform(
        F.arrays_zip(classes.alias("label"), p.alias("probability")),
        lambda s, i: F.struct(s["label"].alias("label"), s["probability"].alias("probability"), i.alias("idx")),
    )
    ordered = F.array_sort(
        items,
        lambda a, b: F.when(a["probability"] > b["probability"], -1)
        .when(a["probability"] < b["probability"], 1)
        .otherwise(a["idx"] - b["idx"]),
    )
    stripped = F.transform(ordered, lambda s: F.struct(s["label"].alias("label"), s["probability"].alias("probability")))
    n = n if isinstance(n, Column) else F.lit(int(n))
    return F.slice(stripped, 1, F.greatest(n, F.lit(0)))


def confidence_band(conf: Column) -> Column:  # P6
    return (
        F.when(conf >= HIGH_CONFIDENCE, F.lit("high"))
        .when(conf >= MEDIUM_CONFIDENCE, F.lit("medium"))
        .otherwise(F.lit("low"))
    )


def almost_equal(a: Column, b: Column, tolerance: float = TOLERANCE) -> Column:  # X6
    return F.coalesce(F.abs(a.cast("double") - b.cast("double")) <= F.lit(tolerance), F.lit(False))


def l2_normalize(v: Column) -> Column:  # X4 on an array column; a zero vector stays zero
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(F.lit(0.0)))
