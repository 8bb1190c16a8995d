"""Vectors as whole numbers, shared by the clustering and code-compression operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Components beyond this magnitude saturate: four times the sum of 64 squared differences is whole in 64 bits.
LARGEST = 1 << 26


def finite(vector: Column) -> Column:
    """Not null, and no component null, NaN or infinite (an empty vector passes)."""
    each = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.when(vector.isNotNull(), each), F.lit(False))


def whole(vector: Column, scale: int) -> Column:
    """Each component x as floor(scale * x), at most LARGEST in magnitude."""
    limit = F.lit(float(LARGEST))
    return F.transform(vector, lambda x: F.floor(
        F.greatest(F.least(F.lit(float(scale)) * x.cast("double"), limit), -limit)).cast("int"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of an array column without nulls, all of one width."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def whole_means(old: list[list[int]], sums: dict[int, tuple[int, list[int]]]) -> list[list[int]]:
    """floor(sum / count) of each entry's members, component by component; entries without
    members stay."""
    return [[s // sums[i][0] for s in sums[i][1]] if i in sums else list(entry) for i, entry in enumerate(old)]


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row-wise squared distances of whole-number rows."""
    diff = x - y
    return np.einsum("ij,ij->i", diff, diff)
