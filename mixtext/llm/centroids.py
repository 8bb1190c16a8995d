"""Centroid clustering whose assignments run Fagin's threshold algorithm.

Every dimension keeps the centroids sorted by their value there. For one vector the lists are
walked outward from the vector's own value, all dimensions in step: each step shows, in each
dimension, the next nearest centroid, and a centroid seen for the first time gets its exact
distance. A centroid not seen yet is at least as far in every dimension as that dimension's
frontier, so once the sum of the squared frontier distances strictly exceeds the best exact
distance the walk stops. All arithmetic is on whole numbers, so results are exact.

Spark assigns rows where they lie; a round shuffles one partial sum for each task and
centroid, and brings centroids x dimensions totals to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixtext.llm.vectors import finite, matrix, squares, whole, whole_means
from mixtext.session import materialize

CHUNK = 2048  # vectors walked at a time: a walk's arrays take a few MB


class CentroidLists:
    """Per-dimension sorted lists of centroids."""

    def __init__(self, centroids: list[list[int]]):
        self.c = np.array(centroids, np.int64)
        self.order = np.argsort(self.c.T, axis=1, kind="stable")  # dimension, position -> centroid
        self.values = np.take_along_axis(self.c.T, self.order, axis=1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of each row's nearest centroid; ties: smaller number."""
        labels, best = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
        for a in range(0, len(x), CHUNK):
            labels[a:a + CHUNK], best[a:a + CHUNK] = self._walk(x[a:a + CHUNK])
        return labels, best

    def _walk(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k, dims = self.c.shape
        n = len(x)
        label, best = np.full(n, k, np.int64), np.full(n, np.iinfo(np.int64).max, np.int64)
        seen = np.zeros((n, k), bool)
        right = np.stack([np.searchsorted(self.values[d], x[:, d]) for d in range(dims)], axis=1)
        left = right - 1
        row = np.arange(n)  # vectors still walking
        at = np.arange(dims) * k
        far = np.iinfo(np.int64).max >> 1
        while len(row):
            to_left = np.where(left >= 0, x - self.values.ravel()[at + np.maximum(left, 0)], far)
            to_right = np.where(right < k, self.values.ravel()[at + np.minimum(right, k - 1)] - x, far)
            go_left = to_left <= to_right
            frontier = np.where(go_left, to_left, to_right)
            shown = self.order.ravel()[at + np.where(go_left, np.maximum(left, 0), np.minimum(right, k - 1))]
            left, right = left - go_left, right + ~go_left
            new = np.zeros((len(row), k), bool)
            new[np.arange(len(row))[:, None], shown] = True
            new &= ~seen[row]
            seen[row] |= new
            for c in range(k):  # ascending, so that equal distances keep the smaller number
                i = np.flatnonzero(new[:, c])
                if len(i):
                    d, r = squares(x[i], self.c[c]), row[i]
                    wins = (d < best[r]) | ((d == best[r]) & (c < label[r]))
                    best[r[wins]], label[r[wins]] = d[wins], c
            stay = (np.square(frontier).sum(axis=1) <= best[row]) & ~seen[row].all(axis=1)
            row, x, left, right = row[stay], x[stay], left[stay], right[stay]
        return label, best


@dataclass
class Clustering:
    """Final centroids, and ``rows``: id, cluster, distance of every vector (a written table)."""

    centroids: list[list[int]]
    rows: DataFrame


def start_hash(vec_id: Column) -> Column:
    return F.sha2(F.concat(F.lit("1:"), vec_id.cast("string")), 256)


def first_centroids(rows: DataFrame, k: int) -> list[list[int]]:
    """The k vectors with the smallest start hash; rows without an id come last, equal hashes
    (repeated ids) by vector."""
    picked = rows.select(start_hash(F.col("id")).alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k)
    return [list(r["v"]) for r in picked.collect()]  # k rows


def partial_sums(rows: DataFrame, lists: CentroidLists, dims: int) -> dict[int, tuple[int, list[int]]]:
    """centroid -> (members, sums by dimension): one row for each task and centroid, added up."""
    k = len(lists.c)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for b in batches:
            x = matrix(b.column(0), dims)
            label, _ = lists.nearest(x)
            count += np.bincount(label, minlength=k)
            np.add.at(total, label, x)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(count[used], pa.int64()),
                                          pa.array(total[used].tolist(), pa.list_(pa.int64()))], names=["c", "n", "s"])

    parts = rows.select("v").mapInArrow(add, "c int, n long, s array<long>")
    sums = parts.select("c", "n", F.posexplode("s").alias("d", "s")) \
        .groupBy("c", "d").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(28,0)")).alias("s")).collect()
    out: dict[int, tuple[int, list[int]]] = {}
    for r in sums:
        out.setdefault(r["c"], (r["n"], [0] * dims))[1][r["d"]] = int(r["s"])
    return out


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, dims: int = 64,
            id_col: str = "vec_id", vector_col: str = "embedding") -> Clustering:
    """Lloyd rounds over all vectors of ``dims`` finite components, as whole numbers floor(scale * x).

    Vectors that are null, of another length, or hold null or non-finite components are left
    out. Components beyond 2**26 after scaling saturate there. Repeated ids and rows are
    separate vectors; a null id is assigned like any other but starts a centroid only if
    fewer than k vectors have ids. Fewer than k vectors: as many centroids as vectors. An empty table:
    no centroids, no rows. Other columns are ignored.
    """
    v = F.col(vector_col)
    kept = vectors.where(finite(v) & (F.size(v) == dims)).select(F.col(id_col).alias("id"), whole(v, scale).alias("v"))
    rows = materialize(kept, "clustering-vectors")
    centroids = first_centroids(rows, k)
    if not centroids:
        return Clustering([], rows.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")))
    for _ in range(rounds):
        centroids = whole_means(centroids, partial_sums(rows, CentroidLists(centroids), dims))
    lists = CentroidLists(centroids)

    def assign(column: pa.Array) -> pa.Array:
        label, best = lists.nearest(matrix(column, dims))
        return pa.StructArray.from_arrays([pa.array(label, pa.int32()), pa.array(best, pa.int64())], names=["cluster", "distance"])

    assign.__annotations__ = {"column": pa.Array, "return": pa.Array}
    done = rows.withColumn("a", F.arrow_udf(assign, "cluster int, distance long")("v")).select("id", "a.cluster", "a.distance")
    return Clustering(centroids, materialize(done, "clustering-rows"))


def with_inertia(found: Clustering) -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia and each centroid's checksum."""
    per = found.rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # at most k rows
    total = sum(r["cluster_inertia"] for r in per)
    facts = [(r["cluster"], r["cluster_inertia"], total,
              hashlib.sha256(",".join(map(str, found.centroids[r["cluster"]])).encode()).hexdigest()) for r in per]
    spark = found.rows.sparkSession
    table = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.rows.join(F.broadcast(table), "cluster")  # k rows
