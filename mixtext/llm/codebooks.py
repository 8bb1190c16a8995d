"""Vector code compression by product codebooks searched with Orchard's algorithm.

A vector is cut into equal parts; each part position has a codebook, and a part is stored as
the index of its nearest entry. Every entry keeps all entries of its codebook sorted by their
distance to it. A search stands at one entry and reads its list: an entry not visited yet is
measured and marked; one that is nearer (or as near, with a lower index) becomes the new
stand, and its list is read from the start. An entry further from the stand than twice the
stand's own distance cannot be nearer, nor can those after it: there the search ends.

Spark encodes rows where they lie; a round shuffles one partial sum for each task and used
entry, and brings the totals of all entries (parts x entries x part width) to the driver.
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

CHUNK = 1024  # vectors searched at a time, all their parts together
HOT_GROUPS = 1000  # labels that can hold more than a thousandth of all rows each


class Orchard:
    """Codebooks (parts x entries x width) with distance-sorted neighbour lists."""

    def __init__(self, books: list[list[list[int]]]):
        self.books = np.array(books, np.int64)
        self.parts, self.size, self.width = self.books.shape
        between = np.square(self.books[:, :, None, :] - self.books[:, None, :, :]).sum(axis=3)
        order = np.argsort(between, axis=2, kind="stable")
        self.entries = self.books.reshape(-1, self.width)
        # row: an entry of any part; column: place in its list
        self.lists = order.reshape(-1, self.size)
        self.reach = np.take_along_axis(between, order, axis=2).reshape(-1, self.size)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (rows x parts) and squared distances of all parts; ties: lower index."""
        code = np.empty((len(x), self.parts), np.int64)
        error = np.empty((len(x), self.parts), np.int64)
        for a in range(0, len(x), CHUNK):
            rows = x[a:a + CHUNK]
            found = self._search(rows.reshape(-1, self.width))
            code[a:a + CHUNK], error[a:a + CHUNK] = (f.reshape(len(rows), self.parts) for f in found)
        return code, error

    def _search(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(q)
        base = np.tile(np.arange(self.parts) * self.size, n // self.parts)
        stand = np.zeros(n, np.int64)  # every search starts at its codebook's first entry
        best = squares(q, self.entries[base])
        visited = np.zeros((n, self.size), bool)
        visited[:, 0] = True
        row, place = np.arange(n), np.zeros(n, np.int64)
        while True:
            more = place < self.size
            row, place = row[more], place[more]
            here = base[row] + stand[row]
            more = self.reach[here, place] <= 4 * best[row]  # squared: strictly beyond twice the distance ends
            row, place, here = row[more], place[more], here[more]
            if not len(row):
                return stand, best
            entry = self.lists[here, place]
            fresh = ~visited[row, entry]
            r, e = row[fresh], entry[fresh]
            visited[r, e] = True
            d = squares(q[r], self.entries[base[r] + e])
            wins = (d < best[r]) | ((d == best[r]) & (e < stand[r]))
            best[r[wins]], stand[r[wins]] = d[wins], e[wins]
            place += 1
            jumped = np.flatnonzero(fresh)[wins]
            place[jumped] = 0


@dataclass
class Codebooks:
    """Final codebooks, and ``rows``: id, label, code, error of every kept vector (a written table)."""

    books: list[list[list[int]]]
    rows: DataFrame

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for part in self.books for entry in part for x in entry).encode()).hexdigest()


def used_width(rows: DataFrame, parts: int) -> int:
    """The length of the vector with the smallest id that can be cut into equal parts; 0 if none."""
    first = rows.where((F.size("v") > 0) & (F.size("v") % parts == 0)) \
        .select("id", "v").orderBy(F.asc_nulls_last("id"), F.size("v"), "v").limit(1).collect()
    return len(first[0]["v"]) if first else 0


def partial_sums(rows: DataFrame, search: Orchard, dims: int) -> list[dict[int, tuple[int, list[int]]]]:
    """For each part: entry -> (members, sums). One row for each task, part and used entry."""
    parts, size, width = search.parts, search.size, search.width

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(parts * size, np.int64), np.zeros((parts * size, width), np.int64)
        for b in batches:
            x = matrix(b.column(0), dims)
            at = (search.nearest(x)[0] + np.arange(parts) * size).ravel()
            count += np.bincount(at, minlength=parts * size)
            np.add.at(total, at, x.reshape(-1, width))
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(count[used], pa.int64()),
                                          pa.array(total[used].tolist(), pa.list_(pa.int64()))], names=["e", "n", "s"])

    found = rows.select("v").mapInArrow(add, "e int, n long, s array<long>") \
        .select("e", "n", F.posexplode("s").alias("d", "s")) \
        .groupBy("e", "d").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(28,0)")).alias("s")).collect()
    out: list[dict[int, tuple[int, list[int]]]] = [{} for _ in range(parts)]
    for r in found:
        part, entry = divmod(r["e"], size)
        out[part].setdefault(entry, (r["n"], [0] * width))[1][r["d"]] = int(r["s"])
    return out


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256,
             id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> Codebooks:
    """Codebooks learnt from, and codes of, every vector of finite components as floor(scale * x).

    Null vectors and those with null or non-finite components are dropped. The codebooks'
    width is that of the vector with the smallest id among those that can be cut into equal
    parts; vectors of another length stay in the result with a null code and error and take no part
    in the codebooks. Components beyond 2**26 after scaling saturate there. Repeated ids and
    rows are separate vectors (equal ids start in order of their components), null ids come
    last. Fewer than ``entries`` vectors: as many entries as vectors. At most 256 entries: a code
    is two hex digits. An empty table: no codebooks, no rows. Other columns are ignored.
    """
    if not 0 < entries <= 256:
        raise ValueError("a codebook holds 1 to 256 entries")
    kept = vectors.where(finite(F.col(vector_col))) \
        .select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), whole(F.col(vector_col), scale).alias("v"))
    rows = materialize(kept, "codebooks-vectors")
    dims = used_width(rows, parts)
    if not dims:
        return Codebooks([[] for _ in range(parts)], rows.select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")))
    fits = rows.where(F.size("v") == dims)
    first = [r["v"] for r in fits.select("id", "v").orderBy(F.asc_nulls_last("id"), "v").limit(entries).collect()]  # ``entries`` rows
    width = dims // parts
    books = [[list(v[p * width:(p + 1) * width]) for v in first] for p in range(parts)]
    for _ in range(rounds):
        sums = partial_sums(fits, Orchard(books), dims)
        books = [whole_means(book, s) for book, s in zip(books, sums, strict=True)]
    search = Orchard(books)

    def encode(column: pa.Array) -> pa.Array:
        good = np.flatnonzero(np.diff(column.offsets.to_numpy()) == dims)
        code, error = search.nearest(matrix(column.take(pa.array(good)), dims))
        codes, errors = [None] * len(column), [None] * len(column)
        for i, row, total in zip(good.tolist(), code.astype(np.uint8), error.sum(axis=1).tolist(), strict=True):
            codes[i], errors[i] = row.tobytes().hex(), total
        return pa.StructArray.from_arrays([pa.array(codes, pa.string()), pa.array(errors, pa.int64())], names=["code", "error"])

    encode.__annotations__ = {"column": pa.Array, "return": pa.Array}
    done = rows.withColumn("c", F.arrow_udf(encode, "code string, error long")("v")).select("id", "label", "c.code", "c.error")
    return Codebooks(books, materialize(done, "codebooks-rows"))


def with_group_sum(rows: DataFrame, group: str, value: str, name: str, hot_groups: int = HOT_GROUPS) -> DataFrame:
    """``rows`` plus the sum of ``value`` over rows of an equal ``group`` (nulls together).

    Sums combine in the tasks before they are shuffled. Groups that hold more than one row in
    ``hot_groups`` (so fewer than ``hot_groups`` of them) are joined by broadcast, the rest by
    a shuffle in which no key is frequent.
    """
    sums = materialize(rows.groupBy(F.col(group).alias("__g")).agg(F.sum(value).alias(name), F.count("*").alias("__n")), "group-sums")
    total = sums.agg(F.sum("__n")).first()[0] or 0
    is_hot = F.col("__g").isNull() | (F.col("__n") * hot_groups > total)
    hot = sums.where(is_hot).select("__g", F.col(name).alias("__hot"), F.lit(True).alias("__is_hot"))
    marked = rows.join(F.broadcast(hot), F.col(group).eqNullSafe(F.col("__g")), "left").drop("__g")
    cold = sums.where(~is_hot).select("__g", name)
    rest = marked.where("__is_hot IS NULL").drop("__hot", "__is_hot").join(cold.hint("shuffle_hash"), F.col(group) == F.col("__g")).drop("__g")
    return marked.where("__is_hot").drop("__is_hot").withColumnRenamed("__hot", name).unionByName(rest)


def decode(books: list[list[list[int]]], code: Column, scale: int = 256) -> Column:
    """The vector a code stands for (each component in the middle of its step of 1 / scale)."""
    def text(x) -> str:
        return "array(" + ",".join(map(text, x)) + ")" if isinstance(x, list) else f"{(x + 0.5) / scale!r}D"

    entries = F.expr(text(books))
    parts = F.transform(F.sequence(F.lit(0), F.lit(len(books) - 1)), lambda p: F.element_at(
        F.element_at(entries, p + 1), F.conv(F.substring(code, 2 * p + 1, F.lit(2)), 16, 10).cast("int") + 1))
    return F.when(code.isNotNull(), F.flatten(parts))
