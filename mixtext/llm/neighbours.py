"""Nearest neighbours by a block matrix join on int8 tiles.

Vectors are dealt into blocks; each (query block, candidate block) pair is one tile. A tile
rounds both blocks to int8, multiplies them, and gets from the products a lower and an upper
bound of every distance: rounding moves a vector by a known residual, and two residuals move
a distance by at most their sum. Only pairs whose lower bound does not exceed the k-th
smallest upper bound of their query are computed in double precision; each tile keeps the k
best per query in a heap and the tiles' heaps are merged. The result is exact.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUERY_BLOCK = 4096  # queries in a tile
CANDIDATE_BLOCK = 2048  # candidates in a tile
STEP = 512  # queries multiplied at a time: the products take 8 MB
MERGE_FAN = 64  # tiles merged in one first-level merge


def usable(vector: Column) -> Column:
    """Not null, not empty, every component finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.when(vector.isNotNull() & (F.size(vector) > 0), finite & F.exists(vector, lambda x: x != 0)), F.lit(False))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, scale per row, residual length per row); the codes are whole numbers in
    [-127, 127]. They are held as float so that BLAS multiplies them: sums stay exact."""
    scale = np.maximum(np.abs(x).max(axis=1) / 127.0, np.finfo(np.float64).tiny)
    codes = np.rint(x / scale[:, None])
    rest = np.sqrt(((x - codes * scale[:, None]) ** 2).sum(axis=1))
    # 127 * 127 * dimensions must stay below 2**24 for exact float sums
    kind = np.float32 if x.shape[1] <= 1024 else np.float64
    return codes.astype(np.int8).astype(kind), scale, rest


def bounds(q: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all distances between the rows of q and c."""
    qc, qs, qr = quantise(q)
    cc, cs, cr = quantise(c)
    product = (qc @ cc.T).astype(np.float64)  # whole numbers
    product *= qs[:, None] * cs[None, :]
    qn = ((qc.astype(np.float64) * qs[:, None]) ** 2).sum(axis=1)
    cn = ((cc.astype(np.float64) * cs[:, None]) ** 2).sum(axis=1)
    squares = qn[:, None] + cn[None, :] - 2 * product
    with np.errstate(invalid="ignore"):
        between = np.sqrt(np.maximum(squares, 0.0))
    # rounding of the squares themselves, which matters for near-equal vectors
    slack = np.sqrt(1e-13 * (qn[:, None] + cn[None, :])) + qr[:, None] + cr[None, :]
    low, high = between - slack, between + slack
    unknown = ~(np.isfinite(low) & np.isfinite(high))  # squares beyond the range of doubles
    low[unknown], high[unknown] = -np.inf, np.inf
    return low, high


def distances(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Euclidean distances of one vector to rows, squares added in order of the components."""
    total = np.zeros(len(c))
    for d in range(len(q)):
        total += (c[:, d] - q[d]) ** 2
    return np.sqrt(total)


NO_QUERIES = pd.DataFrame({"query_id": [], "query": []})


def tile(queries: pd.DataFrame, candidates: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best candidates of the tile for each query: query_id, vec_id, score."""
    out = {"query_id": [], "vec_id": [], "score": []}
    if len(queries):
        ids = candidates["vec_id"].to_numpy()
        c = np.stack(candidates["v"].to_numpy()).astype(np.float64)
        most = np.unique(ids, return_counts=True)[1].max()  # vectors of one id count once
        for a in range(0, len(queries), STEP):
            part = queries.iloc[a:a + STEP]
            q = np.stack(part["query"].to_numpy()).astype(np.float64)
            low, high = bounds(q, c)
            for i, query in enumerate(part["query_id"].to_numpy()):
                others = ids != query
                high[i, ~others] = np.inf
                want = int(k * most)
                cut = np.partition(high[i], want - 1)[want - 1] if want <= len(ids) else np.inf
                survive = np.flatnonzero(others & (low[i] <= cut))
                best: dict[int, float] = {}
                for vec, score in zip(ids[survive].tolist(), distances(q[i], c[survive]).tolist(), strict=True):
                    if score < best.get(vec, np.inf):
                        best[vec] = score
                for score, vec in heapq.nsmallest(k, ((s, x) for x, s in best.items())):
                    out["query_id"].append(query)
                    out["vec_id"].append(vec)
                    out["score"].append(score)
    return pd.DataFrame(out).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})


def merged(found: pd.DataFrame, k: int) -> list[tuple[float, int]]:
    """The k smallest (score, vec_id) of sorted lists merged by a heap, one entry per id."""
    lists = [list(zip(g["score"], g["vec_id"], strict=True)) for _, g in found.sort_values(["score", "vec_id"]).groupby("src", sort=False)]
    out: list[tuple[float, int]] = []
    seen = set()
    for score, vec in heapq.merge(*lists):
        if vec not in seen:
            seen.add(vec)
            out.append((score, vec))
            if len(out) == k:
                break
    return out


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest rows of each query row.

    Null, empty or zero vectors, and those with null or non-finite components, take no part,
    nor do rows with a null id. Vectors of different lengths are never compared. Rows that
    share an id are one item: its nearest vector counts, and it is not its own neighbour.
    Ties go to the smaller id; with fewer than k candidates all are returned; a table without
    usable queries or candidates gives no rows. Other columns are ignored.

    Blocks have a fixed number of rows, so a tile's memory does not grow with the table;
    every query block meets every candidate block, which is the stated all-rows search.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"),
                          F.coalesce(is_query, F.lit(False)).alias("q")) \
        .where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    n = rows.agg(F.count("*").alias("n"), F.sum(F.col("q").cast("long")).alias("q")).first()
    c_blocks = max(1, -(-n["n"] // CANDIDATE_BLOCK))
    q_blocks = max(1, -(-(n["q"] or 0) // QUERY_BLOCK))
    mixed = F.xxhash64("vec_id")  # vectors of one id share a block
    candidates = rows.select("vec_id", "v", F.size("v").alias("dim"), F.pmod(mixed, F.lit(c_blocks)).cast("int").alias("cb"),
                             F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb"))
    queries = rows.where("q").select(F.col("vec_id").alias("query_id"), F.col("v").alias("query"), F.size("v").alias("dim"), F.pmod(mixed, F.lit(q_blocks)).cast("int").alias("qb"),
                                     F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))).alias("cb"))

    def join(key: tuple, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = tile(q, c, k) if len(q) and len(c) else tile(NO_QUERIES, c, k)
        out["src"] = int(key[1])
        return out

    tiles = queries.groupBy("qb", "cb", "dim").cogroup(candidates.groupBy("qb", "cb", "dim")) \
        .applyInPandas(join, "query_id long, vec_id long, score double, src int")

    def merge_lists(pdf: pd.DataFrame) -> pd.DataFrame:
        best = merged(pdf, k)
        return pd.DataFrame({"query_id": pdf["query_id"].iloc[0], "vec_id": [x for _, x in best], "score": [s for s, _ in best],
                             "src": int(pdf["src"].iloc[0]) // MERGE_FAN, "rank": range(1, len(best) + 1)})

    schema = "query_id long, vec_id long, score double, src int, rank int"
    fan = c_blocks
    out = tiles
    while fan > MERGE_FAN:  # many tiles: heaps of heaps, so that no merge holds more than MERGE_FAN lists
        out = out.groupBy("query_id", F.floor(F.col("src") / MERGE_FAN)).applyInPandas(merge_lists, schema).drop("rank")
        fan = -(-fan // MERGE_FAN)
    out = out.groupBy("query_id").applyInPandas(merge_lists, schema)
    return out.select("query_id", "rank", "vec_id", "score")
