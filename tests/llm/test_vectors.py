"""Centroid clustering and code compression against plain versions of the same rounds."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mixtext.llm import centroids as C
from mixtext.llm import codebooks as B
from mixtext.llm.vectors import LARGEST

SCHEMA = "vec_id long, embedding array<double>, label int, code string, cluster int, distance string"


def apart(x, y):
    return sum((a - b) ** 2 for a, b in zip(x, y, strict=True))


def closest(x, entries):
    return min(range(len(entries)), key=lambda i: (apart(x, entries[i]), i))


def means(entries, members):
    out = []
    for i, e in enumerate(entries):
        mine = [x for j, x in members if j == i]
        out.append([sum(col) // len(mine) for col in zip(*mine, strict=True)] if mine else list(e))
    return out


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def rows(dims: int, seed: int = 3, n: int = 400):
    rng = random.Random(seed)
    out = [(i, [rng.gauss(0, 0.3) for _ in range(dims)], rng.choice([0, 1, 1, 1, None])) for i in range(n)]
    hot = [0.125] * dims
    out += [(1000 + i, hot, 7) for i in range(n // 2)]  # one very common vector and label
    out += [(2000 + i, [round(x * 8) / 64 for x in out[i][1]], 2) for i in range(60)]  # many equal distances
    out += [(5, out[9][1], 3), (5, out[9][1], 3), (None, out[11][1], 4), (3000, [0.0] * dims, 5)]
    out += [(3001, None, 1), (3002, [float("nan")] + hot[1:], 1), (3003, [None] + hot[1:], 1), (3004, [float("inf")] + hot[1:], 1),
            (3005, hot[1:], 6), (3006, [], 6)]
    return out


def frame(spark, given):
    return spark.createDataFrame([(i, v, y, "clash", 1, "clash") for i, v, y in given], SCHEMA).repartition(5)


def test_walk_and_orchard_find_the_nearest_with_ties():
    rng = np.random.default_rng(0)
    for k in (1, 2, 5, 16, 40):
        c = rng.integers(-4, 5, (k, 6))
        x = rng.integers(-6, 7, (500, 6))
        d = ((x[:, None, :] - c[None]) ** 2).sum(2)
        label, best = C.CentroidLists(c.tolist()).nearest(x)
        assert (label == d.argmin(1)).all() and (best == d.min(1)).all()
        code, error = B.Orchard([c[:, :3].tolist(), c[:, 3:].tolist()]).nearest(x)
        for p in (0, 1):
            d = ((x[:, None, 3 * p:3 * p + 3] - c[None, :, 3 * p:3 * p + 3]) ** 2).sum(2)
            assert (code[:, p] == d.argmin(1)).all() and (error[:, p] == d.min(1)).all()


def test_walks_stop_early_on_spread_centroids():
    centroids = [[100 * i, -100 * i, 50 * i] for i in range(50)]
    lists = C.CentroidLists(centroids)
    reads = 0
    real = C.squares

    def counted(x, y):
        nonlocal reads
        reads += len(x)
        return real(x, y)

    C.squares = counted
    try:
        x = np.array(centroids) + 3
        label, _ = lists.nearest(x)
    finally:
        C.squares = real
    assert label.tolist() == list(range(50)) and reads < 50 * 6  # exact distances of a few centroids a vector


def test_clustering_matches_plain_rounds(spark):
    given = rows(64)
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v, _ in given if usable(v) and len(v) == 64]
    started = sorted(((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None))[:16]
    centroids = [v for _, v in started]
    for _ in range(3):
        centroids = means(centroids, [(closest(v, centroids), v) for _, v in kept])
    found = C.cluster(frame(spark, given))
    assert found.centroids == centroids
    want = sorted((str(i), closest(v, centroids), min(apart(v, c) for c in centroids)) for i, v in kept)
    assert sorted((str(r.id), r.cluster, r.distance) for r in found.rows.collect()) == want
    full = C.with_inertia(found).collect()
    total = sum(d for _, _, d in want)
    assert len(full) == len(kept)
    for r in full:
        assert r.inertia == total and r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()


def test_clustering_of_few_none_and_huge_vectors(spark):
    few = C.cluster(frame(spark, rows(64)[:3]))
    assert len(few.centroids) == 3 and [r.distance for r in few.rows.collect()] == [0, 0, 0]
    assert C.with_inertia(C.cluster(frame(spark, rows(64)[:0]))).collect() == []
    huge = C.cluster(frame(spark, [(1, [1e300] * 64, 1), (2, [-1e300] * 64, 1), (3, [1e9] * 64, None)]), rounds=0)
    assert sorted(max(map(abs, c)) for c in huge.centroids) == [LARGEST] * 3
    assert {r.distance for r in huge.rows.collect()} == {0}


def test_codebooks_match_plain_rounds(spark):
    given = rows(32)
    kept = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in given if usable(v)]
    fits = [(i, v, y) for i, v, y in kept if len(v) == 32]

    def part(v, p):
        return v[2 * p:2 * p + 2]

    first = [v for _, v, _ in sorted(fits, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:64]]
    books = [[part(v, p) for v in first] for p in range(16)]
    for _ in range(2):
        books = [means(books[p], [(closest(part(v, p), books[p]), part(v, p)) for _, v, _ in fits]) for p in range(16)]
    found = B.compress(frame(spark, given))
    assert found.books == books
    assert found.sha256() == hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()

    def coded(v):
        if len(v) != 32:
            return None, None
        at = [closest(part(v, p), books[p]) for p in range(16)]
        return "".join(f"{i:02x}" for i in at), sum(apart(part(v, p), books[p][i]) for p, i in enumerate(at))

    want = [(i, y, *coded(v)) for i, v, y in kept]
    sums: dict = {}
    for _, y, _, e in want:
        sums[y] = sums.get(y, 0) + e if e is not None else sums.get(y)
    for hot_groups in (1000, 3, 1):  # labels joined by broadcast, some of them, none but nulls
        got = B.with_group_sum(found.rows, "label", "error", "label_error", hot_groups).collect()
        assert sorted(map(str, ((r.id, r.label, r.code, r.error) for r in got))) == sorted(map(str, want))
        assert all(r.label_error == sums[r.label] for r in got)


def test_decoded_vectors_are_near(spark):
    given = {r[0]: r for r in rows(64) if r[0] is not None and usable(r[1]) and len(r[1]) == 64}
    df = frame(spark, given.values())
    found = B.compress(df)
    back = found.rows.select("id", B.decode(found.books, F.col("code")).alias("near"), "error").join(df, F.col("id") == F.col("vec_id")).collect()
    for r in back:  # the mean error of a component is far below its spread; steps are 1/256 wide
        assert abs(math.sqrt(apart(r.embedding, r.near)) - math.sqrt(r.error) / 256) < 8 / 256


def test_codebooks_of_none_few_and_uncut_vectors(spark):
    assert B.compress(frame(spark, rows(32)[:0])).rows.collect() == []
    few = B.compress(frame(spark, rows(32)[:2]))
    assert {r.code for r in few.rows.collect()} == {"00" * 16, "01" * 16} and {r.error for r in few.rows.collect()} == {0}
    uncut = B.compress(frame(spark, [(1, [1.0, 2.0], 1), (2, [], 1)]))
    assert [(r.code, r.error) for r in uncut.rows.collect()] == [(None, None)] * 2
    assert B.with_group_sum(uncut.rows, "label", "error", "label_error").count() == 2
    with pytest.raises(ValueError):
        B.compress(frame(spark, rows(32)[:2]), entries=257)
