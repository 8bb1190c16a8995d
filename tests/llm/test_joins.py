"""Nearest neighbours and the n-gram Jaccard join against brute force."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from mixtext.llm import jaccard_join as J
from mixtext.llm import neighbours as N
from tests.llm import odd


def brute(rows, k):
    good = [(i, np.array(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for q in sorted({i for i, _ in good if i % 10 == 0}):
        best = {}
        for _, a in ((i, v) for i, v in good if i == q):
            for i, b in good:
                if i != q and len(a) == len(b):
                    total = 0.0
                    for x, y in zip(b.tolist(), a.tolist(), strict=True):
                        total += (x - y) ** 2
                    best[i] = min(best.get(i, np.inf), total ** 0.5)
        out += [(q, r + 1, i, s) for r, (s, i) in enumerate(sorted((s, i) for i, s in best.items())[:k])]
    return out


def test_nearest_is_exact_on_odd_rows(spark, monkeypatch):
    rng = random.Random(1)
    base = [rng.gauss(0, 1) for _ in range(8)]
    rows = [(i, [rng.gauss(0, 10 ** rng.uniform(-3, 3)) for _ in range(8)]) for i in range(300)]
    rows += [(300 + i, list(base)) for i in range(60)]  # one very common vector
    rows += [(400 + i, [x + 1e-9 * i for x in base]) for i in range(20)]
    rows += [(500, None), (501, []), (502, [0.0] * 8), (503, [None] + base[1:]), (504, [float("nan")] + base[1:]), (505, [float("inf")] + base[1:]),
             (None, base), (510, [1.0, 2.0]), (511, [1.0, 2.5]), (300, base[::-1]), (300, list(base)), (20, base)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    monkeypatch.setattr(N, "CANDIDATE_BLOCK", 64)  # several tiles, and merges of merges
    monkeypatch.setattr(N, "QUERY_BLOCK", 16)
    monkeypatch.setattr(N, "MERGE_FAN", 2)
    got = N.nearest(df, F.col("vec_id") % 10 == 0, k=7).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 7)
    assert N.nearest(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert N.nearest(df, F.col("vec_id") < 0).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(2)
    q, c = rng.normal(size=(30, 16)) * 100, rng.normal(size=(50, 16))
    low, high = N.bounds(q, c)
    true = np.array([N.distances(x, c) for x in q])
    assert (low <= true).all() and (true <= high).all()


def words_set(text):
    w = [x.decode() for x in (text or "").encode().lower().split()]
    return {tuple(w)} if 0 < len(w) < 3 else {tuple(w[i:i + 3]) for i in range(len(w) - 2)}


def brute_components(rows):
    sets = [(i, words_set(t)) for i, t in rows]
    up = {i: i for i, _ in rows if i is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            both = len(s & t)
            if i is not None and j is not None and both and 100 * both >= 90 * len(s | t):
                x, y = sorted((find(i), find(j)))
                up[y] = x
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=str)


def near_copies(rng, n, size, edits):
    base = [f"v{rng.randrange(10_000)}" for _ in range(size)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(size)] = f"e{rng.randrange(10_000)}"
        out.append(" ".join(w))
    return out


def test_components_match_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    line = " ".join(f"common{i}" for i in range(12))
    texts = near_copies(rng, 120, 150, 8) + near_copies(rng, 40, 30, 2) + near_copies(rng, 30, 400, 30)
    texts += [f"{line} {rng.randrange(10**6)} {rng.randrange(10**6)}" for _ in range(80)]  # one very common line
    texts += [line] * 50 + ["a b", "A B", "a b c", "A  b\tC", "b a", "one", "ONE", "É x", "é x"]
    for n in (20, 40, 60):  # at and around the threshold
        w = [f"t{n}x{i}" for i in range(n)]
        texts += [" ".join(w), " ".join(w[:-1]), " ".join(w[:-2]), " ".join(w + ["z"]), " ".join(w[2:] + ["q", "r"])]
    rng.shuffle(texts)
    rows = [(1000 - i, t) for i, t in enumerate(texts)]
    rows += [(5000, None), (5001, ""), (5002, " \n"), (None, "a b c"), (7, line), (7, "a b c")]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n_shingles int").repartition(5)
    want = brute_components(rows)
    assert sorted((tuple(r) for r in J.jaccard_components(df).collect()), key=str) == want
    monkeypatch.setattr(J, "WIDE", 3)  # size classes, and tiles of small groups
    monkeypatch.setattr(J, "GROUP_BLOCK", 40)
    assert sorted((tuple(r) for r in J.jaccard_components(df).collect()), key=str) == want


def test_lists_and_groups_are_bounded_before_they_come_together(spark, monkeypatch):
    rng = random.Random(13)
    texts = near_copies(rng, 150, 60, 1) + near_copies(rng, 40, 200, 8) + near_copies(rng, 20, 600, 20)
    texts += [" ".join([*(f"same{i}" for i in range(40)), f"word{i}"]) for i in range(150)]  # one template, a changing word
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for name, bound in (("LIST_BLOCK", 32), ("GROUP_BLOCK", 24), ("GROUP_ELEMENTS", 3000)):
        monkeypatch.setattr(J, name, bound)
    most = {"list": 0, "group": 0, "elements": 0}
    tiled, blocks = J._tiled, J._blocks

    def lists(entries, rule):
        out = tiled(entries, rule).cache()
        most["list"] = out.groupBy("e", "tile").count().agg(F.max("count")).first()[0]
        return out

    def tiles(rows, nb, by):
        out = blocks(rows, nb, by)
        if "gs" in rows.columns:
            out = out.cache()
            found = out.groupBy("g", "gs", "t1", "t2").agg(F.count("*").alias("m"), F.sum("n").alias("n")).agg(F.max("m"), F.max("n")).first()
            most["group"], most["elements"] = found
        return out

    monkeypatch.setattr(J, "_tiled", lists)
    monkeypatch.setattr(J, "_blocks", tiles)
    assert sorted((tuple(r) for r in J.jaccard_components(df).collect()), key=str) == brute_components(rows)
    assert 0 < most["list"] <= 4 * 32 and 0 < most["group"] <= 4 * 24 and 0 < most["elements"] <= 4 * 3000, most


def test_components_odd_rows(spark):
    got = sorted((tuple(r) for r in J.jaccard_components(odd.frame(spark)).collect()), key=str)
    assert got == brute_components([(r[0], r[1]) for r in odd.rows()])
    assert J.jaccard_components(odd.empty(spark)).count() == 0


def test_links_are_a_spanning_forest():
    rng = random.Random(7)
    sets = [np.unique(np.array([hash(w) & (2**63 - 1) for w in t.split()], np.uint64)) for t in near_copies(rng, 60, 80, 6)]
    found = J.links(sets)
    one, all_pairs = J.Forest(60), J.Forest(60)
    for x, y in found:
        assert one.join(x, y)
    for x in range(60):
        for y in range(x):
            both = len(np.intersect1d(sets[x], sets[y]))
            if 100 * both >= 90 * (len(sets[x]) + len(sets[y]) - both):
                all_pairs.join(x, y)
    assert [one.find(x) for x in range(60)] == [all_pairs.find(x) for x in range(60)]


def test_contractions_find_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000)]
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    got = {r.v: r.c for r in J.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}


def test_lists_keep_pairs_only_where_they_may_meet_first():
    """A position bounds a pair as its first shared element, in lists beyond 256 rows too."""
    near = J.Rule(shingle=5, num=80)
    sk = np.full(16, 6, np.uint8)
    assert J.may_link(np.int64(100), np.int64(11), sk, np.int64(100), np.int64(11), sk, near)
    assert not J.may_link(np.int64(100), np.int64(15), sk, np.int64(100), np.int64(15), sk, near)  # 85 left, 89 needed

    k = 300
    far = np.tile(np.arange(k, dtype=np.uint8)[:, None] * 37, (1, 16)) + np.arange(16, dtype=np.uint8) * 11
    far = far[np.unique(far[:, 0], return_index=True)[1]]
    far = np.concatenate([far, far ^ 0x55])
    e, d = np.zeros(len(far), np.int64), np.arange(len(far), dtype=np.int64)
    n, p = np.full(len(far), 100, np.int64), np.full(len(far), 15, np.int64)
    assert len(far) > 256 and not len(J._meetings(e, d, far, n, p, near)[0])
    p[[3, 7]], far[7] = 0, far[3]
    group, member = J._meetings(e, d, far, n, p, near)
    assert sorted(member.tolist()) == [3, 7] and group.tolist() == [3, 3]
