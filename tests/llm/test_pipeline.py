"""The pipeline's stages, each against a plain version on its own input, and the registry."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as C
from mixtext.llm.common import read
from mixtext.llm.jaccard_join import Forest, Rule, jaccard_components
from mixtext.session import materialize
SF001 = "/root/testdata/sf0.001"
from tests.llm import odd
from tests.llm.test_joins import brute_components, near_copies
from tests.llm.test_text_files import base_secrets


def test_stages_on_odd_and_given_rows(spark):
    given = read(spark, SF001, "documents")
    docs = given.unionByName(odd.frame(spark).select(*given.columns)).withColumn("text", given["text"])
    kept = materialize(C.identify(spark, docs, SF001), "t")
    assert kept.columns == docs.columns
    assert Counter(map(tuple, kept.collect())) == Counter(tuple(r) for r in docs.collect() if any(c.isalpha() for c in r.text or ""))
    single = materialize(C.deduplicate(spark, kept, SF001), "t")
    check_one_row_of_each_group(kept.collect(), single.collect())
    assert single.columns == docs.columns
    single = materialize(single.withColumn("doc_id", F.xxhash64("doc_id", "text")), "t")  # the rest looks rows up by id
    clean = materialize(C.mask_secrets(spark, single, SF001), "t")
    assert clean.columns == docs.columns and clean.count() == single.count()
    before = {r.doc_id: r for r in single.collect()}
    for r in clean.collect():
        found = base_secrets(before[r.doc_id].text)
        if found:
            assert "<secret>" in r.text and not any(before[r.doc_id].text[a:z] in r.text for _, a, z in found) and r.n_chars == len(r.text)
        elif "<secret>" not in r.text:
            assert r == before[r.doc_id]
    mixture = C.mix_sources(spark, clean, SF001)
    assert mixture.columns == docs.columns
    texts = {r.doc_id: r.text for r in clean.collect()}
    copies = Counter(r.doc_id for r in mixture.collect())
    assert all(1 <= n <= 3 for n in copies.values()) and set(copies) <= set(texts)
    assert abs(sum(n * len(texts[i].encode().split()) for i, n in copies.items()) / sum(len(t.encode().split()) for t in texts.values()) - 1) < 0.2
    last = C.encode(spark, mixture, SF001).collect()
    assert Counter(r.doc_id for r in last) == copies and all(r.round_trip or "▁" in texts[r.doc_id] for r in last)


def check_one_row_of_each_group(rows, kept):
    """Groups of linked texts; of each, one row with the smallest id (null ids last)."""
    group = {i: c for i, _, c in brute_components([(i, r.text) for i, r in enumerate(rows)])}
    alone = {}  # equal rows without words are one group, others without words link with nothing
    for i, r in enumerate(rows):
        if not (r.text or "").encode().split():
            group[i] = group[alone.setdefault((r.doc_id, r.text), i)]
    of: dict = {}
    for i, r in enumerate(rows):
        of.setdefault(group[i], []).append(r)
    assert len(kept) == len(of)
    left = Counter(map(str, kept))
    for members in of.values():
        least = min((r.doc_id is None, r.doc_id or 0) for r in members)
        mine = {str(r) for r in members if (r.doc_id is None, r.doc_id or 0) == least}
        assert sum(left[r] for r in mine) == 1, mine


def test_repeated_and_null_ids_lose_no_text(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    c = " ".join(f"c{i}" for i in range(30))
    schema = "doc_id long, text string, source string"
    rows = [(7, a, "s"), (7, b, "s"), (9, b, "s"), (None, c, "s"), (None, c, "t"), (5, None, "s"), (5, None, "s"), (6, "", "s"), (None, a, "s")]
    docs = spark.createDataFrame(rows, schema).repartition(4)
    first = C.near_copies(spark, docs, SF001).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in first) == sorted([(7, a), (7, b), (0, c), (5, ""), (6, "")])
    check_one_row_of_each_group(docs.collect(), first)
    again = C.near_copies(spark, docs.repartition(7, "text"), SF001).collect()
    assert sorted(map(str, first)) == sorted(map(str, again))


def test_run_is_the_chain_of_stages(spark):
    docs = read(spark, SF001, "documents")
    for name, stage in C.STAGES:
        docs = materialize(stage(spark, docs, SF001), name)
    assert sorted(map(str, docs.collect())) == sorted(map(str, C.run(spark, SF001).collect()))


def test_stages_take_an_empty_table(spark):
    docs = read(spark, SF001, "documents").limit(0)
    for name, stage in C.STAGES:
        docs = materialize(stage(spark, docs, SF001), name)
    assert docs.count() == 0


def test_registry():
    names = [k for k in entry.queries() if k.startswith("op")]
    assert sorted(int(k[2:].split("_")[0]) for k in names) == list(range(1, 14))
    assert "pipeline" in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())
    assert np.isin(["op1_pii", "op2_nearest", "op5_quality_rules", "op6_source_mix", "op10_jaccard_join", "op12_centroids", "op13_codebooks"], list(entry.oracle_sql())).all()


def test_stage_links_at_five_words_and_four_fifths(spark):
    rule = Rule(shingle=5, num=80)
    rng = random.Random(11)
    w = [f"w{i}" for i in range(100)]
    texts = [" ".join(w), " ".join([*w[:30], "x", *w[31:60], "y", *w[61:]])]  # 86/106 on five words, 92/104 on three
    texts += near_copies(rng, 60, 150, 6) + near_copies(rng, 30, 400, 20) + near_copies(rng, 20, 12, 1)
    texts += ["a b c d", "A b  c d", "a b c", "d c b a", "a b c d e", "a b c d e f", ""]
    for n in (24, 44, 64):  # at and around the threshold
        t = [f"t{n}x{i}" for i in range(n)]
        texts += [" ".join(t), " ".join(t[:-n // 5]), " ".join(t[:-4]), " ".join(t[:-5]), " ".join(t[3:] + ["q", "r"])]
    rows = list(enumerate(texts))
    sets = [{tuple(x)} if 0 < len(x) < 5 else {tuple(x[i:i + 5]) for i in range(len(x) - 4)} for x in (t.lower().split() for t in texts)]
    forest = Forest(len(sets))
    for a, s in enumerate(sets):
        for b, t in enumerate(sets[:a]):
            if s & t and 100 * len(s & t) >= 80 * len(s | t):
                forest.join(a, b)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(docs, rule=rule).collect())
    assert got == [(i, len(s), forest.find(i)) for i, s in enumerate(sets)]
    kept = {r.doc_id for r in dict(C.STAGES)["jaccard_join"](spark, docs, SF001).collect()}
    assert kept == {i for i in range(len(sets)) if forest.find(i) == i} and 1 not in kept
