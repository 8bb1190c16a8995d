"""Piece sampling against the enumeration of all segmentations, and the model's own codec."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mixtext.llm import piece_sampling as P
from mixtext.llm.common import read, tokenizer_file
SF001 = "/root/testdata/sf0.001"
from tests.llm import odd


@pytest.fixture(scope="module")
def lattices():
    return P.Lattices(tokenizer_file("piece_bpe_32k.model"))


def every_path(lat, text):
    """{pieces: probability} by plain recursion over the pieces of the whole text."""
    shown = P.SPACE + text.replace(" ", P.SPACE)
    out = {}

    def go(at, ids, log):
        if at == len(shown):
            out[tuple(ids)] = log
            return
        for j in range(at + 1, min(len(shown), at + lat.longest) + 1):
            if shown[at:j] in lat.ids:
                go(j, [*ids, lat.ids[shown[at:j]]], log + lat.logs[shown[at:j]])
        if shown[at] not in lat.ids:
            spelt = [lat.byte[b] for b in shown[at].encode()]
            go(at + 1, ids + spelt, log + lat.byte_log * len(spelt))

    go(0, [], 0.0)
    top = max(out.values())
    total = sum(math.exp(x - top) for x in out.values())
    return {k: math.exp(x - top) / total for k, x in out.items()}


def test_samples_follow_the_lattice(lattices):
    text, n, k = "the x\nab,", 6000, 3
    prob = every_path(lattices, text)
    first, second, included = Counter(), Counter(), Counter()
    for a in range(0, n, 500):
        for row in P.encode_group(lattices, [text] * 500, np.arange(a, a + 500).astype(np.uint64), k):
            got = [tuple(np.frombuffer(s["ids"], "<u2").tolist()) for s in row["samples"]]
            values = [s["perturbed"] for s in row["samples"]]
            assert len(set(got)) == k and values == sorted(values, reverse=True)
            for g, s in zip(got, row["samples"], strict=True):
                assert abs(s["log_prob"] - math.log(prob[g])) < 1e-6
                included[g] += math.exp(-s["log_inclusion"])
            first[got[0]] += 1
            second[got[0], got[1]] += 1
    for g in sorted(prob, key=prob.get, reverse=True)[:3]:
        spread = 5 * math.sqrt(prob[g] / n) + 1e-3
        assert abs(first[g] / n - prob[g]) < spread
        for h in sorted(prob, key=prob.get, reverse=True)[:3]:
            if h != g:
                p = prob[g] * prob[h] / (1 - prob[g])
                assert abs(second[g, h] / n - p) < 5 * math.sqrt(p / n) + 1e-3
    top = max(prob, key=prob.get)
    assert abs(included[top] / n - 1) < 0.02  # inverse inclusion weights are unbiased


def test_few_segmentations_are_all_given(lattices):
    row = P.encode_group(lattices, ["x"], np.array([4], np.uint64), 50)[0]
    prob = every_path(lattices, "x")
    got = {tuple(np.frombuffer(s["ids"], "<u2").tolist()): s for s in row["samples"]}
    assert set(got) == set(prob) and all(s["log_inclusion"] == 0 for s in got.values())


def test_codec_and_reruns(spark, lattices):
    model = tokenizer_file("piece_bpe_32k.model")
    docs = read(spark, SF001, "documents").select("doc_id", "text").unionByName(odd.frame(spark).select("doc_id", "text"))
    out = P.pieces(docs, model, k=3).withColumn("back", P.decoded(F.col("pieces.ids"), model))
    rows = out.collect()
    sp = lattices.model
    for r in rows:
        ids = np.frombuffer(r.pieces.ids, "<u2").tolist()
        text = r.text or ""
        assert ids == sp.encode(text) and r.back == sp.decode(ids)
        assert r.pieces.round_trip == (r.back == text) and (r.pieces.round_trip or P.SPACE in text)
        drawn = [tuple(np.frombuffer(s.ids, "<u2").tolist()) for s in r.pieces.samples]
        assert len(set(drawn)) == len(drawn) and (len(drawn) == 3 or not text.strip() or len(text) < 4)
        assert all(sp.decode(list(d)) == r.back for d in drawn)
    again = P.pieces(docs.repartition(7, "text"), model, k=3).collect()
    assert sorted(map(str, ((r.doc_id, r.pieces) for r in rows))) == sorted(map(str, ((r.doc_id, r.pieces) for r in again)))
    assert P.pieces(odd.empty(spark), model).count() == 0


def test_words_are_not_learned_again_while_the_cache_has_room():
    """Three million edges of words fit the cache; single characters are found without a search."""
    assert P.CACHE_EDGES >= 3_000_000
    lat = P.Lattices(tokenizer_file("piece_bpe_32k.model"))
    for c in map(chr, (*range(32, 700), 0x2581, 0x10FFFF)):
        at = lat.alone[ord(c)]
        assert (at >= 0) == (lat._hash(c) in set(lat.starts[[at]].tolist())) and (at < 0 or lat.start_piece[at] == lat.ids.get(c, -1))
        if at < 0:
            assert c not in lat.ids


def test_a_full_cache_keeps_the_words_met_most(lattices):
    """Half the words are met again and stay when the cache is trimmed, in place; encodings and
    samples of kept, dropped and byte-spelt words are those of lattices that were never trimmed."""
    lat = P.Lattices(tokenizer_file("piece_bpe_32k.model"))
    texts = ["".join(f" often{i} \u4e16\U0001F600{i}," for i in range(300)), "".join(f" rarely{i}\n" for i in range(300))]
    for text in (texts[0], texts[1], texts[0]):
        lat.numbers(pa.array([text]))
    arrays = [x.data for x in (lat.log, lat.upto, lat.size, lat.code)]
    before, often = lat.log.n, [w for w in lat.number if "often" in w]
    lat.trim(before * 2 // 3)
    assert lat.log.n <= before * 2 // 3 and set(often) <= set(lat.number) and len(often) == 300
    assert not all(f"{P.SPACE}rarely{i}" in lat.number for i in range(300))
    seeds = np.arange(2).astype(np.uint64)
    assert P.encode_group(lat, texts, seeds, 3) == P.encode_group(lattices, texts, seeds, 3)
    assert all(x.data is y for x, y in zip((lat.log, lat.upto, lat.size, lat.code), arrays, strict=True))
    lat.trim(0)
    assert not lat.number and lat.log.n == lat.edges.n == lat.pieces.n == 0
    assert P.encode_group(lat, texts, seeds, 3) == P.encode_group(lattices, texts, seeds, 3)


def test_words_encoded_together_are_encoded_alone(lattices):
    """Words joined by line ends get the ids and the fit that each has by itself."""
    words = [f"{P.SPACE * (i % 3)}w{chr(0x4e00 + i)}{'ab' * (i % 5)}" for i in range(300)] + [P.SPACE * 2]
    lat = P.Lattices(tokenizer_file("piece_bpe_32k.model"))
    lat.learn(words)
    for i, w in enumerate(words):
        shown = w.replace(P.SPACE, " ")
        assert lat.encoded(np.array([i])).tolist() == lat.model.encode("\n" + shown)[2:]
        assert lat.fits.data[i] == (lat.model.decode(lat.model.encode("\n" + shown)) == "\n" + shown)
    lat.learn(["\n"])
    assert lat.encoded(np.array([len(words)])).tolist() == lat.model.encode("\n\n")[2:]


def test_spare_workers_hold_less_and_give_the_same_rows(spark, monkeypatch):
    """With ``spare`` (the pipeline's stage) the cache, its room and the texts cut together are
    at most a third, and freed memory is handed back; the rows are those of the full cache, also
    where every cut trims it."""
    import corpus_pipeline

    assert 3 * P.SPARE_EDGES <= P.CACHE_EDGES and 3 * P.SPARE_CUT <= P.CUT_BYTES
    model = tokenizer_file("piece_bpe_32k.model")
    lat = P.Lattices(model, cache=P.SPARE_EDGES)
    assert all(len(x.data) <= 3 * P.SPARE_EDGES // 2 for x in (lat.log, lat.upto, lat.size, lat.code))
    texts = [f"the word{i} and word{i % 7},\nagain {'abc' * (i % 5)} \u4e16{i}" for i in range(60)] + ["", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    want = sorted(map(str, P.pieces(docs, model).collect()))
    monkeypatch.setattr(P, "SPARE_EDGES", 300)
    monkeypatch.setattr(P, "SPARE_CUT", 200)
    assert sorted(map(str, P.pieces(docs, model, spare=True).collect())) == want
    seen = []
    monkeypatch.setattr(corpus_pipeline, "pieces", lambda *a, **b: seen.append(b) or P.pieces(*a, **b))
    assert corpus_pipeline.encode(spark, docs, "").count() == len(texts) and seen == [{"spare": True}]
