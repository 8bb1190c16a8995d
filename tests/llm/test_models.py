"""Language ID and toxicity: held-out accuracy, folds and odd rows."""

from __future__ import annotations

import binascii
import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from mixtext.llm import language_id, toxicity
from mixtext.llm.common import held_out, read
from tests.llm import odd

SF01 = "/root/testdata/sf0.01"


def test_fold_is_crc32_of_the_id_text(spark):
    got = spark.range(50).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (binascii.crc32(str(r.id).encode()) % 5 == 0) for r in got)
    assert spark.sql("SELECT cast(null AS bigint) AS id").select(held_out(F.col("id"))).first()[0] is True


def test_language_held_out_accuracy_and_odd_rows(spark):
    docs = read(spark, SF01, "documents")
    model = language_id.fit(docs)
    got = language_id.language(docs, model).select("lang", "lang_pred", "score", language_id.fold()).collect()
    out = [r for r in got if r.held_out]
    assert len(out) > 100 and np.mean([r.lang == r.lang_pred for r in out]) > 0.98
    assert all(0 <= r.score <= 1 and r.lang_pred in model.langs for r in got)
    strange = language_id.language(odd.frame(spark), model)
    assert set(strange.columns) == {*odd.frame(spark).columns, "lang_pred"}  # score is replaced
    pairs = {(r.text, r.lang_pred, r.score) for r in strange.collect()}
    assert all((p == "und") == (not any(c.isalpha() for c in (t or ""))) for t, p, _ in pairs)
    assert len(pairs) == len(set(odd.TEXTS))  # equal texts, equal answers
    none = language_id.fit(odd.empty(spark))
    assert {r.lang_pred for r in language_id.language(odd.frame(spark), none).collect()} == {"und"}
    assert language_id.language(odd.empty(spark), model).count() == 0


def test_language_fit_starts_no_python_on_the_executors(spark, monkeypatch):
    """The table of cuts is made by the driver alone; rows given as a list are read by Python workers."""
    plans = []
    whole = language_id.F.broadcast
    monkeypatch.setattr(language_id.F, "broadcast", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or whole(df))
    rows = [(i, f"word{i % 3} text", "en" if i % 2 else "de") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language_id.fit(docs).langs == ["de", "en"]
    assert len(plans) == 1 and "ExistingRDD" not in plans[0]


def test_language_backs_off_to_the_longest_known_gram(spark):
    rows = [(i, t, x) for i, (t, x) in enumerate([("abcde abcde xyz", "a"), ("fghij fghij xyw", "b")] * 6)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    scorer = language_id.Scorer(model)
    known = dict(zip(model.grams, model.gram_logs, strict=True))
    assert np.allclose(scorer.backoff("zabcd"), np.mean([known["abcd"]], axis=0))  # no 5-gram of ^zabcd$ is known
    assert scorer.predict("zabcd")[0] == "a" and scorer.predict("hij")[0] == "b"


def test_language_scores_match_a_plain_scorer(spark):
    given = read(spark, SF01, "documents").limit(300).select("doc_id", "text", "lang").collect()
    model = language_id.fit(spark.createDataFrame(given))
    learnt = [r for r in given if binascii.crc32(str(r.doc_id).encode()) % 5 and r.lang is not None]
    counts: dict = {"word": {}, "gram": {}}
    for r in learnt:
        for w in re.findall(r"[^\W\d_]+", (r.text or "").lower()):
            marked = f"^{w}$"
            counts["word"].setdefault(w, Counter())[r.lang] += 1
            for k in range(1, 6):
                for i in range(max(len(marked) - k + 1, 1)):
                    counts["gram"].setdefault(marked[i:i + k], Counter())[r.lang] += 1
    logs = {}
    for kind, seen in counts.items():
        seen = {key: {x: n for x, n in c.items() if n >= 2} for key, c in seen.items()}
        seen = {key: c for key, c in seen.items() if c}
        total = {x: sum(c.get(x, 0) for c in seen.values()) + 0.5 * len(seen) for x in model.langs}
        logs[kind] = {key: np.array([math.log((c.get(x, 0) + 0.5) / total[x]) for x in model.langs]) for key, c in seen.items()}
        logs[kind, None] = np.array([math.log(0.5 / total[x]) for x in model.langs])
    assert set(model.word.keys) == set(logs["word"]) and set(model.grams) == set(logs["gram"])

    def plain(word):
        if word in logs["word"]:
            return logs["word"][word]
        for k in range(5, 0, -1):
            found = [logs["gram"][g] for g in (f"^{word}$"[i:i + k] for i in range(len(word) + 3 - k)) if g in logs["gram"]]
            if found:
                return np.mean(found, axis=0)
        return logs["gram", None]

    scorer = language_id.Scorer(model)
    for r in given[:60]:
        words = re.findall(r"[^\W\d_]+", (r.text or "").lower())
        if words:
            total = np.sum([plain(w) for w in words], axis=0)
            best = int(total.argmax())
            share = 1 / np.exp((total - total[best]) / math.sqrt(len(words))).sum()
            got = scorer.predict(r.text)
            assert got[0] == model.langs[best] and abs(got[1] - share) < 1e-4


def test_every_language_is_learnt(spark):
    rows = [(1000 * x + i, f"qw{x}a er{x}b ty{x}c", f"l{x:03d}") for x in range(260) for i in range(3 if x else 900)]
    docs = spark.createDataFrame([(i, re.sub(r"\d", lambda m: "abcdefghij"[int(m[0])], t), x) for i, t, x in rows], "doc_id long, text string, lang string")
    model = language_id.fit(docs, rows_per_lang=20, min_count=1)
    got = language_id.language(docs, model).where("lang = lang_pred").select("lang").distinct().count()
    learnt = docs.where(~held_out(F.col("doc_id"))).select("lang").distinct().count()
    assert len(model.langs) == learnt == got > 200


def test_toxicity_held_out_and_odd_rows(spark):
    docs, labels = read(spark, "/root/testdata/sf0.1", "documents"), read(spark, "/root/testdata/sf0.1", "labels")
    model = toxicity.fit(docs, labels)
    got = toxicity.toxicity(docs.join(labels, "doc_id"), model).select("toxic", "score", "predicted", held_out(F.col("doc_id")).alias("h")).collect()
    out = [r for r in got if r.h]
    assert np.mean([r.predicted for r in out if r.toxic == 1]) > 0.8
    assert np.mean([r.predicted for r in out if r.toxic == 0]) < 0.03
    strange = toxicity.toxicity(odd.frame(spark), model).collect()
    assert len(strange) == len(odd.rows()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in strange)
    assert {r.predicted for r in strange} == {0}
    bare = toxicity.fit(odd.frame(spark), labels.limit(0))
    said = toxicity.toxicity(spark.createDataFrame([(1, "you idiot"), (2, "a fine day"), (3, None)], "doc_id long, text string"), bare)
    assert [r.predicted for r in said.orderBy("doc_id").collect()] == [1, 0, 0]


def test_label_model_recovers_voters():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.2
    accuracy = [0.95, 0.9, 0.85, 0.7]
    v = np.stack([np.where((rng.random(4000) < a) == y, 1, -1) for a in accuracy], axis=1)
    v = np.concatenate([v, v[:, 3:], v[:, 3:]], axis=1)  # copies of the weakest voter
    post, table = toxicity.label_model(v, 0.2)
    assert np.mean((post > 0.5) == y) > 0.93
    assert np.allclose(table[1, :4, 2], accuracy, atol=0.06)


def test_terms_agree_with_found_terms():
    text = "abcdef abcxyz abcq réeuxa réeuxb réeux idiot"
    names = sorted(toxicity.found_terms(text))
    assert "abc*3" in names and "abc*4" not in names and "réeux*3" in names
    assert toxicity.Terms(names).hits(text) == set(range(len(names)))
    assert toxicity.Terms(["zzz*1", "idiot"]).hits(text) == {1}
