"""License scans against a plain search for phrases and against every possible place of a notice."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from mixtext.llm import licenses as L
from mixtext.llm.common import read
from mixtext.llm.queries import op11_licenses
from tests.llm import odd

SF01 = "/root/testdata/sf0.01"
MIT = next(t for label, _, t in L.NOTICES if label == "mit")
GPL = next(t for label, _, t in L.NOTICES if label == "gpl")
BSD3 = next(t for label, _, t in L.NOTICES if label == "bsd-3-clause")

TEXTS = [
    "Released under the MIT License. Mit-license; MIT LICENSE", "cc by-nc 4.0 cc by cc by", "CC BY-NC-SA", "cc by", "ccby cc b y",
    "gnu general public gnu general public license version 3", "éapache license, apache\nlicense", "the unlicense",
    "Copyright (c) 2020 A B " + MIT, MIT.replace("substantial", "notable or otherwise substantial"), MIT[:300],
    "words before " * 500 + GPL + "words after " * 300 + MIT + MIT, BSD3.replace("the copyright holder", "Some University of Anywhere and its Regents"),
    "permission is hereby granted free of charge " + "x " * 200 + "the software is provided as is",
    "SPDX-License-Identifier: Apache-2.0", GPL.replace("either version 3", "either version 2"),
    " ".join(reversed(MIT.split())), "İstanbul MİT LICENSE K license apache license",
]


def plain_words(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))


def plain_places(words: list[str], phrase: str) -> list[int]:
    p = phrase.split()
    return [i for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p]


def everywhere(index: L.Index, text: str) -> set[str]:
    """Labels of phrases and notices, tried at every place."""
    words = L.words_of(text.encode())
    out = set()
    for e, entry in enumerate(index.entries):
        if entry.keys:
            out |= {entry.label for s in range(-L.SHIFT, len(words)) if index.verified(e, words, s)[1]}
        elif plain_places([w.decode() for w in words], b" ".join(entry.words).decode()):
            out.add(entry.label)
    return out


def test_places_and_labels_match_a_search_of_every_place(spark):
    given = [r.text for r in read(spark, SF01, "documents").select("text").collect()]
    docs = spark.createDataFrame(list(enumerate(given + TEXTS + [t or "" for t in odd.TEXTS])), "doc_id long, text string")
    index = L.build(docs)
    for r in L.licenses(docs, index).collect():
        words = plain_words(r.text)
        assert r.licenses.n_words == len(words)
        want = sorted((i, label) for phrase, label in L.BASE for i in plain_places(words, phrase))
        assert sorted((p.start, p.label) for p in r.licenses.places if p.base) == want, r.text[:80]
        if r.doc_id >= len(given) or "icense" in r.text:
            assert {p.label for p in r.licenses.places} == everywhere(index, r.text), r.text[:80]
        assert all(0 <= p.score <= 1 for p in r.licenses.places)


def test_notices_are_found_filled_in_edited_and_repeated(spark):
    index = L.build(spark.createDataFrame([(t,) for t in TEXTS], "text string"))

    def notices(text):
        return [label for label, base, _, n, _ in index.scan(text.encode())[1] if n > 20]

    assert notices(TEXTS[8]) == ["mit"] and notices(TEXTS[9]) == ["mit"] and notices(TEXTS[12]) == ["bsd-3-clause"]
    assert notices(TEXTS[11]) == ["gpl", "mit", "mit"] and notices(TEXTS[15]) == ["gpl"]
    assert notices(TEXTS[10]) == [] and notices(TEXTS[13]) == [] and notices(TEXTS[16]) == []
    starts = [s for _, _, s, n, _ in index.scan(TEXTS[11].encode())[1] if n > 20]
    assert starts[0] == 1000  # "words before" repeated 500 times


def test_weights_are_counted_over_all_documents(spark):
    docs = spark.createDataFrame([(t,) for t in ["mit mit x", "MIT y", None, "", "license"]] * 3, "text string").repartition(7)
    n, df = L.document_frequency(docs, frozenset({b"mit", b"license", b"gnu"}))
    assert n == 15 and df == {b"mit": 6, b"license": 3}


def test_odd_rows_and_empty_tables(spark):
    df = odd.frame(spark).withColumn("licenses", F.lit("clash"))
    got = L.licenses(df).collect()
    assert len(got) == len(odd.rows()) and all(r.licenses.n_words == 0 and r.licenses.places == [] for r in got if not r.text)
    assert L.licenses(odd.empty(spark)).collect() == []


def test_query_digest(spark):
    rows = {r.doc_id: r for r in op11_licenses(spark, SF01).collect()}
    docs = read(spark, SF01, "documents").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for d in docs:
        places = sorted((i, label) for phrase, label in L.BASE for i in plain_places(plain_words(d.text or ""), phrase))
        r = rows[d.doc_id]
        assert (r.n_base, r.first_word, r.last_word) == (len(places), places[0][0] if places else None, places[-1][0] if places else None)
        assert r.base_labels == ",".join(sorted({label for _, label in places}))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) or not r.base_labels
        assert (r.score > 0) == bool(r.labels)
