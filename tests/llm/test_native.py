"""PII, quality rules and mixing against plain Python versions, on odd and given rows."""

from __future__ import annotations

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from mixtext.llm.common import read
from mixtext.llm.mixing import boundary, mix, mixed
from mixtext.llm.pii import BASE, personal_data, redact
from mixtext.llm.quality_rules import quality
SF001 = "/root/testdata/sf0.001"
from tests.llm import odd

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_pii(text: str) -> list[tuple[str, int, int]]:
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(x) <= 255 for x in m.group().split("."))]
    for kind, pattern, low, high, ok in (("card", r"[0-9]([\x20-]?[0-9])+", 13, 19, luhn),
                                         ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15, lambda d: True)):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            if low <= len(d) <= high and ok(d):
                out.append((kind, *m.span()))
    return out


EDGES = ["a@b.c@d.e", "a@b.com_x@d.e", "@x.y a@b", "1.2.3.4.5.6.7.8 01.002.3.4", "5 - 1234 4111-1111 1111-1111",
         "12  4111111111111111", "4111111111111111" * 2, "+1-2-3-4-5-6-7-8-9- +", "++123456789", "a" * 50_000 + "@", "1." * 20_000]


def test_pii_matches_plain_regexes(spark):
    given = [r.text for r in read(spark, SF001, "documents").select("text").collect()]
    texts = given + [t or "" for t in odd.TEXTS] + EDGES
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in personal_data(df).collect():
        got = [(s.kind, s.start, s.end) for s in r.pii if s.kind in BASE]
        assert got == base_pii(r.text), r.text[:80]


def test_pii_added_kind_scores_and_odd_rows(spark):
    got = personal_data(odd.frame(spark)).collect()
    assert len(got) == len(odd.rows())
    iban = [s for r in got for s in r.pii if s.kind == "iban"]
    assert [(s.start, s.end, s.score) for s in iban] == [(5, 27, 100)]  # checksum holds once, the word before it counts
    assert all(r.pii == [] for r in got if not r.text)
    assert personal_data(odd.empty(spark)).count() == 0
    text = "mail a@b.co and 1.2.3.4 or 9"
    out = redact(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.text for r in out] == ["mail <EMAIL> and <IP> or 9", None]


def plain_quality(text):
    w = WORD.findall(text or "")
    grams = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def test_quality_matches_plain_python(spark):
    df = read(spark, SF001, "documents").select("doc_id", "text").unionByName(odd.frame(spark).select("doc_id", "text"))
    for r in quality(df).collect():
        n_words, chars, symbols, dups, repeats = plain_quality(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n_words, chars, symbols, dups, repeats)
        assert r.base_failed == (n_words < 10 or 100 * repeats > 20 * n_words)
        assert r.kept == (not r.base_failed and r.failed_rules == "")
    assert quality(odd.empty(spark)).count() == 0


def test_quality_keeps_clean_and_drops_junk(spark):
    labels = read(spark, "/root/testdata/sf0.01", "labels")
    got = quality(read(spark, "/root/testdata/sf0.01", "documents")).join(labels, "doc_id").where("n_words >= 10")
    share = {r.quality: r.k for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert share[1] > 0.97 and share[0] < 0.1


def plain_targets(sizes: dict) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    total, full = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in full]
        left = total - sum(full.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return {**full, **share}
        full.update({s: 3.0 * sizes[s] for s in over})


@pytest.mark.parametrize("spread", [[50, 1, 1, 1], [1, 1, 1, 200, 3, 9], [4, 4, 4]])
def test_mix_hits_its_targets(spark, spread):
    rows = [(i * 31 + k, "w " * (1 + (k * 7) % 5), None if s == 0 else f"s{s}") for s, n in enumerate(spread) for i, k in ((s, j) for j in range(20 * n))]
    df = spark.createDataFrame([(j, t, s) for j, (_, t, s) in enumerate(rows)], "doc_id long, text string, source string")
    got = mix(df).collect()
    sizes = Counter()
    for r in got:
        sizes[r.source] += r.size
    want, taken = plain_targets(sizes), Counter()
    for r in got:
        assert r.taken % max(r.size, 1) == 0 and 0 <= r.taken <= 3 * r.size and r.source_size == sizes[r.source]
        assert abs(r.target - want[r.source]) < 1e-6 * max(want[r.source], 1)
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 5  # one document
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mix(df).collect()), key=str)


def test_mix_tells_rows_of_one_id_apart(spark):
    rows = [(7, f"w{j} and more", "one") for j in range(300)] + [(1000 + j, "a b c", "two") for j in range(100)]
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == len(rows)
    for source in ("one", "two"):
        mine = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 3  # one document


def test_boundary_equals_a_running_sum(spark):
    cells = [(s, b * step, 1 + (b * 7) % 5) for s, step in ((None, 1), ("x", 97), ("y", 255)) for b in range(300)]
    budgets = {None: 411.0, "x": 0.0, "y": 10_000.0}
    df = spark.createDataFrame([(s, budgets[s], b, w) for s, b, w in cells], "source string, budget double, coarse int, words long")
    got = {r.source: (r.coarse, r.left, r.words) for r in boundary(df, "coarse").collect()}
    want = {}
    for s, budget in budgets.items():
        left = budget
        for b, w in sorted((b, w) for t, b, w in cells if t == s):
            if w > left:
                want[s] = (b, left, w)
                break
            left -= w
    assert got == want and set(want) == {None, "x"}


def test_mix_odd_rows(spark):
    got = mix(odd.frame(spark)).collect()
    assert len(got) == len(odd.rows()) and all(r.taken <= 3 * r.size for r in got)
    assert mix(odd.empty(spark)).count() == 0
    nothing = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in mix(nothing).collect()] == [(0, 0.0, 0)] * 2
    out = mixed(odd.frame(spark))
    assert out.columns == odd.frame(spark).columns
    copies = Counter((r.doc_id, r.text) for r in out.collect())
    expected = Counter()
    for r in mix(odd.frame(spark)).collect():
        expected[r.doc_id] += r.copies
    assert Counter({i: n for i, n in expected.items() if n}) == Counter(i for i, _ in copies.elements())
