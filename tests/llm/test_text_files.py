"""Secret scans and token files against plain versions."""

from __future__ import annotations

import random
import re
import string
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from mixtext.llm.common import read, tokenizer_file
from mixtext.llm.secret_scan import Novelty, masked, scan, secrets
from mixtext.llm.token_files import WordEncoder, read_token_files, token_files, with_bases, write_token_files
from mixtext.session import scratch_path
SF001 = "/root/testdata/sf0.001"
from tests.llm import odd

KINDS = ("assign", "access", "hex")


def base_secrets(text: str) -> list[tuple[str, int, int]]:
    out = [("assign", *m.span()) for m in re.finditer(
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A) if len(m.group(2)) >= 8]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 32]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


EDGES = ["token=secret: abcdefghij", "secret=short", "API_KEY: 'abcd.efgh='", "ſecret=abcdefghij", "AKIAAKIAAKIAAKIAA AKIA1234", "f" * 31 + " " + "0" * 33,
         "password==abcdefgh", "token = secret=abcdefghijk"]


def test_base_spans_match_plain_regexes(spark):
    texts = [r.text for r in read(spark, SF001, "documents").collect()] + [t or "" for t in odd.TEXTS] + EDGES
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secrets(df).collect():
        assert [(s.kind, s.start, s.end) for s in r.secrets if s.kind != "novel"] == base_secrets(r.text), r.text[:80]
    assert secrets(odd.empty(spark)).count() == 0


def test_novelty_reports_random_strings_in_context_only():
    rng, novelty = random.Random(3), Novelty()
    for size in (20, 32, 40):
        value = "".join(rng.choices(string.ascii_letters + string.digits, k=size))
        assert [s.kind for s in scan(f"the private key is {value} here", novelty)] == ["novel"]
        assert scan(f"the value is {value} here", novelty) == []
        # the same string in the surroundings is not new
        assert scan(f"{value} again {value}; the private key is {value} here", novelty) == []
    for clean in ("the private_key of the configuration_settings2", "credential path src/main/java/com/example/Service1 ok",
                  "token ring network of internationalization", "bearer of aaaaaaaaaaaaaaaaaaaaaaaa1"):
        assert scan(clean, novelty) == [], clean


def test_novelty_reaches_the_end_of_long_secrets(spark):
    rng, novelty = random.Random(4), Novelty()
    code = string.ascii_letters + string.digits + "+/"
    lines = ["".join(rng.choices(code, k=64)) for _ in range(25)] + ["".join(rng.choices(code, k=6)) + "=="]
    value = "".join(rng.choices(string.ascii_letters + string.digits, k=2000))
    begin, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    texts = [f"see below\n{begin}\n" + "\n".join(lines) + f"\n{end}\nthe text goes on",
             f"{begin}\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-256-CBC,00\n\n" + "\r\n".join(lines) + f"\r\n{end}",
             f'{{"private_key": "{begin}\\n' + "\\n".join(lines) + f'\\n{end}\\n"}}',
             "the private key\n" + "\n".join(lines[:-1]) + "\nwithout an end",
             f"the signature {value} of it", f"private_key = {value}"]
    df = secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = [r.text for r in df.withColumn("text", masked(F.col("text"), F.col("secrets"))).orderBy("doc_id").collect()]
    for i, text in enumerate(got):
        assert not any(x[k:k + 8] in text for x in [*lines, value] for k in range(0, len(x) - 7)), (i, text[:300])
    assert "the text goes on" in got[0] and "without an end" in got[3] and got[4] == "the signature <secret> of it"
    names = "\n".join(f"src/main/java/com/example/Service{i}/configuration_settings" for i in range(30))
    for clean in (f"credential paths\n{names}\nend", "the key\n" + "word " * 400, f"values\n{lines[0]}\n{lines[1]}"):
        assert scan(clean, novelty) == [], clean[:80]
    repeated = "keyabcdefgh12345" * 3000 + "\n"  # linear in the text
    scan(repeated, novelty)

def test_masking(spark):
    df = secrets(spark.createDataFrame([(1, 'é token = "abcdefgh12345" end'), (2, None), (3, "no")], "doc_id long, text string"))
    got = df.withColumn("text", masked(F.col("text"), F.col("secrets"))).orderBy("doc_id").collect()
    assert [r.text for r in got] == ['é <secret>" end', None, "no"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))


def plain_tokens(tokenizer, rows, end_id=1):
    at, out = 0, []
    for i, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [end_id]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_token_files_round_trip(spark, tokenizer):
    path = tokenizer_file("word_bpe_49k.json")
    given = [(r.doc_id, r.text) for r in read(spark, SF001, "documents").orderBy("doc_id").collect()]
    got = token_files(read(spark, SF001, "documents"), path).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == plain_tokens(tokenizer, given)


def test_token_files_odd_rows(spark, tokenizer):
    path, out = tokenizer_file("word_bpe_49k.json"), scratch_path(spark, "token-test")
    extra = ["<|endoftext|> a<|startoftext|>b", "á ́b Σας ΣΑΣ.", "Abc.,!? ÉTé; ABC### x|y ª.", "don't we'll 'S 12 ½", "a" * 20_000]
    df = odd.frame(spark).unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"), allowMissingColumns=True)
    manifest = write_token_files(df, out, path)
    assert set(manifest.columns) >= {"part", "file", "n_docs", "n_ids"} and with_bases(manifest).count() == manifest.count()
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32, r.ids) for r in read_token_files(spark, out, with_ids=True).collect()))
    assert len(got) == df.count() and got[0][1] is None
    assert [i for _, i, *_ in got[1:]] == sorted(i for _, i, *_ in got[1:])
    text = {r.doc_id: r.text for r in df.collect()}
    at = 0
    for start, i, n, crc, ids in got:
        want = tokenizer.encode(text[i] or "", add_special_tokens=False).ids + [1]
        assert (start, n, ids, crc) == (at, len(want), want, zlib.crc32(np.array(want, "<u4").tobytes()))
        at += n
    assert token_files(odd.empty(spark), path).count() == 0


def test_tokenizers_with_other_rules_encode_whole_texts(spark):
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    rows = [(i, t) for i, t in enumerate(odd.TEXTS + ["Keeps Case, and  spaces.\n", "<|endoftext|> x"]) if len(t or "") < 10_000]
    got = token_files(spark.createDataFrame(rows, "doc_id long, text string"), path, end_id=50256).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == plain_tokens(plain, rows, 50256)
    assert WordEncoder(tokenizer_file("word_bpe_49k.json")).parting and not WordEncoder(path).parting
