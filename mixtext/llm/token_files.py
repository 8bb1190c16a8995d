"""Token-ID files: flat unsigned integers, 64-bit document offsets, memory-mapped reads.

Layout of a token set (one triple of files per range partition, in doc_id order)::

    part-<n>-<attempt>.bin   token ids, little-endian uint16 (uint32 above 65,536 ids)
    part-<n>-<attempt>.idx   int64: n_docs + 1 offsets into the .bin file, in ids
    part-<n>-<attempt>.key   int64: doc_id of each document (null ids stand first)

The manifest (a Parquet table beside them) names the files of the attempt that Spark
committed, so a retried or speculative task leaves at most unreferenced files. A partition's
base is the prefix sum of the id counts before it: no partition waits for another.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from functools import partial
from itertools import chain
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mixtext.llm.common import Growing, per_worker, portions, strings, utf8
from mixtext.session import scratch_path

CACHE_WORDS = 400_000  # distinct runs and words whose ids a worker keeps; then the cache starts anew
CACHE_IDS = 4_000_000  # likewise for their ids
ENCODE_BYTES = 4 << 20  # of texts encoded together
READ_DOCS = 8192  # documents per batch when reading back

# The rules under which words are encoded on their own.
PARTING = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}

MANIFEST = T.StructType([
    T.StructField("part", T.IntegerType()),
    T.StructField("file", T.StringType()),
    T.StructField("dtype", T.StringType()),
    T.StructField("n_docs", T.LongType()),
    T.StructField("n_ids", T.LongType()),
    T.StructField("n_null_keys", T.LongType()),
])


class WordEncoder:
    """Texts to ids, word by word where the tokenizer's rules allow it, whole otherwise.

    By the rules PARTING the ids of a text are the ids of its white-space separated words, one
    after the other; a run of Latin letters is parted from the marks behind it, and its ids do
    not depend on its case. Words are split and made distinct in Arrow, so that Python sees
    each distinct word of a batch once; many new letter runs are encoded in one call: every
    run's last id, and no other, is a word-end token. Other words are encoded one by one.
    A tokenizer with other rules encodes whole texts.
    """

    MARKS = ".,!?;:#*$%&|"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        self.ends = np.zeros(size, dtype=bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t.endswith("</w>")]] = True
        self.parting = self._parts(json.loads(self.tokenizer.to_str()))
        self.reset()

    @staticmethod
    def _parts(rules: dict) -> bool:
        """Whether words can be encoded on their own, by the tokenizer's stated rules."""
        added = [t["content"] for t in rules["added_tokens"]]
        return rules["normalizer"] == PARTING["normalizer"] and rules["pre_tokenizer"] == PARTING["pre_tokenizer"] \
            and rules["post_processor"] is None and rules["model"]["end_of_word_suffix"] == "</w>" \
            and not any(t.rstrip(WordEncoder.MARKS) != t or t.isalpha() or any(c.isspace() for c in t) for t in added)

    def reset(self) -> None:
        self.number: dict[str, int] = {"": 0}  # letter runs, marks and other words met so far
        self.ids = Growing(self.dtype)
        self.stop = Growing(np.int64)
        self.stop.extend([0, 0])

    def _add(self, words: list[str], ids: np.ndarray, lens: np.ndarray) -> None:
        self.number.update(zip(words, range(len(self.number), len(self.number) + len(words)), strict=True))
        self.stop.extend(self.ids.n + np.cumsum(lens))
        self.ids.extend(ids)

    def _one_by_one(self, words: list[str]) -> None:
        for start in range(0, len(words), 4096):
            some = words[start:start + 4096]
            got = [e.ids for e in self.batch(some, add_special_tokens=False)]
            lens = np.fromiter(map(len, got), np.int64, len(got))
            self._add(some, np.fromiter(chain.from_iterable(got), np.int64, int(lens.sum())), lens)

    def _learn_runs(self, runs: list[str]) -> None:
        for start in range(0, len(runs), 4096):
            some = runs[start:start + 4096]
            ids = np.array(self.batch([" ".join(some)], add_special_tokens=False)[0].ids)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(some) or stops[-1] != len(ids):
                self._one_by_one(some)
            else:
                self._add(some, ids, np.diff(stops, prepend=0))

    def _numbers(self, words: list[str], learn) -> np.ndarray:
        learn(list(dict.fromkeys(w for w in words if w not in self.number)))
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))

    def _words(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the letter run, or of the whole word, and of the marks of each word."""
        letters = pc.ascii_rtrim(distinct, characters=self.MARKS)
        is_run = pc.and_(pc.utf8_is_alpha(letters), pc.invert(pc.match_substring_regex(letters, "[^\\x00-\u024f]|\u0130"))).to_numpy(zero_copy_only=False)
        first, second = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        runs = pc.utf8_lower(letters.filter(pa.array(is_run))).dictionary_encode()
        first[is_run] = self._numbers(strings(runs.dictionary, " "), self._learn_runs)[runs.indices.to_numpy(zero_copy_only=False)]
        cut = pc.binary_length(letters).to_numpy(zero_copy_only=False)
        marked = is_run & (pc.binary_length(distinct).to_numpy(zero_copy_only=False) > cut)
        tails = [w.encode()[n:].decode() for w, n in zip(strings(distinct.filter(pa.array(marked)), " "), cut[marked].tolist(), strict=True)]
        second[marked] = self._numbers(tails, self._one_by_one)
        first[~is_run] = self._numbers(strings(distinct.filter(pa.array(~is_run)), " "), self._one_by_one)
        return first, second

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (null: none) one after another, and how many each has."""
        if not self.parting:
            got = [e.ids for e in self.batch([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
            lens = np.fromiter(map(len, got), np.int64, len(got))
            return np.fromiter(chain.from_iterable(got), self.dtype, int(lens.sum())), lens
        if self.ids.n > CACHE_IDS or len(self.number) > CACHE_WORDS:
            self.reset()
        split = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
        flat = pc.cast(split.flatten(), pa.large_string()).dictionary_encode()
        index = flat.indices.to_numpy(zero_copy_only=False)
        first, second = self._words(flat.dictionary)
        number = np.stack([first[index], second[index]], axis=1).ravel()
        begin = self.stop.data[number]
        size = self.stop.data[number + 1] - begin
        upto = np.cumsum(size)
        ids = self.ids.data[np.repeat(begin - upto + size, size) + np.arange(int(size.sum()))]
        ends = np.concatenate([[0], upto])[2 * (split.offsets.to_numpy() - split.offsets[0].as_py())]
        return ids, np.diff(ends)


def encoder(path: str) -> WordEncoder:
    """One encoder per worker process and vocabulary file."""
    return per_worker(f"encoder:{path}", partial(WordEncoder, path))


def _store(uri: str):
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), urlparse(uri).path
    return fs.FileSystem.from_uri(uri)


def write_token_files(docs: DataFrame, out_dir: str, tokenizer: str, end_id: int = 1,
                      id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode ``docs`` and write the token set under ``out_dir``; returns its manifest.

    Documents are dealt by range of (id, hash of the text), so neither a hot id nor a hot
    text gathers in one task. Null text encodes as the end id alone; null ids come first;
    repeated ids are kept and ordered by the hash of their text; an empty table gives an
    empty manifest. Other columns are ignored.
    """
    store, folder = _store(out_dir)
    store.create_dir(folder, recursive=True)
    keyed = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t"), F.xxhash64(F.col(text_col)).alias("h"))
    order = [F.col("k").asc_nulls_first(), F.col("h")]
    ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("k", "t")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        enc = encoder(tokenizer)
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        fs_, root = _store(out_dir)
        n_docs = n_ids = n_null = 0
        with fs_.open_output_stream(f"{root}/{name}.bin") as ids, \
                fs_.open_output_stream(f"{root}/{name}.idx") as idx, \
                fs_.open_output_stream(f"{root}/{name}.key") as keys:
            idx.write(np.zeros(1, dtype="<i8").tobytes())

            def flush(some: pa.Array) -> None:
                nonlocal n_ids, n_docs
                got, lens = enc.encode(some)
                ends = np.cumsum(lens + 1)
                whole = np.full(int(ends[-1]), end_id, enc.dtype)
                is_id = np.ones(len(whole), bool)
                is_id[ends - 1] = False
                whole[is_id] = got
                ids.write(whole.tobytes())
                idx.write((n_ids + ends).astype("<i8").tobytes())
                n_ids, n_docs = n_ids + len(whole), n_docs + len(some)

            def all_batches():
                yield first
                yield from batches

            for b in all_batches():
                if not b.num_rows:
                    continue
                n_null += b.column(0).null_count
                keys.write(np.asarray(b.column(0).fill_null(0).to_numpy(zero_copy_only=False), dtype="<i8").tobytes())
                t = utf8(b.column(1))
                sizes = pc.fill_null(pc.binary_length(t), 0).to_numpy(zero_copy_only=False)
                for x, y in portions(sizes, ENCODE_BYTES):
                    flush(t[x:y])
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([part], pa.int32()), "file": [name], "dtype": [enc.dtype.str],
            "n_docs": pa.array([n_docs], pa.int64()), "n_ids": pa.array([n_ids], pa.int64()),
            "n_null_keys": pa.array([n_null], pa.int64())})

    spark = docs.sparkSession
    manifest = f"{out_dir.rstrip('/')}/manifest"
    ranged.mapInArrow(write, MANIFEST).write.mode("error").parquet(manifest)
    return spark.read.schema(MANIFEST).parquet(manifest)


def with_bases(manifest: DataFrame) -> DataFrame:
    """The manifest with each partition's base: ids in all partitions before it (the window
    holds one row per written partition, not per document)."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long")))


def read_part(out_dir: str, file: str, dtype: str, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, offsets, keys) of one partition; mapped into memory where the store is a file
    system, read by range otherwise."""
    store, root = _store(out_dir)
    from pyarrow import fs

    def load(suffix: str, kind: str) -> np.ndarray:
        path = f"{root}/{file}.{suffix}"
        if isinstance(store, fs.LocalFileSystem):
            return np.memmap(path, dtype=kind, mode="r") if os.path.getsize(path) else np.empty(0, kind)
        with store.open_input_file(path) as f:
            return np.frombuffer(f.read(), dtype=kind)

    return load("bin", dtype), load("idx", "<i8"), load("key", "<i8")


def read_token_files(spark: SparkSession, out_dir: str, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row per document, from the files alone: doc_id, start (ids of all documents
    before it), n_tokens, ids_crc32 (of the ids as little-endian uint32) and, with
    ``with_ids``, the ids themselves."""
    manifest = with_bases(spark.read.schema(MANIFEST).parquet(f"{out_dir.rstrip('/')}/manifest"))
    parts = max(spark.sparkContext.defaultParallelism, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    schema = T.StructType([T.StructField(id_col, T.LongType()), T.StructField("start", T.LongType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.LongType()))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                ids, offsets, keys = read_part(out_dir, row["file"], row["dtype"], row["n_docs"])
                for a in range(0, row["n_docs"], READ_DOCS):
                    z = min(a + READ_DOCS, row["n_docs"])
                    at = np.asarray(offsets[a:z + 1])
                    each = [np.asarray(ids[x:y]).astype("<u4") for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                    out = {
                        id_col: pa.array(np.asarray(keys[a:z]), pa.int64(), mask=np.arange(a, z) < row["n_null_keys"]),
                        "start": pa.array(at[:-1] + row["base"], pa.int64()),
                        "n_tokens": pa.array(np.diff(at), pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(e) for e in each], pa.int64()),
                    }
                    if with_ids:
                        out["ids"] = pa.array([e.astype("i8") for e in each], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_pydict(out)

    return manifest.repartition(parts).mapInArrow(load, schema)


def token_files(docs: DataFrame, tokenizer: str, out_dir: str | None = None, end_id: int = 1) -> DataFrame:
    """Write ``docs`` as a token set (by default in the shared scratch folder) and read it back."""
    spark = docs.sparkSession
    out_dir = out_dir or scratch_path(spark, "token-files")
    write_token_files(docs, out_dir, tokenizer, end_id)
    return read_token_files(spark, out_dir)
