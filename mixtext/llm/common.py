"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words are maximal runs of anything but these characters (space, \t \n \v \f \r).
SPACE_CLASS = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE_CLASS}]+"
SPACES = rf"[{SPACE_CLASS}]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array, in order; null text: no words."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES, -1), "")


def held_out(doc_id: Column) -> Column:
    """The fold never learned from: crc32(doc_id as text) mod 5 = 0. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def texts(array: pa.Array) -> Iterator[str | None]:
    """Values of a string array one by one (no list of all texts beside the batch)."""
    for start in range(0, len(array), 256):
        yield from array.slice(start, 256).to_pylist()


def raw_texts(array: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of a string array one by one; null reads as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(array.type) else pa.binary()
    for start in range(0, len(array), 256):
        for value in array.slice(start, 256).cast(kind).to_pylist():
            yield value if value is not None else b""


def utf8(array: pa.Array) -> pa.Array:
    """The array with every value valid UTF-8 (Spark's strings need not be)."""
    try:
        array.validate(full=True)
    except pa.ArrowInvalid:
        return pa.array([None if v is None else v.decode("utf-8", "replace") for v in array.cast(pa.binary()).to_pylist()], pa.string())
    return array


def strings(array: pa.Array, mark: str) -> list[str]:
    """The values of a large_string array that hold no ``mark`` (much faster than to_pylist)."""
    if not len(array):
        return []
    whole = pa.LargeListArray.from_arrays(pa.array([0, len(array)], pa.int64()), array)
    return pc.binary_join(whole, pa.scalar(mark, pa.large_string()))[0].as_py().split(mark)


def portions(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to at most ``most``; a larger row is alone."""
    begin, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > begin and held + size > most:
            yield begin, i
            begin, held = i, 0
        held += size
    if begin < len(sizes):
        yield begin, len(sizes)


class Growing:
    """An array that grows at its end, in place up to ``room`` values."""

    def __init__(self, kind, room: int = 1024):
        self.data = np.zeros(room, kind)
        self.n = 0

    def extend(self, values) -> None:
        need = self.n + len(values)
        if need > len(self.data):
            self.data = np.concatenate([self.data[:self.n], np.zeros(need - self.n + self.n // 5, self.data.dtype)])
        self.data[self.n:need] = values
        self.n = need

    def keep(self, which: np.ndarray) -> None:
        """Keep only the values where ``which`` is true."""
        kept = self.data[:self.n][which]
        self.n = len(kept)
        self.data[:self.n] = kept


def tokenizer_file(name: str) -> str:
    """Path of a public vocabulary file; ``MIXTEXT_TOKENIZERS`` overrides the folder."""
    folder = os.environ.get("MIXTEXT_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def taken(shared):
    """The value of a broadcast, which the worker then does not keep beside what is made of
    it (a worker would hold the values of all earlier queries until the driver drops them)."""
    value = shared.value
    shared.__dict__.pop("_value", None)  # read again from its file if another object is made
    return value


_HELD: dict[str, object] = {}


def release() -> None:
    """Return freed memory to the system: Arrow's and the C allocator's."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        with contextlib.suppress(AttributeError, OSError):  # allocators other than glibc's have no malloc_trim
            ctypes.CDLL(None).malloc_trim(0)


def hand_back() -> None:
    """``release``, after Python has looked for what nothing refers to."""
    gc.collect()
    release()


def per_worker(key: str, make):
    """``make()`` once per worker process and key. Workers outlive queries and stages, so a
    process holds one such object at a time: the next operator's takes its place, and what
    the last one used is handed back first."""
    if key not in _HELD:
        if _HELD:
            _HELD.clear()
            hand_back()
        _HELD[key] = make()
    return _HELD[key]
