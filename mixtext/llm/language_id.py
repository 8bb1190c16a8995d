"""Language ID by word-first backoff.

A word known from training scores by its log frequency in each language. An unknown word
falls back to its character 5-grams, then 4-grams and so on, stopping at the longest length
of which any n-gram is known. A text's language is the one with the largest sum over its words.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mixtext.llm.common import Growing, held_out, per_worker, taken, texts
from mixtext.session import materialize

LETTERS = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"
MAX_GRAM = 5
CACHE_WORDS = 300_000  # words that a worker keeps beside the model's
CACHE_PAIRS = 3_000_000  # (language, gain) pairs of theirs, 8 bytes each
PLACES = 1 << 16  # hash places by which the rows of a language are sampled


@dataclass
class Gains:
    """Log frequencies of keys by language, held sparsely: what a language lacks has its floor,
    and ``gain`` is what the languages of ``lang`` have above theirs. Key i's pairs end at
    ``stop[i]``."""

    keys: list[str]
    stop: np.ndarray
    lang: np.ndarray
    gain: np.ndarray
    floor: np.ndarray

    @staticmethod
    def of(rows, langs: list[str], key: str) -> Gains:
        """From (lang, key, n) rows, smoothed by half a count."""
        rows = rows.sort_values([key, "lang"])
        keys, sizes = np.unique(rows[key].to_numpy(dtype=object), return_counts=True)
        column = {x: i for i, x in enumerate(langs)}
        lang = np.fromiter((column[x] for x in rows["lang"]), np.int32, len(rows))
        n = rows["n"].to_numpy(dtype=np.float64)
        total = np.bincount(lang, n, minlength=len(langs)) + 0.5 * max(len(keys), 1)
        return Gains(keys.tolist(), np.cumsum(sizes), lang, np.log((n + 0.5) / 0.5).astype(np.float32), np.log(0.5 / total))

    def dense(self) -> np.ndarray:
        """One row of log frequencies per key."""
        out = np.tile(self.floor, (len(self.keys), 1))
        at = np.repeat(np.arange(len(self.keys)), np.diff(self.stop, prepend=0))
        out[at, self.lang] += self.gain
        return out


@dataclass
class LanguageModel:
    """Languages in code-point order; what is known of words and n-grams."""

    langs: list[str]
    word: Gains
    gram: Gains

    @property
    def grams(self) -> list[str]:
        return self.gram.keys

    @property
    def gram_logs(self) -> np.ndarray:
        return self.gram.dense()


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        rows_per_lang: int = 2000, min_count: int = 2, keys_per_lang: int = 50_000) -> LanguageModel:
    """Learn from rows outside the held-out fold with a language (null texts add no words).

    Every language is learnt. Documented bounds, each for one language on its own: some
    ``rows_per_lang`` rows (whole texts, by smallest hash of id and text; the last of PLACES
    hash places is taken whole, and rows equal in both fall together), and its
    ``keys_per_lang`` most frequent words and n-grams among those seen at least ``min_count``
    times. The model, the only thing gathered, grows with the number of languages alone.
    """
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")) \
        .where(~held_out(F.col("id")) & F.col("lang").isNotNull()) \
        .withColumn("place", F.pmod(F.xxhash64("id", "text"), F.lit(PLACES)).cast("int"))
    before = Window.partitionBy("lang").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    cuts = known.groupBy("lang", "place").count() \
        .withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).where(F.col("before") < rows_per_lang) \
        .groupBy("lang").agg(F.max("place").alias("cut")).collect()  # one row a language
    langs = sorted(r["lang"] for r in cuts)
    spark = docs.sparkSession
    # from Arrow: rows given as a list would start a second set of Python workers on the executors
    cut = spark.createDataFrame(pa.table({"lang": pa.array([r["lang"] for r in cuts], pa.string()), "cut": pa.array([r["cut"] for r in cuts], pa.int32())}))
    sample = known.withColumn("lang", F.col("lang").cast("string")).join(F.broadcast(cut), "lang").where("place <= cut")
    words = sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word")) \
        .groupBy("lang", "word").agg(F.count("*").alias("n"))
    words = materialize(words, "language-words")
    marked = F.concat(F.lit("^"), F.col("word"), F.lit("$"))

    def grams_of(k: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(marked) - (k - 1), F.lit(1))), lambda i: F.substring(marked, i, F.lit(k)))

    grams = F.flatten(F.array(*[grams_of(k) for k in range(1, MAX_GRAM + 1)]))
    gram_counts = words.select("lang", "n", F.explode(grams).alias("gram")).groupBy("lang", "gram").agg(F.sum("n").alias("n"))

    def top(df: DataFrame, key: str) -> Gains:
        first = Window.partitionBy("lang").orderBy(F.desc("n"), key)
        rows = df.where(F.col("n") >= min_count).withColumn("r", F.row_number().over(first)).where(F.col("r") <= keys_per_lang)
        return Gains.of(rows.select("lang", key, "n").toPandas(), langs, key)

    return LanguageModel(langs, top(words, "word"), top(gram_counts, "gram"))


class Scorer:
    """A model in a worker: word -> its (language, gain) pairs, met words beside the known."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.grams = {g: i for i, g in enumerate(model.gram.keys)}
        self.reset()

    def reset(self) -> None:
        word = self.model.word
        self.rows = {w: i for i, w in enumerate(word.keys)}
        self.stop, self.lang, self.gain = Growing(np.int64), Growing(np.int32), Growing(np.float32)
        self.stop.extend([0])
        self.stop.extend(word.stop)
        self.lang.extend(word.lang)
        self.gain.extend(word.gain)

    def _backoff(self, word: str) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of an unknown word: the mean over its longest known n-grams."""
        marked, gram = f"^{word}$", self.model.gram
        for k in range(min(MAX_GRAM, len(marked)), 0, -1):
            found = [g for g in map(self.grams.get, (marked[i:i + k] for i in range(len(marked) - k + 1))) if g is not None]
            if found:
                at = np.concatenate([np.arange(gram.stop[g - 1] if g else 0, gram.stop[g]) for g in found])
                return gram.lang[at], gram.gain[at] / len(found)
        return gram.lang[:0], gram.gain[:0]

    def backoff(self, word: str) -> np.ndarray:
        """An unknown word's log frequency in each language."""
        lang, gain = self._backoff(word)
        return self.model.gram.floor + np.bincount(lang, gain, minlength=len(self.model.langs))

    def word_rows(self, words: list[str]) -> np.ndarray:
        if len(self.rows) > len(self.model.word.keys) + CACHE_WORDS or self.lang.n > len(self.model.word.lang) + CACHE_PAIRS:
            self.reset()
        rows = self.rows
        new = list(set(words).difference(rows))
        if new:
            pairs = [self._backoff(w) for w in new]
            rows.update(zip(new, range(len(rows), len(rows) + len(new)), strict=True))
            self.stop.extend(self.lang.n + np.cumsum([len(x) for x, _ in pairs]))
            self.lang.extend(np.concatenate([x for x, _ in pairs]))
            self.gain.extend(np.concatenate([g for _, g in pairs]))
        return np.fromiter(map(rows.__getitem__, words), np.int64, len(words))

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score); ties go to the first language by code point."""
        words = LETTERS.findall(text.lower()) if text else []
        if not self.model.langs or not any(c.isalpha() for w in words for c in w):
            return UNDETERMINED, 0.0
        total = np.zeros(len(self.model.langs))
        for a in range(0, len(words), 1 << 16):  # long texts by the piece
            at = self.word_rows(words[a:a + (1 << 16)])
            unknown = int((at >= len(self.model.word.keys)).sum())
            total += unknown * self.model.gram.floor + (len(at) - unknown) * self.model.word.floor
            begin = self.stop.data[at]
            size = self.stop.data[at + 1] - begin
            pair = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            total += np.bincount(self.lang.data[pair], self.gain.data[pair], minlength=len(total))
        best = int(np.argmax(total))
        # evidence grows with the text; dividing by the root of its length keeps the score graded
        odds = np.exp((total - total[best]) / np.sqrt(len(words)))
        return self.model.langs[best], float(1.0 / odds.sum())


def predicted(spark: SparkSession, model: LanguageModel, text: Column) -> Column:
    """A struct of ``lang_pred`` and ``score`` (0 to 1, the best language's share).

    Null, empty and letterless texts are ``und`` with score 0, and so is every text under a
    model without languages. Rows are judged one by one.
    """
    shared = spark.sparkContext.broadcast(model)
    key = f"language:{uuid.uuid4().hex}"

    def predict(column: pa.Array) -> pa.Array:
        scorer = per_worker(key, lambda: Scorer(taken(shared)))
        found = [scorer.predict(t) for t in texts(column)]
        return pa.StructArray.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                                          names=["lang_pred", "score"])

    predict.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(predict, "lang_pred string, score double").asNondeterministic()(text)


def language(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` plus ``lang_pred`` and ``score`` (see ``predicted``); columns of ``docs`` with
    these names are replaced; language, source and id never enter a score."""
    return docs.withColumn("__p", predicted(docs.sparkSession, model, F.col(text_col))) \
        .withColumns({"lang_pred": F.col("__p.lang_pred"), "score": F.col("__p.score")}).drop("__p")


def fold(id_col: str = "doc_id") -> Column:
    return held_out(F.col(id_col)).alias("held_out")
