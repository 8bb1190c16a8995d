"""Toxicity by weak supervision.

Many voters (lexicons, word beginnings mined from labelled rows, surface patterns) vote
toxic, clean or abstain. A generative label model estimates each voter's accuracy and the
correlations between voters from the votes alone, and gives every training text a posterior
label; a linear classifier over the lexicon terms and patterns is trained on those posteriors
and scores all texts.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixtext.llm.common import held_out, per_worker, taken, texts

LETTERS = re.compile(r"[^\W\d_]+")
PREFIXES = (3, 4, 5, 6)
TIERS = 5  # a beginning counts as a term of its own for 1, 2, ... 5 distinct words
CACHE_WORDS = 400_000

# Common English insults, by what they attack.
PERSON = "idiot moron loser clown stupid dumb fool imbecile scum scumbag vermin".split()
WORTH = "trash garbage worthless pathetic disgusting useless filth hate".split()

UPPER, SYMBOLS = bytes(range(65, 91)), b"#*$%&|"

# surface patterns: share of a text's characters or words, and the share from which it votes
PATTERNS = {"upper": 0.3, "exclaim": 0.3, "symbols": 0.3}


def found_terms(text: str | None) -> set[str]:
    """All terms of a text: its words, and ``abc*n`` where n or more distinct words begin so."""
    if not text:
        return set()
    words = set(LETTERS.findall(text.lower()))
    begins = Counter(w[:k] for w in words for k in PREFIXES if len(w) >= k)
    return words.union(f"{b}*{n}" for b, c in begins.items() for n in range(1, min(c, TIERS) + 1))


@dataclass
class Terms:
    """Lexicon terms in a fixed order: words as they are, word beginnings as ``abc*n``."""

    names: list[str]

    def __post_init__(self):
        self.at = {t: i for i, t in enumerate(self.names)}
        self.begins = {t.split("*")[0] for t in self.names if "*" in t}
        self.cache: dict[str, tuple[int | None, tuple[str, ...]]] = {}

    def of_word(self, word: str) -> tuple[int | None, tuple[str, ...]] | None:
        begins = tuple(word[:k] for k in PREFIXES if len(word) >= k and word[:k] in self.begins)
        at = self.at.get(word)
        return (at, begins) if begins or at is not None else None

    def hits(self, text: str | None) -> set[int]:
        """Numbers of the lexicon terms that ``found_terms`` would give."""
        if not text:
            return set()
        if len(self.cache) > CACHE_WORDS:
            self.cache = {}
        cache, out, begins = self.cache, set(), Counter()
        words = set(LETTERS.findall(text.lower()))
        for w in words.difference(cache):
            cache[w] = self.of_word(w)
        for found in filter(None, map(cache.__getitem__, words)):
            if found[0] is not None:
                out.add(found[0])
            begins.update(found[1])
        for b, c in begins.items():
            out.update(i for i in (self.at.get(f"{b}*{n}") for n in range(1, min(c, TIERS) + 1)) if i is not None)
        return out


def surface(text: str | None) -> list[float]:
    """The pattern measures of a text, each 0 to 1."""
    if not text:
        return [0.0] * len(PATTERNS)
    data = text.encode()
    n_words = max(len(data.split()), 1)
    upper = (len(data) - len(data.translate(None, UPPER))) / max(len(data), 1)
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    return [upper, min(data.count(b"!") / n_words, 1.0), min(symbols / n_words, 1.0)]


def votes(terms: Terms, hits: set[int], measures: list[float]) -> list[int]:
    """+1 toxic, -1 clean, 0 abstain, one per voter."""
    names = [terms.names[i] for i in hits]
    begins = [x.split("*")[0] for x in names if "*" in x]
    mined = [x for x in names if "*" not in x]
    out = [
        1 if any(x in PERSON for x in mined) else 0,
        1 if any(x in WORTH for x in mined) else 0,
        1 if mined else 0,
        *[1 if any(len(x) == k for x in begins) else 0 for k in PREFIXES],
        1 if len(mined) + len(begins) >= 3 else 0,
        -1 if not mined else 0,
        -1 if not begins else 0,
        -1 if not names else 0,
    ]
    return out + [1 if m >= t else 0 for m, t in zip(measures, PATTERNS.values(), strict=True)]


def label_model(v: np.ndarray, prior: float, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Posterior P(toxic) per row and P(vote | label) per voter from votes in {-1, 0, 1}.

    Expectation maximisation. After each round the correlations that remain between voters
    once the label is known are estimated; a voter whose residuals move with others' counts
    with weight 1 / (1 + sum of their squared correlations), so copies of one signal do not
    count as independent evidence.
    """
    n, m = v.shape
    seen = np.stack([(v == x).astype(float) for x in (-1, 0, 1)], axis=2)
    first = (v == 1).sum(axis=1) - (v == -1).sum(axis=1)
    post = np.clip(np.where(first > 0, 0.9, 0.1 * prior), 1e-4, 1 - 1e-4)
    weight = np.ones(m)
    table = np.zeros((2, m, 3))
    for _ in range(rounds):
        both = np.stack([1 - post, post], axis=1)
        table = (np.einsum("ny,nmx->ymx", both, seen) + 0.5) / (both.sum(axis=0)[:, None, None] + 1.5)
        expected = both @ (table[:, :, 2] - table[:, :, 0])
        rest = v - expected
        spread = np.sqrt((rest ** 2).mean(axis=0)) + 1e-9
        corr = (rest.T @ rest) / n / np.outer(spread, spread)
        np.fill_diagonal(corr, 0.0)
        corr[np.abs(corr) < 0.1] = 0.0
        weight = 1.0 / (1.0 + (corr ** 2).sum(axis=1))
        odds = math.log(prior / (1 - prior)) + np.einsum("nmx,mx,m->n", seen, np.log(table[1] / table[0]), weight)
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(new - post).max() < 1e-6:
            post = new
            break
        post = new
    return post, table


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, steps: int = 1000) -> np.ndarray:
    """Weights (bias last) of a ridge logistic regression on soft labels, by Nesterov steps."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    ahead = w.copy()
    rate = 4.0 / (max((x ** 2).sum(axis=1).max(), 1.0) + 4 * penalty)
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30)))
        grad = x.T @ (p - y) / len(x) + penalty * np.append(ahead[:-1], 0.0)
        new = ahead - rate * grad * 4
        ahead = new + k / (k + 3) * (new - w)
        w = new
    return w


@dataclass
class ToxicityModel:
    names: list[str]
    weights: np.ndarray  # one per term, one per pattern, bias
    accuracies: list[float]


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, rows: int) -> DataFrame:
    """(id, text, toxic): the rows/2 labelled rows of each class with the smallest id hash."""
    known = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic")) \
        .where(F.col("id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("id"))) \
        .groupBy("id").agg(F.max("toxic").alias("toxic"))
    known = known.withColumn("h", F.xxhash64("id"))
    picked = [known.where(F.col("toxic") == y).orderBy("h", "id").limit(rows // 2).select("id", "toxic") for y in (0, 1)]
    bounded = docs.sparkSession.createDataFrame([tuple(r) for p in picked for r in p.collect()], "id long, toxic int")
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(bounded), "id")


def _counts(seen: dict[str, list[int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"term": list(seen), "a": [y for _, y in seen.values()], "n": [x + y for x, y in seen.values()]},
                                      schema=pa.schema([("term", pa.string()), ("a", pa.int64()), ("n", pa.int64())]))


def mine(sample: DataFrame, n_toxic: int, n_clean: int, max_terms: int, alpha: float = 0.01) -> list[str]:
    """Words and word beginnings that mark toxic sample texts: present in at least three of
    them, nine times as frequent there as in clean ones, and with a likelihood ratio beyond
    chance for as many terms as were looked at."""
    if not n_toxic:
        return []

    def count(batches):
        seen: dict[str, list[int]] = {}
        for b in batches:
            for text, toxic in zip(texts(b.column("text")), b.column("toxic").to_pylist(), strict=True):
                for t in found_terms(text):
                    seen.setdefault(t, [0, 0])[toxic] += 1
                if len(seen) > 200_000:
                    yield _counts(seen)
                    seen = {}
        if seen:
            yield _counts(seen)

    counts = sample.select("text", "toxic").mapInArrow(count, "term string, a long, n long").groupBy("term") \
        .agg(F.sum("a").alias("a"), F.sum("n").alias("n")).where("a >= 3").persist()
    looked = max(counts.count(), 1)
    bar = 2 * math.log(looked / alpha)
    rate_a, rate_b = F.col("a") / F.lit(float(n_toxic)), (F.col("n") - F.col("a") + 0.5) / F.lit(float(n_clean + 1))
    share = F.lit(n_toxic / (n_toxic + n_clean))
    inside, outside = F.col("a"), F.col("n") - F.col("a")
    ratio = 2 * (inside * F.log(inside / (F.col("n") * share))
                 + F.when(outside > 0, outside * F.log(outside / (F.col("n") * (1 - share)))).otherwise(0.0))
    rows = counts.where((rate_a > 9 * rate_b) & (ratio > bar)).withColumn("g", ratio).orderBy(F.desc("g"), "term").limit(max_terms).collect()
    counts.unpersist()
    return sorted(r["term"] for r in rows)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        max_rows: int = 8000, max_terms: int = 400) -> ToxicityModel:
    """Learn from labelled rows outside the held-out fold.

    Documented bounds of the classifier: ``max_rows`` labelled rows (half per class, by
    smallest id hash, whole texts) and ``max_terms`` mined terms; so votes and features,
    which the driver holds, have a fixed largest size. A doc_id labelled twice is toxic if
    any label says so; without labels the fixed lexicons alone decide.
    """
    sample = _sample(docs, labels, id_col, text_col, max_rows).persist()
    size = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    mined = mine(sample, size.get(1, 0), size.get(0, 0), max_terms)
    names = sorted(set(mined) | set(PERSON) | set(WORTH))

    def look(batches):
        terms = Terms(names)
        for b in batches:
            rows = [(sorted(terms.hits(t)), surface(t)) for t in texts(b.column("text"))]
            yield pa.RecordBatch.from_pydict({
                "toxic": b.column("toxic"), "hits": pa.array([h for h, _ in rows], pa.list_(pa.int32())),
                "measures": pa.array([s for _, s in rows], pa.list_(pa.float64()))})

    seen = sample.select("text", "toxic").mapInArrow(look, "toxic int, hits array<int>, measures array<double>").collect()
    sample.unpersist()
    terms = Terms(names)
    if not seen:
        weights = np.concatenate([np.full(len(names), 4.0), np.zeros(len(PATTERNS)), [-2.0]])
        return ToxicityModel(names, weights, [])
    v = np.array([votes(terms, set(r["hits"]), r["measures"]) for r in seen])
    prior = min(max(size.get(1, 0) / len(seen), 0.02), 0.98)
    post, table = label_model(v, prior)
    x = np.zeros((len(seen), len(names) + len(PATTERNS)))
    for i, r in enumerate(seen):
        x[i, r["hits"]] = 1.0
        x[i, len(names):] = r["measures"]
    weights = logistic(x, post)
    right = table[1, :, 2] / (table[1, :, 2] + table[0, :, 2])
    return ToxicityModel(names, weights, [float(a) for a in right])


class Scorer:
    def __init__(self, model: ToxicityModel):
        self.terms = Terms(model.names)
        self.term_weights = model.weights[:len(model.names)]
        self.pattern_weights = model.weights[len(model.names):-1]
        self.bias = float(model.weights[-1])

    def score(self, text: str | None) -> float:
        odds = self.bias + sum(self.term_weights[i] for i in self.terms.hits(text)) + float(np.dot(self.pattern_weights, surface(text)))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))


def toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """``docs`` plus ``score`` (0 to 1) and ``predicted`` (1 if score >= 0.5).

    Null and empty texts score as a text without any term; rows are scored one by one;
    columns of ``docs`` with these names are replaced; labels, language, source and id never
    enter a score.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key = f"toxicity:{uuid.uuid4().hex}"

    def score(column: pa.Array) -> pa.Array:
        scorer = per_worker(key, lambda: Scorer(taken(shared)))
        return pa.array([scorer.score(t) for t in texts(column)], pa.float64())

    score.__annotations__ = {"column": pa.Array, "return": pa.Array}
    udf = F.arrow_udf(score, "double").asNondeterministic()
    return docs.withColumn("score", udf(F.col(text_col))).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
