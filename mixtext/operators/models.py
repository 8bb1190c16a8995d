"""Model operators (M1-M5, M8, M9, W4, U2, U3, X9, J4, S11, S12) on Spark ML.

Training is Spark ML: every L-BFGS iteration is a distributed ``treeAggregate``;
coefficients live on the driver and are shipped with the model. Scoring is map-only.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import NGram, Normalizer, RegexTokenizer, SQLTransformer, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from mixtext.functions import scoring as S
from mixtext.functions import text as T
from mixtext.operators import blocks as BL
from mixtext.operators import dictionary as DI
from mixtext.operators import evaluate as E
from mixtext.operators import features as FE
from mixtext.operators import termfit as TF
from mixtext.session import materialize, path_exists

# Champion selection order and experiment naming of the reference
SELECTION_METRIC_ORDER = ("macro_f1", "weighted_f1", "accuracy")
SELECTION_METRIC_ORDER_LABEL = "Champion selected by macro F1, then weighted F1, then accuracy."
BASELINE_NAME = "tfidf_baseline"
TRANSFORMER_NAME = "multilingual_transformer_embeddings"

# Distinct terms of a part in which scored rows' terms meet the coefficients, on average.
PART_TERMS = 500_000

# Coefficient tables of at most so many terms (some 10 MB) are broadcast when scoring.
BROADCAST_TERMS = 100_000

# A fit ends when no entry of the gradient of the mean loss exceeds this, the reference's kind
# of test; Spark's own test looks at the relative change of the loss.
GRADIENT_TOL = 1e-4
FIRST_BUDGET = 32  # iterations of the first attempt; each further attempt doubles them


# Instance block size for Spark's blockified LR aggregator. With an intercept, each block
# also applies a dense K x D centering correction to the gradient, so the number of
# blocks (data size / block size) multiplies a vocabulary-sized cost every pass; Spark's
# 1 MB default makes that dominate for 1-2 gram vocabularies (measured at sf0.1, 2 M terms:
# 5 iterations 30-32 s with 1 MB blocks, 24-27 s with 64 MB blocks).
LR_BLOCK_MB = 64.0


def _lr(n_train: int, max_iter: int, tol: float, n_classes: int) -> LogisticRegression:
    """Balanced, L2 (C = 1), unpenalised intercept: regParam = 1 / sum(weights) = 1 / n."""
    return LogisticRegression(
        featuresCol="features",
        labelCol="label_idx",
        weightCol="weight",
        family="multinomial" if n_classes > 2 else "auto",
        regParam=1.0 / max(int(n_train), 1),
        elasticNetParam=0.0,
        standardization=False,
        fitIntercept=True,
        maxIter=int(max_iter),
        tol=tol,
        maxBlockSizeInMB=LR_BLOCK_MB,
    )


# Bytes of written training matrix per partition. Every partition returns a dense K x D
# gradient each iteration, so partitions follow the data volume, not the core count.
TRAIN_BYTES_PER_PARTITION = 16 << 20


def _training_partitions(matrix: DataFrame) -> DataFrame:
    """The written matrix in partitions of about TRAIN_BYTES_PER_PARTITION."""
    files = matrix.inputFiles()
    size = matrix.sparkSession.read.format("binaryFile").load(files).agg(F.sum("length")).first()[0] if files else 0
    return matrix.coalesce(max(1, -(-int(size or 0) // TRAIN_BYTES_PER_PARTITION)))


def fit_rows(train: DataFrame, max_rows: int | None = None) -> DataFrame:
    """The rows a model is fitted on: all, unless the caller wants at most ``max_rows``: those whose
    20-bit hash of row_id lies below a cut-off found by two histograms of 1024 counts each."""
    if max_rows is None or "row_id" not in train.columns:
        return train
    place = F.shiftrightunsigned(F.xxhash64("row_id"), 44)
    counts = {r["b"]: r["count"] for r in train.groupBy(F.shiftright(place, 10).alias("b")).count().collect()}
    if sum(counts.values()) <= max_rows:
        return train
    left, edge = max_rows, 0
    while counts.get(edge, 0) <= left:
        left, edge = left - counts.get(edge, 0), edge + 1
    fine = {r["p"]: r["count"] for r in train.where(F.shiftright(place, 10) == edge).groupBy(place.alias("p")).count().collect()}
    cut = edge << 10
    while fine.get(cut, 0) <= left:
        left, cut = left - fine.get(cut, 0), cut + 1
    return train.where(place < cut)


def gradient_peak(classifier: PipelineModel, data: DataFrame, n_train: int) -> float:
    """Largest absolute entry of the gradient of the mean weighted loss plus penalty.

    One pass: residuals times features are summed per feature with map-side combine.
    """
    lr = classifier.stages[-1]
    coefficients = lr.coefficientMatrix.toArray()
    k = max(len(classifier.stages[0].labels), 2)
    if len(coefficients) < k:  # a two-class model holds the second class's row only
        coefficients = np.concatenate([np.zeros_like(coefficients), coefficients])
    scored = classifier.transform(data)
    p = vector_to_array(F.col("probability"))
    miss = [F.col("weight") * (p[c] - (F.col("label_idx") == c).cast("double")) / float(n_train) for c in range(k)]
    rows = scored.select(F.unwrap_udt("features").alias("f"), *[m.alias(f"r{c}") for c, m in enumerate(miss)])
    places = F.coalesce(F.col("f.indices"), F.sequence(F.lit(0), F.size("f.values") - 1))
    entries = rows.select(F.explode(F.zip_with(places, "f.values", lambda i, x: F.struct(i.alias("i"), x.alias("x")))).alias("e"),
                          *[f"r{c}" for c in range(k)])
    sums = entries.groupBy(F.col("e.i").alias("i")).agg(*[F.sum(F.col("e.x") * F.col(f"r{c}")).alias(f"g{c}") for c in range(k)])
    found = sums.toPandas()  # one row per feature: as large as the coefficients themselves
    gradient = coefficients.T / float(n_train)
    if len(lr.coefficientMatrix.toArray()) < k:
        found["g0"] = 0.0
    gradient[found["i"].to_numpy()] += found[[f"g{c}" for c in range(k)]].to_numpy()
    bias = rows.agg(*[F.abs(F.sum(f"r{c}")).alias(f"b{c}") for c in range(k)]).first()
    return float(max(np.abs(gradient).max(initial=0.0), *bias))


def fit_to_tolerance(data: DataFrame, label: str, n_train: int, n_classes: int, max_iter: int, tol: float) -> PipelineModel:
    """Balanced softmax regression, refitted with twice the iterations until the gradient test
    holds or ``max_iter`` is reached (all attempts together cost at most twice the last)."""
    indexer = StringIndexer(inputCol=label, outputCol="label_idx", stringOrderType="alphabetAsc")
    budget = min(FIRST_BUDGET, max_iter)
    while True:
        fitted = Pipeline(stages=[indexer, _lr(n_train, budget, 1e-12, n_classes)]).fit(data)
        if budget >= max_iter or gradient_peak(fitted, data, n_train) <= tol:
            return fitted
        budget = min(2 * budget, max_iter)


def _weighted(train: DataFrame, label: str) -> tuple[DataFrame, int, list[str]]:
    weights = FE.class_weights(train, label)
    stats = weights.agg(F.sum("n_c").alias("n"), F.sort_array(F.collect_list(label)).alias("cls")).first()  # k-sized
    return FE.with_class_weight(train, weights, label), int(stats["n"] or 0), list(stats["cls"] or [])


class TermFeatures:
    """M1's fitted feature stages over a dictionary (term, term_id, key, df): an entry of a row's
    vector is the term's count times ln((1 + n) / (1 + df)) + 1, divided by the row's L2 norm."""

    def __init__(self, stages: PipelineModel, parts: DI.Parts, n_docs: int, text_col: str = "text"):
        self.stages = stages
        self.parts = parts
        self.dictionary = parts.table()
        self.n_docs = n_docs
        self.text_col = text_col
        self.size = parts.size

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` plus ``features``, sparse vectors by term id. Terms not seen in training drop out
        before the norm; a row without known terms gets an empty vector. Rows get a written key,
        so equal rows stay apart; a row's vector is made where its text is."""
        size, n_docs, names = self.size, self.n_docs, df.columns
        held = materialize(df.withColumn("__k", F.monotonically_increasing_id()), "feature-rows")
        blocks = BL.Blocks(held, "__k", self.text_col, self.stages.transform, BL.by_bucket, self.parts.count, carry=tuple(names))

        def give(b, block, answer):
            told, df = BL.told(block, answer, 2)
            hit = told[block.codes] > 0
            rows, codes, n = block.rows[hit], block.codes[hit], len(block.ids)
            ids, w = told[codes] - 1, block.counts[hit] * BL.smoothed(df[codes], n_docs)
            w /= np.sqrt(np.bincount(rows, w * w, n))[rows]
            order = np.argsort(rows * size + ids)
            stops = pa.array(np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]).astype(np.int32))
            parts = [pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32)),
                     pa.ListArray.from_arrays(stops, pa.array(ids[order].astype(np.int32))), pa.ListArray.from_arrays(stops, pa.array(w[order]))]
            vectors = pa.StructArray.from_arrays(parts, ["type", "size", "indices", "values"])  # a vector's stored form
            yield pa.RecordBatch.from_arrays([*block.carried, vectors], names=[*names, "features"])

        schema = StructType([*df.schema.fields, StructField("features", VectorUDT())])
        return blocks.map(give, schema, self.parts.look_up(blocks))


class TfidfModel:
    """M1: tokenise -> 1-2 grams -> counts -> smoothed idf -> L2 -> balanced softmax LR."""

    model_type = "baseline"
    kind = "tfidf"

    def __init__(self, table: DataFrame, intercept: list[float], classes: list[str], model_name: str = BASELINE_NAME,
                 n_rows: int = 0, peak: float = 0.0, steps: int = 0):
        self.table = table  # (term, idf, w): one row per term
        self.n_terms = table.count()
        self.intercept = intercept
        self.classes = classes
        self.model_name = model_name
        self.n_rows = n_rows
        self.peak = peak
        self.steps = steps

    @staticmethod
    def term_stages(text_col: str) -> PipelineModel:
        """Text -> its terms: tokens, then 2-grams (``_terms``); nothing in these is fitted."""
        return PipelineModel(stages=[
            RegexTokenizer(inputCol=text_col, outputCol="_tok", pattern=T.TOKEN_PATTERN, gaps=False,
                           toLowercase=False, minTokenLength=1),
            NGram(n=2, inputCol="_tok", outputCol="_bi"),
            SQLTransformer(statement="SELECT *, concat(_tok, _bi) AS _terms FROM __THIS__"),
        ])

    @classmethod
    def fit_features(cls, train: DataFrame, text_col: str = "text") -> TermFeatures:
        """M1's feature stages fitted on ``train``: text -> L2-normalised smoothed TF-IDF ``features``.
        No term is left out; the vocabulary is a written dictionary, never on the driver."""
        stages = cls.term_stages(text_col)
        rows = train.withColumn("__k", F.monotonically_increasing_id())  # equal rows count each
        return TermFeatures(stages, DI.Parts(BL.Blocks(rows, "__k", text_col, stages.transform, BL.by_bucket), links=False), train.count(), text_col)

    @staticmethod
    def _numbered(weighted: DataFrame, text_col: str, label: str, classes: list[str]) -> tuple[DataFrame, TF.RowTable, int]:
        """Rows (i, text), the driver's table of their labels and weights, and a bound on their term counts."""
        y = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)).cast("int") - 1
        rows = TF.number_rows(weighted.select(F.col(text_col).alias("text"), y.alias("y"), "weight"))
        told = rows.select("i", "y", "weight").toPandas().sort_values("i")  # a label and a weight a row
        data = TF.RowTable(told["y"].to_numpy(), told["weight"].to_numpy(), len(classes))
        spaces = F.length("text") - F.length(F.replace(F.col("text"), F.lit(" "), F.lit("")))  # two terms a word at most
        return rows.select("i", "text"), data, int(rows.agg(F.sum(2 * (spaces + 1))).first()[0] or 0)

    @classmethod
    def fit(cls, train: DataFrame, text_col: str = "text", label: str = "label", max_iter: int = 2000,
            tol: float = GRADIENT_TOL, max_rows: int | None = None, model_name: str = BASELINE_NAME) -> TfidfModel:
        """Fit on all rows (``fit_rows``): TF-IDF in long form, then Newton steps over its cells
        until no gradient entry of the mean loss exceeds ``tol`` (at most ``max_iter`` steps).
        The driver holds labels, weights and margins of these rows; terms stay distributed."""
        weighted, n_train, classes = _weighted(fit_rows(train, max_rows), label)
        if not n_train:
            raise ValueError("no labelled rows to fit on")
        rows, data, entries = cls._numbered(weighted, text_col, label, classes)
        cells = TF.text_cells(rows, n_train, entries)
        gram = TF.Gram(cells, n_train, n_train)
        fitted = TF.newton(gram, data, max_iter, tol)
        table = TF.coefficients(cells, fitted, n_train, gram)
        return cls(table, fitted.intercept.tolist(), classes, model_name, n_train, fitted.peak, fitted.steps)

    def with_probabilities(self, df: DataFrame, text_col: str) -> DataFrame:
        """Margins by a join of the rows' terms with the coefficients; terms not seen in
        training drop out before the norm. Rows get a written key, so equal rows stay apart."""
        held = materialize(df.withColumn("__k", F.monotonically_increasing_id()), "scoring-rows")
        sums = self._met(held, text_col) if self.n_terms > BROADCAST_TERMS else self._joined(held, text_col)
        logits = F.array(*[F.lit(float(b)) + F.coalesce(F.col(f"__w{c}") / F.col("__norm"), F.lit(0.0)) for c, b in enumerate(self.intercept)])
        out = held.join(sums, "__k", "left").withColumn("__logits", logits).withColumn("__exp", S.softmax_exp(F.col("__logits")))
        return out.withColumn("probabilities", S.normalise(F.col("__exp"))).select(*df.columns, "probabilities")

    def _joined(self, held: DataFrame, text_col: str) -> DataFrame:
        """(__k, norm, sums by class) where the coefficients are few: they are broadcast."""
        x = F.col("tf") * F.col("idf")
        return FE.term_counts(held, text_col, "__k").join(F.broadcast(self.table), "term").groupBy("__k").agg(
            F.sqrt(F.sum(x * x)).alias("__norm"), *[F.sum(x * F.col("w")[c]).alias(f"__w{c}") for c in range(len(self.classes))])

    def _met(self, held: DataFrame, text_col: str) -> DataFrame:
        """The same, where terms are many: only the blocks' distinct terms meet the coefficients."""
        k = len(self.classes)
        blocks = BL.Blocks(held, "__k", text_col, parts=max(2 * BL.block_count(held), -(-self.n_terms // PART_TERMS)))
        # a row's classes may all be moved by one number: those of the last class are taken off
        table = self.table.select("term", F.concat(F.array("idf"), *[F.array(F.col("w")[c] - F.col("w")[k - 1]) for c in range(k - 1)]).alias("w"))
        answers = BL.look_up(blocks.asks(), BL.deal_table(table, blocks.parts), blocks.parts, k)

        def give(b, block, answer):
            told = BL.told_floats(block, answer, k)
            hit = ~np.isnan(told[0])[block.codes]
            rows, codes = block.rows[hit], block.codes[hit]
            x = block.counts[hit] * told[0][codes]
            sums = [np.sqrt(np.bincount(rows, x * x, len(block.ids))), *[np.bincount(rows, x * w[codes], len(block.ids)) for w in told[1:]], np.zeros(len(block.ids))]
            some = np.flatnonzero(sums[0] > 0)
            yield pa.RecordBatch.from_arrays([block.ids.take(pa.array(some)), *[pa.array(s[some]) for s in sums]], names=names)

        names = ["__k", "__norm", *[f"__w{c}" for c in range(k)]]
        return blocks.map(give, "__k long, " + ", ".join(f"{c} double" for c in names[1:]), answers)

    def gradient_peak(self, train: DataFrame, text_col: str = "text", label: str = "label") -> float:
        """The largest gradient entry of the mean weighted loss plus penalty over the rows the
        model was fitted on, worked out anew: term counts are taken from the text again and meet
        the coefficients term by term; norms, margins and slopes are summed over all of them."""
        weighted, n, classes = _weighted(train, label)
        rows, data, entries = self._numbered(weighted, text_col, label, classes)
        cells = TF.text_cells(rows, n, entries, self.table, len(classes))
        return TF.gradient_peak(cells, data, np.array(self.intercept))

    def save(self, path: str) -> None:
        spark = self.table.sparkSession
        self.table.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/terms")
        row = (self.model_name, self.classes, self.intercept, self.n_rows, self.peak, self.steps)
        spark.createDataFrame([row], "model_name string, classes array<string>, intercept array<double>, n_rows long, peak double, steps int") \
            .coalesce(1).write.mode("overwrite").parquet(f"{path}/model")

    @classmethod
    def load(cls, path: str, model_name: str | None = None) -> TfidfModel:
        """The saved model, under its own name unless another is given."""
        spark = SparkSession.active()
        if not path_exists(spark, f"{path}/model"):
            raise FileNotFoundError(f"no saved model at {path}")
        m = spark.read.parquet(f"{path}/model").first()
        return cls(spark.read.parquet(f"{path}/terms"), list(m["intercept"]), list(m["classes"]), model_name or m["model_name"],
                   m["n_rows"], m["peak"], m["steps"])


class EmbeddingModel:
    """M4: (encoded or stored) vectors -> L2 -> the same balanced softmax LR."""

    model_type = "transformer"
    kind = "embedding"

    def __init__(self, classifier: PipelineModel, classes: list[str], vector_col: str = "embedding",
                 encoder: Callable | None = None, batch_size: int = 32, model_name: str = TRANSFORMER_NAME):
        self.classifier = classifier
        self.classes = classes
        self.vector_col = vector_col
        self.encoder = encoder
        self.batch_size = batch_size
        self.model_name = model_name

    @staticmethod
    def _features(df: DataFrame, vector_col: str) -> DataFrame:
        return Normalizer(inputCol="_vec", outputCol="features", p=2.0).transform(
            df.withColumn("_vec", array_to_vector(F.col(vector_col)))
        ).drop("_vec")

    @classmethod
    def fit(cls, train: DataFrame, vector_col: str = "embedding", label: str = "label", max_iter: int = 2000,
            tol: float = GRADIENT_TOL, encoder: Callable | None = None, text_col: str = "text", batch_size: int = 32,
            model_name: str = TRANSFORMER_NAME) -> EmbeddingModel:
        if encoder is not None:
            train = train.withColumn(vector_col, encoder_udf(encoder, batch_size)(F.col(text_col)))
        weighted, n_train, classes = _weighted(fit_rows(train), label)
        data = materialize(cls._features(weighted, vector_col).select("features", label, "weight"), "train_matrix")
        classifier = fit_to_tolerance(_training_partitions(data), label, n_train, len(classes), max_iter, tol)
        return cls(classifier, list(classifier.stages[0].labels), vector_col, encoder, batch_size, model_name)

    def with_probabilities(self, df: DataFrame, text_col: str) -> DataFrame:
        if self.encoder is not None:
            df = df.withColumn(self.vector_col, encoder_udf(self.encoder, self.batch_size)(F.col(text_col)))
        out = self.classifier.stages[-1].transform(self._features(df, self.vector_col))
        drop = [c for c in ("features", "rawPrediction", "prediction") if c in out.columns]
        return out.withColumn("probabilities", vector_to_array(F.col("probability"))).drop(*drop, "probability")

    def save(self, path: str) -> None:
        self.classifier.write().overwrite().save(f"{path}/classifier")
        spark = SparkSession.active()
        spark.createDataFrame([(self.model_name, self.vector_col, self.batch_size)], "model_name string, vector_col string, batch_size int") \
            .coalesce(1).write.mode("overwrite").parquet(f"{path}/model")

    @classmethod
    def load(cls, path: str, encoder: Callable | None = None, model_name: str | None = None) -> EmbeddingModel:
        """The saved model under its own name unless another is given; the encoder is code, so
        the caller names it again."""
        spark = SparkSession.active()
        if not path_exists(spark, f"{path}/model"):
            raise FileNotFoundError(f"no saved model at {path}")
        m = spark.read.parquet(f"{path}/model").first()
        classifier = PipelineModel.load(f"{path}/classifier")
        return cls(classifier, list(classifier.stages[0].labels), m["vector_col"], encoder, m["batch_size"], model_name or m["model_name"])


def score_vectors(df: DataFrame, model: EmbeddingModel) -> DataFrame:
    """Score rows that already hold a vector (no text cleaning): probabilities, label, confidence."""
    out = model.with_probabilities(df, model.vector_col)
    p = F.col("probabilities")
    classes = F.array(*[F.lit(c) for c in model.classes])
    return out.withColumn("predicted_label", F.element_at(classes, S.argmax_index(p))).withColumn(
        "confidence", S.confidence(p)
    )


# ---------------------------------------------------------------------------
# M5: encoder as an iterator pandas UDF, built once per Python worker
# ---------------------------------------------------------------------------
_ENCODERS: dict[int, Callable] = {}


def encoder_udf(factory: Callable[[], Callable[[list[str]], np.ndarray]], batch_size: int = 32):
    """``factory()`` returns ``encode(list[str]) -> (n, d) array``. It is called once per
    (reused) Python worker and fed Arrow batches cut to ``batch_size``. The cache key is
    a digest of the pickled factory, fixed on the driver: object ids change every time a
    task deserializes the closure."""
    import hashlib

    from pyspark import cloudpickle

    key = hashlib.sha1(cloudpickle.dumps(factory)).hexdigest()

    @F.pandas_udf(ArrayType(FloatType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = _ENCODERS.get(key)
        if enc is None:
            enc = _ENCODERS[key] = factory()
        for batch in batches:
            texts = batch.fillna("").astype(str).tolist()
            parts = [np.asarray(enc(texts[i:i + batch_size]), dtype=np.float32)
                     for i in range(0, len(texts), batch_size)]
            mat = np.vstack(parts) if parts else np.zeros((0, 0), dtype=np.float32)
            norms = np.linalg.norm(mat, axis=1, keepdims=True) if len(mat) else mat
            unit = np.divide(mat, norms, out=np.zeros_like(mat), where=norms > 0) if len(mat) else mat
            yield pd.Series(list(unit))

    return encode


def hashing_encoder(dim: int = 64) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """A stand-in encoder (no pretrained model is available offline): signed feature
    hashing of C9 tokens into ``dim`` dimensions."""

    def factory():
        import re

        import xxhash

        tok = re.compile("[\\w\u0b80-\u0bff]+")

        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dim), dtype=np.float32)
            for r, t in enumerate(texts):
                for w in tok.findall(t):
                    h = xxhash.xxh64_intdigest(w)
                    out[r, h % dim] += 1.0 if (h >> 63) & 1 else -1.0
            return out

        return encode

    return factory


# ---------------------------------------------------------------------------
# Metrics tables, champion choice, comparison record
# ---------------------------------------------------------------------------
def evaluate(scored: DataFrame, model, true: str = "label") -> DataFrame:
    """M3: the metrics row of a scored test table."""
    family = "transformer" if model.model_type == "transformer" else "baseline"
    return E.model_metrics(scored, model.model_name, family, model.classes, true)


def champion_rank(candidates: DataFrame) -> DataFrame:
    """Rank over (macro F1, weighted F1, accuracy) desc, missing = 0.0, then candidate
    position (earlier wins ties). ``candidates`` is the small per-model metrics table."""
    keys = [F.coalesce(F.col(m), F.lit(0.0)).desc() for m in SELECTION_METRIC_ORDER]
    w = Window.orderBy(*keys, F.col("position").asc())  # one row per model
    return candidates.withColumn("rank", F.row_number().over(w))


def candidates(*metrics: DataFrame) -> DataFrame:
    """Stack per-model metric rows, remembering their order as ``position``."""
    out = None
    for i, m in enumerate(metrics):
        m = m.withColumn("position", F.lit(i))
        out = m if out is None else out.unionByName(m, allowMissingColumns=True)
    return out


def comparison(candidate_metrics: DataFrame, experiment: str = "text_classification") -> DataFrame:
    """M8 / M9: one comparison row. Without a candidate beside the baseline family the mode is
    ``baseline_only``; a lone embedding model is a comparison."""
    ranked = champion_rank(candidate_metrics)
    models = F.map_from_entries(
        F.collect_list(F.struct("model_name", F.struct("model_family", "accuracy", "macro_f1", "weighted_f1")))
    )
    champ = F.max_by(F.struct("model_name", "model_family"), -F.col("rank"))
    out = ranked.agg(F.count(F.lit(1)).alias("_n"), champ.alias("_c"), models.alias("models"),
                     F.bool_and(F.col("model_family") == "baseline").alias("_b"))
    only = (F.col("_n") == 1) & F.col("_b")
    return out.select(
        F.lit(experiment).alias("experiment_name"),
        F.when(only, "baseline_only").otherwise("comparison").alias("mode"),
        only.alias("baseline_only"),
        F.array(*[F.lit(m) for m in SELECTION_METRIC_ORDER]).alias("selection_metric_order"),
        F.lit(SELECTION_METRIC_ORDER_LABEL).alias("selection_metric_order_label"),
        F.col("_c.model_name").alias("champion_model"),
        F.col("_c.model_family").alias("champion_family"),
        "models",
    )


def explode_models(comp: DataFrame) -> DataFrame:
    """The comparison's model map as rows with a champion flag."""
    rows = comp.select("champion_model", F.explode("models").alias("model", "m"))
    return rows.select(
        "model", F.col("m.model_family").alias("family"), F.col("m.accuracy").alias("accuracy"),
        F.col("m.macro_f1").alias("macro_f1"), F.col("m.weighted_f1").alias("weighted_f1"),
        (F.col("model") == F.col("champion_model")).alias("champion"),
    )


def champion_metrics(registry: DataFrame, metrics: DataFrame) -> DataFrame:
    """Champion name -> its metrics row (equi-join on the model name)."""
    return registry.select(F.col("champion_model").alias("model_name")).join(metrics, "model_name")


# ---------------------------------------------------------------------------
# Model registry and run log
# ---------------------------------------------------------------------------
def register_model(spark, registry_path: str, model_name: str, model_path: str, family: str,
                   champion: bool = False) -> DataFrame:
    row = spark.createDataFrame(
        [(model_name, family, model_path, champion, time.time())],
        "model_name string, model_family string, model_path string, champion boolean, registered_at double",
    )
    row.write.mode("append").parquet(registry_path)
    return spark.read.parquet(registry_path)


def log_run(spark, runs_path: str, run_name: str, params: dict, metrics: dict, artifacts=()) -> DataFrame:
    """Append one run (params, metrics, artifact paths) to the ``runs`` table."""
    row = spark.createDataFrame(
        [(run_name, time.time(), {k: str(v) for k, v in params.items()},
          {k: float(v) for k, v in metrics.items()}, list(artifacts))],
        "run_name string, ts double, params map<string,string>, metrics map<string,double>, artifacts array<string>",
    )
    row.write.mode("append").parquet(runs_path)
    return spark.read.parquet(runs_path)


def metrics_json(metrics_row) -> str:
    return json.dumps(metrics_row.asDict(recursive=True), ensure_ascii=False)
