"""Batch / streaming scoring (M6, M7) shared by every model kind.

A model exposes ``model_type`` ('baseline' for term models, 'transformer' for
embedding models), ``model_name``, ``classes`` (sorted label strings) and
``with_probabilities(df, text_col)`` which appends an ``array<double>`` column
``probabilities`` aligned with ``classes``. Scoring is map-only: model parameters
travel inside the plan (literal map or broadcast ML model), never a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixtext.functions import scoring as S
from mixtext.functions import text as T

MODEL_TYPES = ("baseline", "transformer")


class TermWeightScorer:
    """A frozen linear term model: logit_c = bias_c + sum over C10 terms of weight(term, c).

    Integer weights keep logits exact, so argmax and ties agree across engines; it is
    the scorer the SQL oracle can replay. Weights are model parameters (a handful of
    terms), carried as a literal map in the projection.
    """

    model_type = "baseline"
    kind = "frozen"

    def __init__(self, model_name: str, weights: dict[str, dict[str, int]], classes=None, bias=None):
        self.model_name = model_name
        self.classes = sorted(classes or {c for w in weights.values() for c in w})
        self.weights = weights
        self.bias = bias or {}

    def weight_rows(self):
        return [(t, c, int(w)) for t, by in sorted(self.weights.items()) for c, w in sorted(by.items())]

    def logits(self, tok: Column) -> Column:
        """Logits from a token-array column (C9); bigrams are added only if the table has any."""
        vec = {t: [int(by.get(c, 0)) for c in self.classes] for t, by in self.weights.items()}
        table = F.create_map(*[x for t, v in sorted(vec.items()) for x in (F.lit(t), F.array(*[F.lit(i) for i in v]))])
        bigram_terms = any(" " in t for t in vec)
        terms = F.concat(tok, T.bigrams(tok)) if bigram_terms else tok
        hits = F.filter(terms, lambda t: F.map_contains_key(table, t))
        start = F.array(*[F.lit(int(self.bias.get(c, 0))).cast("long") for c in self.classes])
        return F.aggregate(
            hits, start, lambda acc, t: F.zip_with(acc, F.element_at(table, t), lambda a, b: a + b.cast("long"))
        )

    def with_probabilities(self, df: DataFrame, text_col: str) -> DataFrame:
        out = df.withColumn("_tok", T.tokens(F.col(text_col)))
        out = out.withColumn("logits", self.logits(F.col("_tok"))).drop("_tok")
        out = out.withColumn("_exp", S.softmax_exp(F.col("logits")))
        return out.withColumn("probabilities", S.normalise(F.col("_exp"))).drop("_exp")


def classes_col(model) -> Column:
    return F.array(*[F.lit(c) for c in model.classes])


def score(df: DataFrame, model, text_col: str = "text") -> DataFrame:
    """M6: clean (again, as the reference does), score, argmax and confidence.

    Adds cleaned_text, probabilities, predicted_label, confidence.
    """
    if getattr(model, "model_type", None) not in MODEL_TYPES:
        raise ValueError(f"Unsupported model_type: {getattr(model, 'model_type', None)!r}")
    out = df.withColumn("cleaned_text", T.clean_text(F.col(text_col)))
    out = model.with_probabilities(out, "cleaned_text")
    p = F.col("probabilities")
    return out.withColumn("predicted_label", F.element_at(classes_col(model), S.argmax_index(p))).withColumn(
        "confidence", S.confidence(p)
    )


def prediction_records(scored: DataFrame, model, top_n: int = 3) -> DataFrame:
    """M7: the prediction record per row, with top-n probabilities and confidence band."""
    family = "transformer" if model.model_type == "transformer" else "baseline"
    return scored.select(
        *[c for c in ("row_id",) if c in scored.columns],
        F.col("predicted_label").alias("sentiment"),
        "confidence",
        F.lit(family).alias("model"),
        F.lit(model.model_name).alias("model_name"),
        "cleaned_text",
        S.ranked_probabilities(classes_col(model), F.col("probabilities"), top_n).alias("top_probabilities"),
        S.confidence_band(F.col("confidence")).alias("band"),
    )


# ---------------------------------------------------------------------------
# The frozen function-word scorers used for oracle-checkable
# evaluation (term -> class -> integer weight).
# ---------------------------------------------------------------------------
FUNCTION_WORDS = {
    "the": {"en": 1}, "of": {"en": 1}, "and": {"en": 1},
    "le": {"fr": 1}, "la": {"fr": 1}, "de": {"fr": 1},
    "der": {"de": 1}, "und": {"de": 1}, "nicht": {"de": 1},
    "el": {"es": 1}, "que": {"es": 1}, "los": {"es": 1},
}
ARTICLES = {
    "the": {"en": 1}, "le": {"fr": 1}, "der": {"de": 1}, "el": {"es": 1},
}


def function_word_scorer() -> TermWeightScorer:
    return TermWeightScorer("function_words", FUNCTION_WORDS)


def article_scorer() -> TermWeightScorer:
    return TermWeightScorer("articles", ARTICLES)
