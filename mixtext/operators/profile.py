"""Profiling and role inference (R1-R6): which column is the text, which the label.

Name-based detection is schema-level; the value profile is ONE aggregate over all
columns (no per-column scans), unpivoted afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixtext.functions import text as T

# Recognised column names and label values of the reference
TEXT_COLUMN_NAMES = ("text", "tweet", "comment", "comments", "content", "sentence", "review", "message", "utterance")
LABEL_COLUMN_NAMES = ("sentiment", "label", "labels", "category", "class", "target", "outcome", "polarity")
KNOWN_LABEL_VALUES = (
    "positive", "negative", "neutral", "mixed_feelings", "mixed feelings",
    "not-tamil", "not tamil", "unknown_state", "unknown state",
)

SKETCH_LG_K = 12  # 4,096 registers a column: a standard error of 1.6 %


class ColumnIndex:
    """The columns of a table by position, exact name and normalised name (R2).

    Names that several columns share stand for the first of them.
    """

    def __init__(self, names: list[str]):
        self.names = list(names)
        self.exact: dict[str, int] = {}
        self.normal: dict[str, int] = {}
        for place, name in enumerate(self.names):
            self.exact.setdefault(name, place)
            self.normal.setdefault(T.normalize_name_py(name), place)

    def find(self, selector: int | str) -> str:
        wanted = str(selector).strip()
        if wanted.isdecimal() and int(wanted) < len(self.names):
            return self.names[int(wanted)]
        places = {self.exact.get(wanted), self.normal.get(T.normalize_name_py(wanted))} - {None}
        if not places:
            raise ValueError(f"no column {selector!r}: give a position below {len(self.names)} or one of {self.names}")
        return self.names[min(places)]

    def among(self, known: tuple[str, ...]) -> str | None:
        """The first column whose normalised name is one of ``known``."""
        places = [self.normal[k] for k in known if k in self.normal]
        return self.names[min(places)] if places else None


def resolve_column(df: DataFrame, selector) -> str | None:
    """R2: the column that a position or name stands for; nothing for no selector."""
    return None if selector is None else ColumnIndex(df.columns).find(selector)


def named_roles(df: DataFrame) -> tuple[str | None, str | None]:
    """The columns with a known text name and a known label name."""
    index = ColumnIndex(df.columns)
    return index.among(TEXT_COLUMN_NAMES), index.among(LABEL_COLUMN_NAMES)


def label_likeness(df: DataFrame) -> DataFrame:
    """Per column (position, known-label hits, distinct ratio, mean stripped length).

    One pass in long form: every value becomes (position, 128-bit digest, length), digests
    are grouped with map-side combine, and k rows are left. Whole values are not shuffled.
    """
    named = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("column_name"),
                               T.py_strip(T.null_to_empty(F.col(c))).alias("v")) for i, c in enumerate(df.columns)])
    values = df.select(F.explode(named).alias("x")).select(
        "x.position", "x.column_name", F.md5("x.v").alias("digest"), F.length("x.v").cast("long").alias("length"),
        F.lower("x.v").isin(*KNOWN_LABEL_VALUES).alias("known"))
    distinct = values.groupBy("position", "column_name", "digest").agg(
        F.count("*").alias("n"), F.sum("length").alias("length"), F.count_if("known").alias("hits"))
    found = distinct.groupBy("position", "column_name").agg(
        F.sum("hits").alias("known_hits"), (F.count("*") / F.sum("n")).alias("unique_ratio"),
        (F.sum("length") / F.sum("n")).alias("mean_length"))
    # a table without rows still has its columns
    every = df.sparkSession.createDataFrame([(i, c, 0, 0.0, 0.0) for i, c in enumerate(df.columns)],
                                            "position int, column_name string, known_hits long, unique_ratio double, mean_length double")
    return every.unionByName(found).groupBy("column_name", "position").agg(
        F.max("known_hits").alias("known_hits"), F.max("unique_ratio").alias("unique_ratio"), F.max("mean_length").alias("mean_length"))


def infer_roles(profile: DataFrame) -> DataFrame:
    """label = min by (-hits, ratio, mean length, position); text = max of the other
    columns by (mean length, ratio, -hits), first column on ties. One row."""
    label_key = F.struct(-F.col("known_hits"), F.col("unique_ratio"), F.col("mean_length"), F.col("position"))
    label = F.min_by(F.struct("column_name", "position"), label_key)
    text_key = F.struct("mean_length", "unique_ratio", -F.col("known_hits"), -F.col("position"), "column_name")
    # k rows, one aggregate: the best text column and, should it be the label, the runner-up
    both = profile.agg(label.alias("label"), F.slice(F.sort_array(F.collect_list(text_key), asc=False), 1, 2).alias("texts"))
    pick = F.get(F.filter("texts", lambda t: t["column_name"] != F.col("label.column_name")), F.lit(0))["column_name"]
    return both.select(pick.alias("text_column"), F.col("label.column_name").alias("label_column"))


def _overlapping(columns: list[dict]) -> list[str]:
    """Names of the columns whose distinct counts may be the least one of the list."""
    if len(columns) < 2:
        return []
    reach = min(c["high"] for c in columns)
    near = [c["name"] for c in columns if c["low"] <= reach]
    return near if len(near) > 1 else []


def sketched_likeness(df: DataFrame, lg_k: int = SKETCH_LG_K) -> DataFrame:
    """R4 with distinct counts by sketch where only their rough size matters.

    One aggregate over whole rows: a task sends counts, sums and one sketch of 2^lg_k bytes at
    most for each column. Distinct values are then counted exactly for the columns whose ratios
    can decide a role: those level in known hits (label) or in length (text) whose error bars,
    four standard errors wide, overlap. Other ratios are estimates. Null counts as empty; a
    table without rows gives zeros.
    """
    names = df.columns
    values = df.select(*[T.py_strip(T.null_to_empty(F.col(c))).alias(f"v{i}") for i, c in enumerate(names)])
    stats = [F.count(F.lit(1)).alias("n")]
    for i in range(len(names)):
        v = F.col(f"v{i}")
        # hashed, because sketches leave out empty strings
        stats += [F.hll_sketch_estimate(F.hll_sketch_agg(F.xxhash64(v), F.lit(lg_k))).alias(f"d{i}"),
                  F.count_if(F.lower(v).isin(*KNOWN_LABEL_VALUES)).alias(f"h{i}"), F.sum(F.length(v).cast("long")).alias(f"l{i}")]
    row = values.agg(*stats).first()  # a few numbers for each column
    n, width = row["n"], 4 * 1.04 / 2 ** (lg_k / 2)
    found = [{"name": c, "hits": row[f"h{i}"], "length": row[f"l{i}"] or 0, "about": row[f"d{i}"] or 0,
              "low": (row[f"d{i}"] or 0) * (1 - width), "high": (row[f"d{i}"] or 0) * (1 + width)} for i, c in enumerate(names)]
    top = max((c["hits"] for c in found), default=0)
    exact = set(_overlapping([c for c in found if c["hits"] == top]))
    for length in {c["length"] for c in found}:
        level = [c for c in found if c["length"] == length]
        # the largest ratio decides between texts: any two bars that meet are enough to count
        if any(a["low"] <= b["high"] and b["low"] <= a["high"] for j, a in enumerate(level) for b in level[:j]):
            exact |= {c["name"] for c in level}
    ratios = {r["column_name"]: r["unique_ratio"] for r in label_likeness(df.select(*[c for c in names if c in exact])).collect()} if n and exact else {}
    rows = [(c["name"], i, c["hits"], ratios.get(c["name"], c["about"] / n if n else 0.0), c["length"] / n if n else 0.0)
            for i, c in enumerate(found)]
    return df.sparkSession.createDataFrame(rows, "column_name string, position int, known_hits long, unique_ratio double, mean_length double")


def infer_columns(df: DataFrame) -> tuple[str, str]:
    """(text, label): by names if both are known ones (R3), else by what the values look like."""
    by_name = named_roles(df)
    if all(by_name):
        return by_name
    if len(df.columns) == 1:
        raise ValueError(f"two columns are needed, one for texts and one for labels; there is only {df.columns[0]!r}")
    found = infer_roles(sketched_likeness(df)).first()  # two names
    return found["text_column"], found["label_column"]


def inspect(prepared: DataFrame, n: int = 5) -> DataFrame:
    """The first rows in input order."""
    return prepared.orderBy("row_id").limit(n)
