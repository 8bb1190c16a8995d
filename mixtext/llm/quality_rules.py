"""Quality rules: a threshold table compiled into one projection of text ratios.

Everything is a built-in expression: no Python, no shuffle, no state between rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixtext.llm.common import words

SYMBOLS = r"[#*$%&|<>]+"
WINDOW = 5

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is that it for was on are as with be by this "
    "le la les de des du et un une est en que qui dans pour sur pas "
    "der die das und ist im den von zu mit sich des auf eine ein nicht auch "
    "el los las del y que un una es por con para se al"
).split()


@dataclass(frozen=True)
class Rule:
    """A document keeps when low <= measure <= high (either bound may be open)."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None
    min_words: int = 0  # shorter texts pass: their ratio says little


# The method's verdict on texts that the base rules pass. Ratios of a whole text.
RULES = (
    Rule("word_length", "mean_word_chars", 2.0, 25.0),
    Rule("symbols", "symbols_per_word", None, 0.25),
    Rule("stop_words", "stop_word_ratio", 0.005, None, min_words=100),
    Rule("duplicate_lines", "dup_line_ratio", None, 0.5),
)


def with_windows(docs: DataFrame, array: str, out: str) -> DataFrame:
    """Adds the 64-bit hashes of all 5-word windows, built from pair hashes: (1,2), then
    (1,2)(3,4), then the fifth word. Two hash columns carry it, each computed once."""
    return (docs
            .withColumn("__h", F.expr(f"transform({array}, x -> xxhash64(x))"))
            .withColumn("__p", F.expr("zip_with(__h, slice(__h, 2, size(__h)), (a, b) -> xxhash64(a, b))"))
            .withColumn("__q", F.expr("zip_with(__p, slice(__p, 3, size(__p)), (a, b) -> xxhash64(a, b))"))
            .withColumn(out, F.expr(f"slice(zip_with(__q, slice(__h, {WINDOW}, size(__h)), (a, b) -> xxhash64(a, b)), "
                                    f"1, greatest(size(__h) - {WINDOW - 1}, 0))"))
            .drop("__h", "__p", "__q"))


def repeated_words(windows: str) -> Column:
    """Words lying in a 5-word window that occurs twice or more in the text.

    Windows are compared by their 64-bit hash (a false match inside one text of 20,000 words
    has probability 1e-11). Texts whose windows are all distinct, the common case, stop at
    the distinct count; only the others sort (hash, position) pairs and add up the union of
    the repeated windows.
    """
    pairs = f"sort_array(transform({windows}, (h, i) -> struct(h, i)))"
    # positions of windows equal to a neighbour in hash order, ascending
    starts = (f"transform(array({pairs}), s -> sort_array(transform(filter(s, (x, j) -> "
              f"(j > 0 and x.h = s[greatest(j, 1) - 1].h) or (j + 1 < size(s) and x.h = s[least(j + 1, size(s) - 1)].h)), x -> x.i)))[0]")
    covered = (f"aggregate(transform(array({starts}), p -> transform(p, (a, j) -> "
               f"if(j + 1 < size(p), least({WINDOW}, p[least(j + 1, size(p) - 1)] - a), {WINDOW})))[0], 0L, (acc, x) -> acc + x)")
    return F.expr(f"case when size(array_distinct({windows})) = size({windows}) then 0L else {covered} end")


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` plus the counts and ratios that the rules read (null text: no words)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = with_windows(docs.withColumn("__w", words(F.col(text_col))), "__w", "__v")
    stop = STOP_WORDS + [w.capitalize() for w in STOP_WORDS]
    counted = base.withColumns({
        "n_words": F.size("__w").cast("long"),
        "word_chars": F.char_length(F.array_join("__w", "")).cast("long"),
        "n_symbols": (F.char_length(text) - F.char_length(F.regexp_replace(text, SYMBOLS, ""))).cast("long"),
        "__l": F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        "n_repeat_words": repeated_words("__v"),
        "__stop": F.size(F.filter("__w", lambda w: w.isin(stop))),
    })
    counted = counted.withColumn("n_dup_lines", (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"))
    return counted.withColumns({
        "mean_word_chars": F.try_divide("word_chars", "n_words"),
        "symbols_per_word": F.try_divide("n_symbols", "n_words"),
        "stop_word_ratio": F.try_divide("__stop", "n_words"),
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.size("__l"), F.lit(1)),
    })


def compile_rules(rules: tuple[Rule, ...]) -> Column:
    """Names of the failed rules, as one expression."""
    def fails(r: Rule) -> Column:
        tests = []
        if r.low is not None:
            tests.append(F.col(r.measure) < r.low)
        if r.high is not None:
            tests.append(F.col(r.measure) > r.high)
        failed = F.coalesce(reduce(lambda a, b: a | b, tests), F.lit(False))
        return F.when(failed & (F.col("n_words") >= r.min_words), F.lit(r.name))

    return F.concat_ws(",", *[fails(r) for r in rules])


def quality(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with counts, ``base_failed``, ``kept`` and the failed rules' names.

    Null and empty texts have no words and fail the base; columns of ``docs`` named like an
    added column are replaced; rows are judged one by one, so repeats and ties are alike.
    """
    out = measures(docs, text_col)
    out = out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    out = out.withColumn("failed_rules", compile_rules(rules))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("failed_rules") == ""))
    return out.drop("__w", "__v", "__l", "__stop")
