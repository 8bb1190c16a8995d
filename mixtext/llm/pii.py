"""Personal data: patterns propose spans, checksums confirm them, context adjusts the score.

Built-in expressions only. A pattern's matches are ``regexp_extract_all``; the text between
them is ``split`` by the same pattern, so a running sum of both lengths gives each match's
place in code points. Patterns are written so that a scan is linear: a run of characters is
entered at its start only (look-behind, or ``\\G`` right after the last match) and left
possessively, which cannot change what matches because no run can end earlier.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOCAL = "A-Za-z0-9._%+-"


@dataclass(frozen=True)
class Kind:
    """``guard``: a cheap necessary condition on the text. ``score``: before the context
    (checksummed kinds start higher). ``near``: words that raise the score when they stand
    within CONTEXT code points before the span."""

    name: str
    pattern: str
    guard: str
    score: int
    near: str


CONTEXT = 40
NEAR_BONUS = 20

EMAIL = Kind("email", rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 75, "mail|contact|courriel|correo|kontakt")
IP = Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]", 60, "address|host|server|login")
# at least 13 digits: a maximal run with fewer can hold no card
CARD = Kind("card", r"(?<![0-9])[0-9](?:[ -]?+[0-9]){12,}+", "[0-9]", 70, "card|visa|credit|carte|tarjeta|karte|payment")
PHONE = Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]", 60, "phone|call|tel|mobile|fax")
# the added kind: two letters, two check digits, 11 to 30 letters or digits, mod 97 = 1
IBAN = Kind("iban", r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}+(?![A-Za-z0-9_])", "[A-Z]{2}[0-9]{2}", 80, "iban|bank|account|konto|compte|cuenta")
KINDS = (EMAIL, IP, CARD, PHONE, IBAN)
BASE = ("email", "ip", "card", "phone")


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Luhn checksum of a string of digits, right to left, every second digit doubled."""
    places = F.sequence(F.lit(1), F.length(number))
    total = F.aggregate(places, F.lit(0), lambda acc, i: acc + F.when(
        (F.length(number) - i) % 2 == 0, F.substring(number, i, F.lit(1)).cast("int"))
        .otherwise(F.substring(number, i, F.lit(1)).cast("int") * 2 - F.when(F.substring(number, i, F.lit(1)) >= "5", 9).otherwise(0)))
    return total % 10 == 0


def mod97(iban: Column) -> Column:
    """ISO 7064 check: first four characters to the end, letters as 10..35, remainder 1."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))
    places = F.sequence(F.lit(1), F.length(turned))

    def step(acc: Column, i: Column) -> Column:
        code = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(code >= 65, (acc * 100 + code - 55) % 97).otherwise((acc * 10 + code - 48) % 97)

    return F.aggregate(places, F.lit(0), step) == 1


def octets(ip: Column) -> Column:
    """All four parts at most 255 (leading zeros do not count)."""
    return F.forall(F.split(ip, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike(r"^([0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return octets(match)
    if kind == "card":
        n = digits(match)
        return F.length(n).between(13, 19) & luhn(n)
    if kind == "phone":
        return F.length(digits(match)).between(9, 15)
    if kind == "iban":
        return mod97(match)
    return F.lit(True)


def spans(text: Column, kind: Kind) -> Column:
    """array<struct<kind, start, end, score>> of the valid matches, in text order.

    Only valid matches are carried along, the rest just advance the place. Offsets are code
    points, ends exclusive.
    """
    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    gaps = F.split(text, kind.pattern, -1)
    pieces = F.zip_with(matches, F.slice(gaps, F.lit(1), F.size(matches)), lambda m, g: F.struct(m.alias("m"), F.length(g).alias("g")))
    empty = F.expr("cast(array() as array<struct<kind:string,start:int,end:int>>)")
    start = F.struct(F.lit(0).alias("at"), empty.alias("found"))

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + p["g"]
        end = begin + F.length(p["m"])
        one = F.array(F.struct(F.lit(kind.name).alias("kind"), begin.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(valid(kind.name, p["m"]), F.concat(acc["found"], one)).otherwise(acc["found"]).alias("found"))

    found = F.aggregate(pieces, start, step, lambda acc: acc["found"])

    def scored(s: Column) -> Column:
        before = F.greatest(s["start"] - CONTEXT, F.lit(0))
        context = F.lower(F.substring(text, before + 1, s["start"] - before))
        return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
                        (F.lit(kind.score) + F.when(context.rlike(kind.near), NEAR_BONUS).otherwise(0)).alias("score"))

    none = F.expr("cast(array() as array<struct<kind:string,start:int,end:int,score:int>>)")
    return F.when(text.rlike(kind.guard), F.transform(found, scored)).otherwise(none)


def personal_data(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` plus ``pii``: all spans by kind as listed in KINDS, then by start.

    Null and empty texts have none; a span is reported once per kind (kinds may overlap);
    rows are independent, so repeated rows give repeated results; a column of ``docs`` named
    ``pii`` is replaced. Base kinds are never dropped for a low score.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumn("pii", F.concat(*[spans(text, k) for k in KINDS]))


def span_list(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")


def redact(docs: DataFrame, text_col: str = "text", min_score: int = 0) -> DataFrame:
    """``docs`` with every span of at least ``min_score`` replaced by ``<KIND>``.

    Overlapping spans count as one: the one that starts first (longer on ties) names it.
    """
    found = personal_data(docs, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    ordered = F.array_sort(F.filter("pii", lambda s: s["score"] >= min_score),
                           lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate(ordered, start, lambda acc, s: F.struct(
        F.greatest(acc["at"], s["end"]).alias("at"),
        F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(
            acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))).alias("out")))
    return (found.withColumn("__d", done)
            .withColumn(text_col, F.when(F.size("pii") == 0, F.col(text_col)).otherwise(
                F.concat(F.col("__d.out"), F.substring(text, F.col("__d.at") + 1, F.length(text)))))
            .drop("__d"))
