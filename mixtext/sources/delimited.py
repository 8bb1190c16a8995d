"""Delimited-file sources (S1-S4): separator probing, header decision, one full scan,
all-null column pruning."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from mixtext.operators import profile as PR
from mixtext.session import materialize

# Separators tried after the sniffed one, in order (first wins ties)
SEPARATORS = ("\t", ",", ";", "|")
SNIFF_CANDIDATES = (",", "\t", ";", "|", ":")
PROBE_LINES = 64
CORRUPT = "_corrupt_record"


def list_inputs(spark: SparkSession, directory: str, pattern: str = "*.csv") -> list[str]:
    """Matching files by sorted path (metadata only; file contents are not read)."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(directory)
        .select("path").orderBy("path")
    )
    paths = [r[0] for r in files.collect()]  # a file listing, not data rows
    if not paths:
        raise FileNotFoundError(f"No {pattern} found in {directory}")
    return paths


def first_file(spark: SparkSession, path: str) -> str:
    """The first input file by sorted path (a listing: file contents are not read).

    The separator probes read this file only. Spark's own "first record" of a
    directory comes from whichever file lands first in a combined split, which varies
    with file names (Spark's part files carry random ids), so the decision would too.
    """
    rows = spark.read.format("binaryFile").load(path).select("path").orderBy("path").limit(1).collect()
    return rows[0][0] if rows else path


def _probe_lines(spark: SparkSession, path: str) -> list[str]:
    # a bounded probe: the first lines only, never the whole file
    return [r[0] for r in spark.read.text(path).limit(PROBE_LINES).collect()]


def sniff(lines: list[str]) -> str | None:
    """The candidate that splits the probe lines into the same (> 1) number of parts."""
    best = None
    for sep in SNIFF_CANDIDATES:
        counts = {ln.count(sep) for ln in lines if ln}
        if len(counts) == 1 and next(iter(counts)) > 0:
            n = next(iter(counts))
            if best is None or n > best[1]:
                best = (sep, n)
    return best[0] if best else None


def _reader(spark: SparkSession, sep: str, header: bool):
    return (
        spark.read.option("sep", sep).option("header", header).option("multiLine", True)
        .option("escape", '"').option("quote", '"').option("inferSchema", False)
    )


def width(spark: SparkSession, path: str, sep: str, header: bool) -> tuple[int, list[str]]:
    """Columns of the first record under ``sep`` (schema probe reads one record)."""
    schema = _reader(spark, sep, header).csv(path).schema
    return len(schema.fields), [f.name for f in schema.fields]


def choose_separator(spark: SparkSession, path: str, header: bool) -> tuple[str, list[str]]:
    """S1 decision: sniffed separator first, then tab, comma, semicolon, pipe; widest wins,
    earlier attempt wins ties."""
    attempts = []
    path = first_file(spark, path)
    sniffed = sniff(_probe_lines(spark, path))
    if sniffed is not None:
        attempts.append(sniffed)
    attempts += list(SEPARATORS)
    best = None
    for sep in attempts:
        n, names = width(spark, path, sep, header)
        if best is None or n > best[1]:
            best = (sep, n, names)
    return best[0], best[2]


def _fields(record, sep: str):
    """Number of fields of a raw record: separators outside quoted parts, plus one (a part
    still open at the end of a line counts up to there)."""
    bare = F.regexp_replace(record, '"[^"]*("|$)', "")
    return F.size(F.split(bare, re.escape(sep), -1))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Physical lines with the byte block that each begins in: many tasks for one file."""
    place = [F.col(f"_metadata.file_{c}").alias(n) for c, n in (("path", "file"), ("block_start", "block"), ("block_length", "size"))]
    return spark.read.option("lineSep", "\n").text(path).select(*place, "value")


def separators(lines: DataFrame) -> DataFrame:
    """(file, sep): each file's separator, by the votes of all its lines.

    The candidate that parts every line of the file alike, into the most parts, is tried
    first, then SEPARATORS; the one that makes the file's first line widest wins, the earlier
    one of equals. One aggregate for all files.
    """
    counts = {s: F.size(F.split("value", re.escape(s), -1)) - 1 for s in SNIFF_CANDIDATES}
    votes = lines.where("value NOT IN ('', '\\r')").withColumn("__at", F.struct("block", F.monotonically_increasing_id())) \
        .groupBy("file").agg(F.min_by("value", "__at").alias("first"),
                             *[f(c).alias(f"{n}{i}") for i, c in enumerate(counts.values()) for n, f in (("low", F.min), ("high", F.max))])
    alike = F.filter(F.array(*[F.struct((-F.col(f"low{i}")).alias("n"), F.lit(i).alias("i"), F.lit(s).alias("sep"),
                                        (F.col(f"low{i}") == F.col(f"high{i}")).alias("same")) for i, s in enumerate(SNIFF_CANDIDATES)]),
                     lambda x: x["same"] & (x["n"] < 0))
    tried = votes.withColumn("sniffed", F.array_min(alike)["sep"])
    wide = [F.struct((-_fields(F.col("first"), s)).alias("w"), F.when(F.col("sniffed") == s, -1).otherwise(i).alias("i"), F.lit(s).alias("sep"))
            for i, s in enumerate(SEPARATORS)]
    colon = F.when(F.col("sniffed") == ":", F.struct((-_fields(F.col("first"), ":")).alias("w"), F.lit(-1).alias("i"), F.lit(":").alias("sep")))
    return tried.select("file", F.array_min(F.array(*wide, colon))["sep"].alias("sep"))


CLOSING = re.compile(r'[^"]*(?:""[^"]*)*"(?!")')  # from inside a quoted field to its closing quote


def ends_inside(line: str, sep: str, inside: bool) -> bool:
    """Whether a quoted field is open behind the line, given whether one is open before it. A
    quote opens a field only at the field's start; doubled quotes stand for one."""
    if '"' not in line:
        return inside
    at = 0
    if inside or line.startswith('"'):
        if (m := CLOSING.match(line, 0 if inside else 1)) is None:
            return True
        at = m.end()
    while (at := line.find(sep + '"', at)) >= 0:
        if (m := CLOSING.match(line, at + len(sep) + 1)) is None:
            return True
        at = m.end()
    return False


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[str]]]:
    """((file, block, size, *rest), some lines of that block in order), batch by batch."""
    for b in batches:
        blocks = b.column("block").to_numpy()
        files = b.column("file").dictionary_encode().indices.to_numpy()
        cuts = [0, *(np.flatnonzero((np.diff(blocks) != 0) | (np.diff(files) != 0)) + 1).tolist(), b.num_rows]
        values = b.column("value").to_pylist()
        others = [b.column(i) for i, n in enumerate(b.schema.names) if n != "value"]
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            if y > x:
                yield tuple(c[x].as_py() for c in others), values[x:y]


BLOCK = "file string, block long, size long, n long, end0 boolean, end1 boolean, head string, tail0 string, since0 long, tail1 string, since1 long"
_KINDS = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}


def _arrow(ddl: str) -> pa.Schema:
    """The Arrow form of a flat schema (tasks have no session to ask)."""
    return pa.schema([(n, _KINDS[kind]) for n, kind in (f.split() for f in ddl.split(","))])


class _BlockScan:
    """A block read in both quote states: 0 begins between records, 1 inside a quoted field."""

    def __init__(self, key: tuple):
        self.key, self.n, self.head = key, 0, None
        self.inside, self.open, self.since = [False, True], [[], []], [0, -1]

    def add(self, lines: list[str]) -> None:
        sep = self.key[3]
        for line in lines:
            for s in (0, 1):
                was = self.inside[s]
                now = self.inside[s] = ends_inside(line, sep, was)
                if not was and now:
                    self.open[s], self.since[s] = [line], self.n
                elif was:
                    self.open[s].append(line)
                    if not now:
                        if self.since[s] < 0:  # it began before the block
                            self.head = "\n".join(self.open[s])
                        self.open[s] = []
            self.n += 1

    def row(self) -> dict:
        out = dict(zip(("file", "block", "size"), self.key[:3], strict=True), n=self.n, head=self.head)
        for s in (0, 1):
            out |= {f"end{s}": self.inside[s], f"tail{s}": "\n".join(self.open[s]) if self.inside[s] else None, f"since{s}": self.since[s]}
        return out


def _scan_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = _arrow(BLOCK)
    scan = None
    for key, lines in _runs(batches):
        if scan is None or scan.key != key:
            if scan is not None:
                yield pa.RecordBatch.from_pylist([scan.row()], schema)
            scan = _BlockScan(key)
        scan.add(lines)
    if scan is not None:
        yield pa.RecordBatch.from_pylist([scan.row()], schema)


STATE = "file string, block long, size long, n long, inside boolean, pos long, record string"


def _states(blocks: pd.DataFrame) -> pd.DataFrame:
    """One file's blocks in order: the state each begins in, and the records that cross a
    border, put together from their pieces (rows with a ``record``)."""
    out, inside, home, pieces = [], False, None, []
    for b in blocks.sort_values("block").itertuples():
        out.append((b.file, b.block, b.size, b.n, inside, None, None))
        if inside and b.head is None:
            pieces.append(b.tail1)  # all of the block lies inside the field
            continue
        if inside:
            out.append((b.file, home[0], None, None, None, home[1], "\n".join([*pieces, b.head])))
        inside, tail, since = (b.end1, b.tail1, b.since1) if inside else (b.end0, b.tail0, b.since0)
        home, pieces = (b.block, since), [tail]
    if inside:  # a field never closed ends with its file
        out.append((blocks["file"].iloc[0], home[0], None, None, None, home[1], "\n".join(pieces)))
    table = pd.DataFrame(out, columns=["file", "block", "size", "n", "inside", "pos", "record"])
    return table.astype({"size": "Int64", "n": "Int64", "pos": "Int64", "inside": "boolean"})


RECORD = "at long, first boolean, sep string, record string"


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records that lie in one block, at their line's number; ``first``: of the file."""
    schema = _arrow(RECORD)
    key, n, inside, held, since, begun = None, 0, False, None, 0, False
    for now, lines in _runs(batches):
        if now != key:
            key, n, inside, held, begun = now, 0, now[4], None, now[1] > 0
        _, _, _, sep, _, base = key
        at, first, records = [], [], []
        for line in lines:
            was, inside = inside, ends_inside(line, sep, inside)
            if not was:
                held, since = [line], n
            elif held is not None:
                held.append(line)
            if not inside:
                if held is not None and (len(held) > 1 or line not in ("", "\r")):
                    at.append(base + since)
                    first.append(not begun)
                    records.append("\n".join(held))
                    begun = True
                held = None
            n += 1
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(first, pa.bool_()), pa.array([sep] * len(at), pa.string()),
                                          pa.array(records, pa.string())], schema=schema)


def records(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """(at, first, sep, record): the raw records of delimited files, with ``at`` rising in file
    order, scanned block by block although quoted fields may hold line breaks.

    Two scans: the first reads every block in both quote states, the product of the blocks'
    outcomes tells the state each begins in (one row a block), the second puts records
    together. Line ends are \\n or \\r\\n. Empty lines between records are left out.
    """
    lines = _lines(spark, path)
    if sep is None:
        lines = lines.join(F.broadcast(materialize(separators(lines), "separators")), "file")  # one row a file
        lines = lines.select("file", "block", "size", "sep", "value")
    else:
        lines = lines.select("file", "block", "size", F.lit(sep).alias("sep"), "value")
    known = materialize(lines.mapInArrow(_scan_blocks, BLOCK).groupBy("file").applyInPandas(_states, STATE), "block-states")
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    begins = materialize(known.where("record IS NULL").withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
                         .select("file", "block", "size", "inside", "base"), "block-begins")
    # a block cut otherwise than in the first scan must not pass unseen
    found = lines.join(F.broadcast(begins), ["file", "block", "size"], "left") \
        .withColumn("inside", F.coalesce("inside", F.raise_error(F.lit("a block was cut differently in the second scan")).cast("boolean")))
    inner = found.select("file", "block", "size", "sep", "inside", "base", "value").mapInArrow(_assemble, RECORD)
    of_file = lines.select("file", "sep").distinct() if sep is None else begins.select("file", F.lit(sep).alias("sep")).distinct()
    crossing = known.where("record IS NOT NULL").join(begins.select("file", "block", "base"), ["file", "block"])
    crossing = crossing.join(F.broadcast(of_file), "file") \
        .select((F.col("base") + F.col("pos")).alias("at"), ((F.col("block") == 0) & (F.col("pos") == 0)).alias("first"), "sep", "record")
    return inner.unionByName(crossing)


def read_delimited(spark: SparkSession, path: str, header: bool = False, sep: str | None = None) -> DataFrame:
    """All-string columns in file order (``_order``), each file with its own separator.

    The columns are those of the first file's first record. Rows with more fields are
    dropped, empty fields are empty strings, and only fields that a short row does not have are
    null. With ``header`` the first record of each file is left out.
    """
    if sep is None:
        names = choose_separator(spark, path, header)[1]
    else:
        names = width(spark, first_file(spark, path), sep, header)[1]
    if not header:
        names = [f"_c{i}" for i in range(len(names))]
    schema = StructType([StructField(f"f{i}", StringType()) for i in range(len(names))] + [StructField(CORRUPT, StringType())]).simpleString()[7:-1].replace(":", " ")
    found = records(spark, path, sep)
    if header:
        found = found.where("NOT first")
    found = found.withColumn("record", F.regexp_replace(F.regexp_replace("record", "\r$", ""), "\r\n", "\n"))
    used = [sep] if sep is not None else list(SNIFF_CANDIDATES)

    def parsed(s: str):
        return F.from_csv("record", schema, {"sep": s, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})

    row, present = F.lit(None), F.lit(None)
    for s in used:
        row = F.when(F.col("sep") == s, parsed(s)).otherwise(row)
        present = F.when(F.col("sep") == s, _fields(F.col("record"), s)).otherwise(present)
    df = found.withColumn("__row", row)
    df = df.withColumn("__present", F.when(F.col(f"__row.{CORRUPT}").isNull(), len(names)).otherwise(present)).where(F.col("__present") <= len(names))
    return df.select(F.col("at").alias("_order"), *[F.when(F.col("__present") > i, F.coalesce(F.col(f"__row.f{i}"), F.lit(""))).alias(n)
                                                   for i, n in enumerate(names)])


def prune_null_columns(df: DataFrame, keep=("_order", "row_id")) -> DataFrame:
    """Drop columns that are null in every row (one aggregate for all columns)."""
    cols = [c for c in df.columns if c not in keep]
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in cols]).first()  # one count per column
    if counts is None or all(counts[c] == 0 for c in cols):
        raise ValueError("Could not read a non-empty delimited input")
    return df.select(*[c for c in df.columns if c in keep or counts[c] > 0])


def _roles(raw: DataFrame, selectors: tuple) -> tuple[str, str] | None:
    """Text and label column of a table: selected, else named, else (headerless) profiled."""
    data = raw.drop("_order")
    chosen = tuple(PR.resolve_column(data, s) for s in selectors)
    if None not in chosen:
        return chosen
    guessed = PR.infer_columns(data)
    return tuple(c or g for c, g in zip(chosen, guessed, strict=True))


def load_dataset(spark: SparkSession, path: str, text_col=None, label_col=None) -> tuple[DataFrame, str, str]:
    """S3 + R2-R5: decide header mode, resolve or infer the roles, return the raw table
    with ``row_id`` plus the chosen text and label column names.

    A selected column tells the header mode (a position: none). Without one, the first
    record is a header if it names both roles: that needs the record alone, not a scan.
    Positions count all columns; empty ones are pruned afterwards.
    """
    selectors = (text_col, label_col)
    given = [str(s) for s in selectors if s is not None]
    if given:
        header = not given[0].isdigit()
    else:
        names = choose_separator(spark, path, True)[1]
        index = PR.ColumnIndex(names)
        header = None not in (index.among(PR.TEXT_COLUMN_NAMES), index.among(PR.LABEL_COLUMN_NAMES))
    raw = read_delimited(spark, path, header=header)
    text, label = PR.named_roles(raw.drop("_order")) if header and not given else _roles(raw, selectors)
    return with_row_id(prune_null_columns(raw)), text, label


def with_row_id(raw: DataFrame) -> DataFrame:
    """File-order ``row_id`` (long, increasing, not dense): the number of the record's first
    line, which the scan has from the blocks' line counts; nothing is sorted."""
    return raw.withColumnRenamed("_order", "row_id")
