"""Plan-shape checks (what the optimizer must not do) and the delimited source."""

import contextlib
import io

import pytest

from mixtext.operators import features as FE
from mixtext.operators import prep
from mixtext.operators import profile as PR
from mixtext.plans import documents as D
from mixtext.plans import q_io as Q
from mixtext.session import scratch_path, stored_bytes
from mixtext.sources import delimited as DL

from conftest import SF001


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_cleaning_udf_runs_once_and_scan_is_pruned(spark):
    plan = _plan(D.prepared(spark, SF001))
    assert plan.count("ArrowEvalPython (") == 1
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string>" in plan
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_cleaning_chain_is_evaluated_once(spark):
    """P2 sits inside the keep-first aggregate: no Filter re-runs the regex chain."""
    plan = _plan(D.prepared(spark, SF001))
    tree = plan.split("\n\n")[0]
    assert plan.count("https?://") == 1
    assert "Filter" not in tree.split("ArrowEvalPython")[0].rsplit("Aggregate", 1)[-1]


def test_tfidf_never_broadcasts_the_vocabulary(spark):
    train = D.prepared(spark, SF001)
    tf = FE.term_counts(train)
    plan = _plan(FE.tfidf(tf, FE.smoothed_idf(tf, 10)))
    assert "BroadcastHashJoin" not in plan and "CartesianProduct" not in plan


def test_term_pairs_are_counted_without_their_own_shuffle(spark):
    """Only the documents are exchanged (by row_id); the exploded pairs are aggregated
    in the stage that produces them."""
    plan = _plan(FE.term_counts(D.prepared_table(spark, SF001)))
    tree = plan.split("\n\n")[0]
    assert tree.count("Exchange") == 1
    assert tree.index("Generate") < tree.index("Exchange")  # the tree lists the exchange below


def test_split_has_no_unpartitioned_window_over_rows(spark):
    plan = _plan(prep.stratified_split(D.prepared(spark, SF001)))
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_delimited_malformed_and_multiline_rows(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('A,b\nc,d,e\nf,\n"q,1","l1\nl2"\n', encoding="utf-8")
    df = DL.read_delimited(spark, str(path), header=False).drop("_order")
    rows = sorted((r._c0, r._c1) for r in df.collect())
    assert rows == [("A", "b"), ("f", ""), ("q,1", "l1\nl2")]


def test_delimited_widths_and_empty_fields(spark, tmp_path):
    """Too long a row goes even with an empty last field; empty fields stay empty strings and
    keep their column; fields a short row lacks are null; positions count empty columns."""
    path = tmp_path / "in.csv"
    path.write_text('a,b,c\n1,2,3\n1,2,,9\n1,2,3,\n4,,\n5\n"6,6",7\n', encoding="utf-8")
    rows = DL.read_delimited(spark, str(path), header=True).orderBy("_order").drop("_order").collect()
    assert [tuple(r) for r in rows] == [("1", "2", "3"), ("4", "", ""), ("5", None, None), ("6,6", "7", None)]
    path.write_text("x,,hello\ny,,world\n", encoding="utf-8")
    raw, text, label = DL.load_dataset(spark, str(path), text_col="2", label_col="0")
    assert (text, label) == ("_c2", "_c0") and [(r._c0, r._c1, r._c2) for r in raw.orderBy("row_id").collect()] == [("x", "", "hello"), ("y", "", "world")]


def test_column_index():
    index = PR.ColumnIndex(["Id", "The Text", "the_text", "2", "Label "])
    assert [index.find(x) for x in (1, "1", "The Text", " the text ", "LABEL", "2", "9" * 0 + "4")] == [
        "The Text", "The Text", "The Text", "The Text", "Label ", "the_text", "Label "]
    with pytest.raises(ValueError, match="no column 'zzz'"):
        index.find("zzz")
    assert PR.ColumnIndex(["x", "Category", "text", "label"]).among(PR.LABEL_COLUMN_NAMES) == "Category"


def test_separator_probe_prefers_widest(spark, tmp_path):
    path = tmp_path / "semi.csv"
    path.write_text("x;y;z\n1;2;3\n", encoding="utf-8")
    sep, names = DL.choose_separator(spark, str(path), header=True)
    assert sep == ";" and names == ["x", "y", "z"]


def test_separator_probe_reads_first_file_by_name(spark, tmp_path):
    """Under ';' the sorted-first file is 3 wide; the other file would make ',' 4 wide."""
    (tmp_path / "a-7f.csv").write_text("p;q;r\ns;t;u\n", encoding="utf-8")
    (tmp_path / "b-01.csv").write_text("a,b,c,d\n", encoding="utf-8")
    for _ in range(3):
        sep, names = DL.choose_separator(spark, str(tmp_path), header=False)
        assert sep == ";" and len(names) == 3


def test_role_inference_on_headerless_file(spark, tmp_path):
    out = scratch_path(spark, "roles")
    rows = [(f"some longer free text number {i}", "Positive" if i % 3 else "Negative") for i in range(30)]
    spark.createDataFrame(rows, "t string, l string").coalesce(1).write.option("header", False).csv(out)
    raw, text_col, label_col = DL.load_dataset(spark, out)
    assert (text_col, label_col) == ("_c0", "_c1")
    assert raw.count() == 30 and "row_id" in raw.columns


def test_split_does_not_deal_the_rows_by_label(spark):
    """The cut-offs (a row a class) are broadcast: dealt by label, a class would be one task."""
    held = D.prepared_table(spark, SF001)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as on tables past the limit
    try:
        plan = _plan(prep.stratified_split(held)).split("\n\n")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    wide = plan.rsplit("BroadcastHashJoin", 1)[0]  # the tree's top join is that of the wide rows
    assert "BroadcastHashJoin LeftOuter" in plan and wide.count("SortMergeJoin") == 0


def test_delimited_stand_in_has_more_files_for_more_bytes(spark, monkeypatch):
    few = Q._documents_csv(spark, SF001)
    monkeypatch.setattr(Q, "CSV_PART_BYTES", 20_000)
    many = Q._documents_csv(spark, SF001)
    assert len(DL.list_inputs(spark, few)) == 4 < len(DL.list_inputs(spark, many))
    rows = [sorted(map(tuple, DL.read_delimited(spark, p).drop("_order").collect()), key=str) for p in (few, many)]
    assert rows[0] == rows[1] and len(rows[0]) == spark.read.parquet(f"{SF001}/documents.parquet").count()


def test_term_pairs_of_a_task_are_bound_by_stored_bytes(spark, monkeypatch):
    docs = D.prepared_table(spark, SF001)
    whole = sorted(map(tuple, FE.term_counts(docs).collect()))
    monkeypatch.setattr(FE, "TASK_BYTES", stored_bytes(docs) // 40)
    fine = FE.term_counts(docs)
    assert fine.rdd.getNumPartitions() >= 40 and sorted(map(tuple, fine.collect())) == whole
