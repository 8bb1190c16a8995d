"""The block-wise scan of delimited files against Python's csv reader and Spark's whole-file one."""

import csv
import io
import random

import pytest

from mixtext.sources import delimited as DL


def crafted(rng, sep, n):
    """Records with quoted line breaks, separators and quotes; and their fields."""
    def field():
        kind = rng.random()
        if kind < 0.5:
            return "".join(rng.choice("abc xyz'") for _ in range(rng.randint(1, 12)))
        if kind < 0.6:
            return ""
        return "".join(rng.choice(['a', 'b ', '"', '""', sep, '\n', '\n\n', ',', f'{sep}"', f'"{sep}', '"\n']) for _ in range(rng.randint(1, 9)))

    rows = [[f"k{i}", field(), field()] for i in range(n)]
    out = io.StringIO()
    csv.writer(out, delimiter=sep, lineterminator="\n").writerows(rows)
    return out.getvalue(), rows


@pytest.fixture
def small_blocks(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
    spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def test_ends_inside_tells_open_fields():
    for line, from_out, from_in in (('a,b', False, True), ('"a', True, False), ('"a"', False, False), ('a"b,c', False, False), ('a,"b', True, False),
                                    ('"a""', True, False), ('"""a"""', False, False), (',"",', False, True), ('"a","b', True, True), ('x","y"', False, False)):
        assert DL.ends_inside(line, ",", False) == from_out, line
        assert DL.ends_inside(line, ",", True) == from_in, line


@pytest.mark.parametrize("header", [False, True])
def test_split_scan_equals_whole_file_parsing(spark, tmp_path, small_blocks, header):
    rng = random.Random(4)
    want = []
    for name, sep in (("a.csv", ","), ("b.csv", ";"), ("c.csv", "\t"), ("d.csv", ",")):
        text, rows = crafted(rng, sep, 120)
        if header:
            text = sep.join(["id", "one", "two"]) + "\n" + text
        (tmp_path / name).write_text(text, encoding="utf-8")
        want += rows
    df = DL.read_delimited(spark, str(tmp_path), header=header)
    assert DL._lines(spark, str(tmp_path)).rdd.getNumPartitions() > 50  # one file gives many tasks
    got = [list(r)[1:] for r in df.orderBy("_order").collect()]
    assert df.columns[1:] == (["id", "one", "two"] if header else ["_c0", "_c1", "_c2"])
    assert got == want
    assert len({r._order for r in df.select("_order").collect()}) == len(want)


def test_a_field_over_many_blocks_and_one_never_closed(spark, tmp_path, small_blocks):
    long = "\n".join(f"line {i}, with \"\"quotes\"\"" for i in range(60))
    (tmp_path / "a.csv").write_text(f'1,"{long}"\r\n2,"x\r\ny"\r\n\r\n3,"{long}"\n4,z\n5,"open\nto the end', encoding="utf-8")
    got = [tuple(r)[1:] for r in DL.read_delimited(spark, str(tmp_path), sep=",").orderBy("_order").collect()]
    plain = long.replace('""', '"')
    assert got[:4] == [("1", plain), ("2", "x\ny"), ("3", plain), ("4", "z")]
    assert len(got) == 5 and got[4][0] == "5"


def test_separator_is_decided_by_all_lines_of_each_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a;b,c\n" * 3, encoding="utf-8")
    (tmp_path / "b.csv").write_text("a,b;c,d\n" + "a,b,c\n" * 200, encoding="utf-8")
    (tmp_path / "c.csv").write_text("a:b\nc:d\n", encoding="utf-8")
    (tmp_path / "d.csv").write_text("just text\n", encoding="utf-8")
    (tmp_path / "e.csv").write_text('"1";"en";"x, y, z, and\nmore, of it"\n"2";"fr";"u"\n', encoding="utf-8")
    lines = DL._lines(spark, str(tmp_path))
    got = {r.file.rsplit("/", 1)[1]: r.sep for r in DL.separators(lines).collect()}
    assert got == {"a.csv": ",", "b.csv": ",", "c.csv": ":", "d.csv": "\t", "e.csv": ";"}
