"""Split reading of CSV files against Spark's reading of whole files."""

import random

import pytest

from seamstat.sources import csv_records as cr

SPLIT = {"spark.sql.files.maxPartitionBytes": "97b", "spark.sql.files.openCostInBytes": "0b"}


@pytest.fixture
def small_splits(spark):
    before = {name: spark.conf.get(name) for name in SPLIT}
    for name, value in SPLIT.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def random_csv(seed: int, rows: int) -> str:
    """Fields that are plain, quoted, or quoted with separators, doubled quotes and line breaks."""
    draw = random.Random(seed)
    inner = ["a", "é", " ", ",", '""', "\n", "\r\n", "x" * 7, ".", "1"]
    out = []
    for _ in range(rows):
        fields = []
        for _ in range(3):
            size = draw.choice([0, 1, 3, 8, 40]) if draw.random() < 0.9 else 200
            if draw.random() < 0.5:
                fields.append("".join(draw.choice("abcé 1.") for _ in range(size)).strip())
            else:
                fields.append('"' + "".join(draw.choice(inner) for _ in range(size)) + '"')
        out.append(",".join(fields))
    return "\n".join(["id,text,more", *out]) + draw.choice(["", "\n", "\n\n"])


def as_one_task(spark, path):
    return spark.read.options(header=True, multiLine=True, quote='"', escape='"').csv(path)


def rows_of(frame):
    return sorted([tuple(r) for r in frame.collect()], key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_equals_the_read_by_one_task_on_random_quoting(spark, small_splits, tmp_path, seed):
    for i in range(2):
        (tmp_path / f"{i}.csv").write_bytes(random_csv(10 * seed + i, 60).encode())
    path = str(tmp_path)
    got = cr.read_csv_records(spark, path)
    assert spark.read.text(path, lineSep="\n").rdd.getNumPartitions() > 10
    want = as_one_task(spark, path)
    assert got.columns == want.columns == ["id", "text", "more"]
    assert rows_of(got) == rows_of(want)


def test_records_over_many_splits_and_an_open_quote(spark, small_splits, tmp_path):
    long = "line\n" * 200
    (tmp_path / "a.csv").write_text(f'a,b\n1,"{long}"\n2,plain\n"3\n{long}","{long}"\n4,x"y\n5,"q"rest\n6,z\n7,"never closed\nend')
    path = str(tmp_path / "a.csv")
    got = rows_of(cr.read_csv_records(spark, path))
    assert got == rows_of(as_one_task(spark, path)) and len(got) == 7
    assert ("1", long) in got and ("4", 'x"y') in got


def test_blank_files_windows_ends_and_other_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("\ufeffa,b\r\n1,\"x\r\ny\"\r\n\r\n2,\r\n".encode())
    assert rows_of(cr.read_csv_records(spark, str(tmp_path))) == [("1", "x\ny"), ("2", None)]
    (tmp_path / "b.csv").write_text("a,c\n1,2\n")
    with pytest.raises(Exception, match="the header of"):
        cr.read_csv_records(spark, str(tmp_path)).collect()
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "c.csv").write_text("")
    assert cr.read_csv_records(spark, str(tmp_path / "empty")).collect() == []


@pytest.mark.parametrize(
    "line, outside, inside",
    [("a,b", False, True), ('"a', True, False), ('a","b', True, True), ('"a""', True, False), ('""', False, True), ('x"y,z', False, False),
     ('"a"b,"c', True, True), ('","', False, True), ("", False, True), ('a,""",', True, False)],
)
def test_one_line_from_either_beginning(line, outside, inside):
    assert (cr.ends_inside(line, False), cr.ends_inside(line, True)) == (outside, inside)


def test_beginnings_follow_the_order_of_the_splits():
    ends = [("f", 0, True, False, True), ("f", 10, False, True, False), ("f", 20, True, True, True), ("f", 30, False, False, False), ("g", 0, False, True, False)]
    assert cr.open_splits(ends[::-1]) == {("f", 10): 0, ("f", 20): 0, ("f", 30): 20}
