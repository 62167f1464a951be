"""CSV feeds with line breaks in cells: one split, many splits and a plain reader agree."""

import csv
import io
import random

import pytest

from tallyspark.sources import feeds, sinks
from tallyspark.sources.csvsplit import _header, line_step, read_csv


@pytest.fixture
def splits(spark):
    def set_to(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")

    yield set_to
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def rows_of(df):
    return [tuple(r)[:-1] for r in sorted(df.collect(), key=lambda r: r["_ord"])]


def awkward_cells(rng, n):
    pool = ["plain", "", "two\nlines", "three\n\nlines\n", 'say "hi"', ",", '"', '""', "\n", " padded ", "a,b\nc,d", "crlf\r\nin", "ümlaut\n日本", '5" pipe']
    return [[str(i), rng.choice(pool), rng.choice(pool), "x" * rng.randint(0, 40)] for i in range(n)]


def written(path, rows, header=("id", "a", "b", "c"), newline="\n"):
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator=newline).writerows([header, *rows])
    path.write_bytes(out.getvalue().encode())
    return out.getvalue()


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_same_rows_and_ordinals_in_any_split(spark, tmp_path, splits, newline):
    rows = awkward_cells(random.Random(1), 120)
    path = tmp_path / "f.csv"
    text = written(path, rows, newline=newline)
    assert [tuple(r) for r in csv.reader(io.StringIO(text, newline=""))][1:] == [tuple(r) for r in rows]
    seen = set()
    for size in (10**9, 1500, 97):
        splits(size)
        df = read_csv(spark, str(path))
        assert rows_of(df) == [tuple(r) for r in rows]
        seen.add(tuple((r["id"], r["_ord"]) for r in df.orderBy("_ord").collect()))
    assert len(seen) == 1
    assert spark.read.text(str(path)).rdd.getNumPartitions() > 30


def test_like_a_one_task_read(spark, tmp_path, splits):
    rows = [r for r in awkward_cells(random.Random(2), 150) if "\r" not in "".join(r)]
    path = tmp_path / "f.csv"
    written(path, rows)
    plain = spark.read.csv(str(path), header=True, multiLine=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    want = [tuple(c or "" for c in r) for r in plain.collect()]
    splits(400)
    assert rows_of(feeds.read_feed(spark, str(path))) == want


def test_folder_of_files_in_path_order(spark, tmp_path, splits):
    everything = []
    for k, name in enumerate(("b.csv", "a.csv", "c.csv")):
        rows = awkward_cells(random.Random(k), 30)
        written(tmp_path / name, rows)
        everything.append((name, rows))
    splits(300)
    want = [tuple(r) for _, rows in sorted(everything) for r in rows]
    assert rows_of(read_csv(spark, str(tmp_path))) == want


def test_a_cell_over_many_splits(spark, tmp_path, splits):
    rows = [["1", "short"], ["2", "\n".join(f"line {i}, with \"quotes\"" for i in range(150))], ["3", "end\n"]]
    written(tmp_path / "f.csv", rows, ("id", "note"))
    splits(400)
    assert rows_of(read_csv(spark, str(tmp_path / "f.csv"))) == [tuple(r) for r in rows]


def test_quotes_inside_unquoted_cells_open_nothing(spark, tmp_path, splits):
    (tmp_path / "f.csv").write_text('id,size\n1,5" pipe\n2,6" pipe\n3,"7"" pipe"\n4,"a"\n')
    for size in (10**9, 12):
        splits(size)
        assert rows_of(read_csv(spark, str(tmp_path / "f.csv"))) == [("1", '5" pipe'), ("2", '6" pipe'), ("3", '7" pipe'), ("4", "a")]


def test_ragged_blank_and_empty(spark, tmp_path):
    path = tmp_path / "f.csv"
    path.write_text("a,b,c\n1\n\n1,2,3,4\n\r\n,,\n")
    assert rows_of(read_csv(spark, str(path))) == [("1", "", ""), ("1", "2", "3"), ("", "", "")]
    path.write_text("a,b\n")
    df = read_csv(spark, str(path))
    assert df.columns == ["a", "b", "_ord"] and df.count() == 0


def test_headers(spark, tmp_path, splits):
    assert _header("﻿ Date ,SKU,SKU,,\"x\ny\"\r", ",") == ["Date", "SKU", "SKU_1", "_c3", "x\ny"]
    (tmp_path / "h.csv").write_text('"two\nlines",b\n1,2\n')
    assert read_csv(spark, str(tmp_path / "h.csv")).columns == ["two\nlines", "b", "_ord"]
    splits(6)
    with pytest.raises(ValueError, match="header row must end"):
        read_csv(spark, str(tmp_path / "h.csv"))
    splits(10**9)
    (tmp_path / "i.csv").write_text("other,b\n1,2\n")
    with pytest.raises(ValueError, match="different header rows"):
        read_csv(spark, str(tmp_path))


def test_line_steps():
    step = line_step()
    assert [step(x, False) for x in ('a,b', '"a', '"a"', 'a,"b', '"a""', 'a"b', '"a" x"y,"z', '"",""', '","')] == [
        False, True, False, True, True, False, True, False, False]
    assert [step(x, True) for x in ('a', 'a"', 'a""', 'a",b', 'a","b', '"', '""', '"""')] == [True, False, True, False, True, False, True, False]


def test_written_feeds_come_back(spark, tmp_path, splits):
    rows = [(str(i), f"a\n{i}" if i % 3 else f'"{i}"') for i in range(200)]
    sinks.write_table(spark.createDataFrame(rows, "id string, note string").repartition(3), str(tmp_path / "out"), "csv")
    splits(500)
    assert sorted(rows_of(feeds.read_feed(spark, str(tmp_path / "out"), "csv"))) == sorted(rows)
