"""CSV files cut into blocks against the reader of whole files."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from voxmetric.sources import csv_blocks, ingest


def write(path, rows, sep=",", end="\r\n", quoting=csv.QUOTE_MINIMAL):
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f, delimiter=sep, lineterminator=end, quoting=quoting).writerows(rows)


def some_rows(n, seed, names):
    rng = random.Random(seed)
    parts = ["a", "é漢", '"', "\n", "\r\n", ",", ";", " ", "text " * 5, "\n\n", '""', "x" * 50]
    return [names] + [[f"k{i}", *["".join(rng.choice(parts) for _ in range(rng.randint(0, 5))) for _ in names[1:]]] for i in range(n)]


@pytest.fixture
def small_blocks(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def fields(df, columns):
    return sorted(((r.source_file.rsplit("/", 1)[-1], *[r[c] for c in columns]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_rows_of_the_whole_file_reader(spark, small_blocks, tmp_path, end):
    names = ["SURVEY", "NPS", "Note"]
    write(tmp_path / "a.csv", some_rows(200, 1, names), end=end)
    write(tmp_path / "b.csv", some_rows(60, 2, names), sep=";", end=end, quoting=csv.QUOTE_ALL)
    write(tmp_path / "c.csv", [["SURVEY", "NPS"], ["z", "9"]], end=end)
    (tmp_path / "d.csv").write_text("")
    got = csv_blocks.read_blocks(spark, str(tmp_path))
    want = ingest.number_rows(ingest.read_csv(spark, str(tmp_path)))
    columns = ["SURVEY", "NPS", "Note", "row_number"]
    assert fields(got, columns) == fields(want, columns)
    assert csv_blocks._lines(spark, str(tmp_path / "a.csv")).rdd.getNumPartitions() > 10


def test_a_record_longer_than_many_blocks(spark, small_blocks, tmp_path):
    long = "line, \"quoted\"\n" * 500
    rows = [["id", "text"], ["1", "x"], ["2", long], ["3", "y\n"], ["4", long + "z"], ["5", "end"]]
    write(tmp_path / "a.csv", rows)
    got = csv_blocks.read_blocks(spark, str(tmp_path / "a.csv")).orderBy("row_number").collect()
    assert [(r.id, r.text, r.row_number) for r in got] == [(i, t, n) for n, (i, t) in enumerate(rows[1:], 1)]


def test_header_with_breaks_blank_lines_and_no_last_line_end(spark, small_blocks, tmp_path):
    body = '﻿"my\nkey",b\n\n1,"x\n\n"\n\n\n2,y\n"3","z"'
    (tmp_path / "a.csv").write_bytes(body.encode())
    got = csv_blocks.read_blocks(spark, str(tmp_path / "a.csv"))
    assert got.columns == ["my\nkey", "b", "source_file", "row_number"]
    assert [tuple(r)[:2] + (r.row_number,) for r in got.orderBy("row_number").collect()] == [("1", "x\n\n", 1), ("2", "y", 2), ("3", "z", 3)]


def test_changed_blocks_are_noticed(spark, small_blocks, tmp_path):
    write(tmp_path / "a.csv", some_rows(50, 3, ["a", "b"]))
    got = csv_blocks.read_blocks(spark, str(tmp_path / "a.csv"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    other = csv_blocks.records(spark, str(tmp_path / "a.csv"), [])
    with pytest.raises(Exception, match="read it again"):
        other.count()
    assert got.agg(F.max("row_number")).first()[0] == 50
