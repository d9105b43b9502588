"""CSV files with quoted line breaks, read in blocks by many tasks.

Whether a line break ends a record depends on the quotes before it, so a block
cannot be cut into records by itself. Each block is first read speculatively: the
parity of its quotes, and how many records would end in it if it began outside
and if it began inside quotes. Composing the parities of a file's blocks, in
order, tells how each block really begins and the number of its first record. A
second pass cuts the records; the pieces of those that cross blocks, at most two
a block, are put together by their number, and every record is parsed by itself.

Quotes must enclose whole fields and be doubled inside them, as writers of
quoted line breaks do. Blank lines between records are skipped. What is held by
the driver is one row a block, like the listing of the files itself, and one
header a file.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .ingest import delimiter_of

ADDED = ("source_file", "row_number")
BOM = "﻿"
_BLOCK = "file string, block bigint, lines bigint, parity int, even bigint, odd bigint, head string"
_PIECE = "file string, block bigint, number bigint, whole boolean, text string"


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, block, value) in file order within each block."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"
    )


class _Runs:
    """Runs of lines of one block, as batches of a task go by.

    Yields (file, block, lines, ends, blank, last): the parity of quotes at the
    end of each line, which lines are blank, and whether the block ends here.
    """

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        self.batches = batches

    def _pieces(self) -> Iterator[tuple[str, int, pa.Array]]:
        for batch in self.batches:
            if not batch.num_rows:
                continue
            file, block, value = batch.columns
            change = np.flatnonzero(
                (np.diff(block.to_numpy()) != 0) | pc.not_equal(file[1:], file[:-1]).to_numpy(zero_copy_only=False)
            )
            edges = [0, *(change + 1).tolist(), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:]):
                yield file[a].as_py(), block[a].as_py(), value[a:b]

    def __iter__(self):
        parity, pieces = 0, self._pieces()
        now = next(pieces, None)
        while now:
            after = next(pieces, None)
            file, block, value = now
            quotes = pc.count_substring(value, '"').to_numpy()
            ends = (parity + np.cumsum(quotes)) % 2
            bare = pc.or_(pc.equal(value, ""), pc.equal(value, "\r")).to_numpy(zero_copy_only=False)
            last = after is None or after[:2] != (file, block)
            yield file, block, value, ends, bare, last
            parity = 0 if last else int(ends[-1])
            now = after


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a block, for both ways that it may begin."""
    kinds = ("file", "block", "lines", "parity", "even", "odd", "head")
    rows, lines, counts, head, open_head = [], 0, np.zeros(2, dtype=np.int64), [], True
    for file, block, value, ends, bare, last in _Runs(batches):
        lines += len(value)
        for side in (0, 1):
            # A blank line is a record of no kind where it lies outside quotes.
            counts[side] += int(((ends == side) & ~bare).sum())
        if block == 0 and open_head:
            for text, end, blank in zip(value, ends.tolist(), bare.tolist()):
                if head or not blank:
                    head.append(text.as_py())
                    if not end:
                        open_head = False
                        break
        if last:
            first = "\n".join(head) if block == 0 else None
            rows.append((file, block, lines, int(ends[-1]), int(counts[0]), int(counts[1]), first))
            lines, counts, head, open_head = 0, np.zeros(2, dtype=np.int64), [], True
    if rows:
        yield pa.RecordBatch.from_pylist(
            [dict(zip(kinds, r)) for r in rows],
            schema=pa.schema(list(zip(kinds, (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string())))),
        )


def block_states(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row a block: how it begins (``inside``) and the number of its first record."""
    measured = _lines(spark, path).mapInArrow(_measure, _BLOCK)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("parity").over(before), F.lit(0)) % 2 == 1
    counted = measured.withColumn("inside", inside).withColumn("records", F.when(F.col("inside"), F.col("odd")).otherwise(F.col("even")))
    return counted.withColumn("first", F.coalesce(F.sum("records").over(before), F.lit(0)).cast("bigint"))


def _cut(states: dict[tuple[str, int], tuple[bool, int, int]]):
    """Map function: records and pieces of records, numbered from 0 in their file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        lines, number, began_inside = 0, None, False
        for file, block, value, ends, bare, last in _Runs(batches):
            if number is None:
                if (file, block) not in states:
                    raise RuntimeError(f"blocks of {file} changed between two scans; read it again")
                began_inside, number, size = states[file, block]
                shift, first = int(began_inside), True
            lines += len(value)
            texts = value.to_pylist()
            close = np.flatnonzero((ends + shift) % 2 == 0).tolist()
            numbers, whole, out, at = [], [], [], 0
            for end in close:
                if not held and end == at and bare[end]:
                    at = end + 1
                    continue
                held += texts[at : end + 1]
                numbers.append(number)
                whole.append(not (first and began_inside))
                out.append("\n".join(held))
                held, at, first, number = [], end + 1, False, number + 1
            held += texts[at:]
            if last:
                if held:
                    numbers.append(number)
                    whole.append(False)
                    out.append("\n".join(held))
                if lines != size:
                    raise RuntimeError(f"blocks of {file} changed between two scans; read it again")
                held, lines, number = [], 0, None
            if out:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([file] * len(out)), pa.array(np.full(len(out), block)), pa.array(np.array(numbers, dtype=np.int64)),
                        pa.array(whole), pa.array(out, pa.string()),
                    ],
                    names=["file", "block", "number", "whole", "text"],
                )

    return run


def records(spark: SparkSession, path: str | list[str], states: list) -> DataFrame:
    """(file, number, text): every record, the header being number 0."""
    known = {(r.file, r.block): (r.inside, r["first"], r.lines) for r in states}
    pieces = _lines(spark, path).mapInArrow(_cut(known), _PIECE)
    whole = pieces.filter("whole").select("file", "number", "text")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda p: p["text"])
    joined = pieces.filter("not whole").groupBy("file", "number").agg(F.array_join(parts, "\n").alias("text"))
    return whole.unionByName(joined.select("file", "number", "text"))


def read_blocks(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """All columns as text, ``source_file`` and ``row_number`` from 1, for files of any size.

    The rows of ``ingest.read_csv`` with quoted line breaks, but a large file is
    many tasks, and row numbers are exact across them. One pass over the files
    is made when called. The two added columns replace any of the same name.
    """
    states = block_states(spark, path).collect()
    heads: dict[str, list[str]] = {}
    for r in sorted(states):
        if r.head:
            heads.setdefault(r.head.removeprefix(BOM), []).append(r.file)
    rows = records(spark, path, states).filter("number > 0")
    frames = [_parsed(rows.filter(F.col("file").isin(*files)), head, sep) for head, files in heads.items()]
    if not frames:
        return spark.createDataFrame([], "source_file string, row_number bigint")
    return functools.reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames)


def _parsed(rows: DataFrame, head: str, sep: str | None) -> DataFrame:
    """Fields of each record, by the names in the header record.

    As in the reader of whole files, a file whose header ends in CR LF has its
    line breaks inside quotes made LF.
    """
    text = F.col("text")
    if head.endswith("\r"):
        head, text = head[:-1].replace("\r\n", "\n"), F.replace(text, F.lit("\r\n"), F.lit("\n"))
    sep = sep or delimiter_of(head)
    options = {"sep": sep, "quote": '"', "escape": '"', "nullValue": "\u0000", "emptyValue": "", "multiLine": "true", "mode": "PERMISSIVE"}
    spark = rows.sparkSession
    wide = ", ".join(f"c{i} string" for i in range(head.count(sep) + 1))
    names = spark.range(1).select(F.from_csv(F.lit(head), wide, options).alias("h")).first().h
    # The last field that is there ends the header; separators inside quotes make no fields.
    columns = [n for n in names if n is not None] or [head]
    kind = ", ".join(f"c{i} string" for i in range(len(columns)))
    # A record keeps the carriage return of its last line, outside quotes.
    text = F.regexp_replace(text, "\r\\z", "")
    return rows.select(F.col("file").alias("source_file"), F.col("number").alias("row_number"), F.from_csv(text, kind, options).alias("c")).select(
        *[F.col(f"c.c{i}").alias(n) for i, n in enumerate(columns) if n.lower() not in ADDED], *ADDED
    )
