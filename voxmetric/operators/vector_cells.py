"""Exact nearest responses of many queries; bounds decide which vectors are shipped.

Rows are dealt to cells, the cell of the nearest centre. The angle between a query
and a row is at least the difference of their angles to a centre (triangle
inequality on the sphere). A first pass compares each query with one shard of its
own cell; the k-th similarity found there is its floor, as the k-th best of all rows
is no smaller. A row can then matter to a query only if its angle to its cell's centre
lies within the floor's angle of the query's own angle to that centre. The rows of a
cell go to a block of queries only within the range of angles that the block's
queries leave open, and blocks are made of queries of one cell, which leave similar
ranges. Cells and blocks of any size are dealt into shards of bounded size.

The centres come from a bounded sample (``SAMPLE`` rows by hash of the id), farthest
points first. They decide how much is pruned, never what is found: without
structure in the data all rows go to all blocks, as in ``similarity.nearest_to_many``.

Defined cases: null vectors, those of another width, with null or non-finite components
and without a direction take no part; a query is never its own neighbour; equal
similarities go to the smaller id; queries with fewer than k rows get all; empty
tables give an empty result; extra columns are not read. Repeated ids of queries
or rows are not supported: ids are unique.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.vectors import matrix, nearest_pairs, unit_rows
from ..session import scratch
from .nps import top_per_group
from .similarity import BLOCK, SHARD, usable

CELLS, SAMPLE = 64, 4096
# More than the rounding of an angle worked out from a similarity of nearly 1.
_SLACK = 1e-6
_PAIRS = "query_id bigint, response_id bigint, similarity double"


def _finite(rows: DataFrame) -> DataFrame:
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return rows.filter(F.col("response_id").isNotNull() & whole)


def centres(rows: DataFrame, width: int, cells: int = CELLS) -> np.ndarray:
    """Directions far from each other, out of a sample of at most ``SAMPLE`` rows."""
    picked = rows.orderBy(F.xxhash64("response_id"), "response_id").limit(SAMPLE).select("embedding").toArrow()
    if not picked.num_rows:
        return np.eye(1, width)
    unit = unit_rows(matrix(picked["embedding"], width))
    chosen, nearest = [0], unit @ unit[0]
    while len(chosen) < cells and nearest.min() < 1 - _SLACK:
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, unit @ unit[chosen[-1]])
    return unit[chosen]


def _angles(c: np.ndarray):
    """Arrow map function: the cell of every row and its angle to the centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sims = unit_rows(matrix(batch.column(1), c.shape[1])) @ c.T
            cell = sims.argmax(axis=1) if len(sims) else np.zeros(0, np.int64)
            angle = np.arccos(np.clip(sims[np.arange(len(sims)), cell], -1, 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(cell.astype("int32")), pa.array(angle)],
                names=["response_id", "embedding", "cell", "angle"],
            )

    return run


def _open_ranges(c: np.ndarray):
    """Arrow map function: for each query and cell the angles that its floor leaves open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, cells = batch.num_rows, len(c)
            unit = unit_rows(matrix(batch.column(1), c.shape[1]))
            to_centre = np.arccos(np.clip(unit @ c.T, -1, 1))
            floor = batch.column(2).to_numpy(zero_copy_only=False)
            reach = np.arccos(np.clip(floor, -1, 1))[:, None] + _SLACK
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(batch.column(3).to_numpy(zero_copy_only=False), cells)),
                    pa.array(np.tile(np.arange(cells, dtype="int32"), n)),
                    pa.array((to_centre - reach).ravel()),
                    pa.array((to_centre + reach).ravel()),
                ],
                names=["block", "cell", "low", "high"],
            )

    return run


class Cells:
    """The rows of a search with their cells, written once. Building it starts jobs."""

    def __init__(self, embeddings: DataFrame, width: int, cells: int = CELLS):
        rows = _finite(usable(embeddings, width))
        self.spark, self.width = embeddings.sparkSession, width
        self.centres = centres(rows, width, cells)
        self.path = scratch(self.spark, "cells")
        self.kind = rows.schema["embedding"].dataType.simpleString()
        self._rows = self._written(self._placed(rows), "rows")

    def _written(self, df: DataFrame, name: str) -> Callable[[], DataFrame]:
        """Writes a frame; each call of what it gives is a frame of its own, so that it can meet itself in a join."""
        path = f"{self.path}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return lambda: self.spark.read.schema(df.schema).parquet(path)

    def _placed(self, rows: DataFrame) -> DataFrame:
        schema = f"response_id bigint, embedding {self.kind}, cell int, angle double"
        return rows.mapInArrow(_angles(self.centres), schema)

    def _parts(self, df: DataFrame, name: str, size: int, salt: str) -> DataFrame:
        """Rows of a cell dealt into parts of about ``size`` by hash of the id."""
        counts = df.groupBy("cell").agg((F.floor(F.count(F.lit(1)) / size) + 1).alias("parts"))
        part = F.pmod(F.xxhash64(F.lit(salt), "response_id"), F.col("parts")).cast("int").alias(name)
        # A row a cell, of which there are as many as centres.
        return df.join(F.broadcast(counts), "cell").select(*df.columns, part)

    def shipments(self, queries: DataFrame, k: int, block: int = BLOCK, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
        """(queries by block and cell and shard, rows by the same): what a search compares. Starts jobs."""
        sharded = self._written(self._parts(self._rows(), "shard", shard, "row"), "sharded")
        asked = self._parts(self._placed(_finite(usable(queries, self.width))), "part", block, "query")
        asked = self._written(asked.withColumn("block", F.col("cell").cast("bigint") * (1 << 32) + F.col("part")), "asked")
        # First pass: the first shard of the query's own cell, which holds about SHARD rows.
        near = (
            asked()
            .select("response_id", "embedding", "cell", "block")
            .groupBy("cell", "block")
            .cogroup(self._first(sharded(), asked()).groupBy("cell", "block"))
            .applyInArrow(nearest_pairs(k), _PAIRS)
        )
        found = near.groupBy("query_id").agg(F.min("similarity").alias("least"), F.count(F.lit(1)).alias("n"))
        floors = found.select(F.col("query_id").alias("response_id"), F.when(F.col("n") >= k, F.col("least")).alias("least"))
        floored = asked().join(floors, "response_id", "left").select(
            "response_id", "embedding", F.coalesce("least", F.lit(-1.0)).alias("floor"), "block"
        )
        ranges = (
            floored.mapInArrow(_open_ranges(self.centres), "block bigint, cell int, low double, high double")
            .groupBy("block", "cell")
            .agg(F.min("low").alias("low"), F.max("high").alias("high"))
        )
        extent = self._rows().groupBy("cell").agg(F.min("angle").alias("from"), F.max("angle").alias("to"))
        met = ranges.join(F.broadcast(extent), "cell").filter("low <= to and high >= from")
        opened = self._written(met.select("block", "cell", "low", "high"), "ranges")
        right = sharded().join(opened(), "cell").filter("angle between low and high")
        parts = sharded().select("cell", "shard").distinct()
        pairs = opened().join(parts, "cell").select("block", "cell", "shard")
        left = asked().select("response_id", "embedding", "block").join(pairs, "block")
        return left, right.select("response_id", "embedding", "block", "cell", "shard")

    @staticmethod
    def _first(rows: DataFrame, asked: DataFrame) -> DataFrame:
        blocks = asked.select("cell", "block").distinct()
        return rows.filter("shard = 0").join(blocks, "cell").select("response_id", "embedding", "cell", "block")

    def search(self, queries: DataFrame, k: int = 10, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
        """(query_id, response_id, similarity, rank) of the ``k`` nearest rows of each query, exact."""
        left, right = self.shipments(queries, k, block, shard)
        keys = ["block", "cell", "shard"]
        hits = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(nearest_pairs(k), _PAIRS)
        return top_per_group(hits, ["query_id"], [F.desc("similarity"), F.asc("response_id")], k)
