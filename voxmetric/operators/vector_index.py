"""Inverted-file index over embeddings with product-quantised residuals.

Every embedding lies in the list of its most similar centroid. Beside it stands
a code: the residual of its direction from the centroid, cut into subspaces, each
replaced by the number of the nearest codeword. A search ranks the centroids for
each query, reads the codes of the first ``probes`` lists only (folders of the
stored table), estimates the similarities from one small table of products per
query, and computes the exact cosine for the best ``depth`` rows of each query.

Centroids are fitted on all embeddings, the codewords on a sample of at most
``SAMPLE`` embeddings (those with the least hash of their id), the number of
probes on at most ``ASKED`` of the same. All rows are indexed. The driver holds
centroids, codewords and these samples. A search whose ``depth`` is all rows has
nothing to estimate: rows are compared in their lists, ``k`` a query leave each.

Rows without a direction (null, zero, another width) are not indexed; rows that
repeat an id are rows of their own; a query is never its own neighbour.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.vectors import BestRows, matrix, unit_rows
from .nps import top_per_group
from .similarity import BLOCK, SHARD, fit_centroids, nearest_to_many, usable

SAMPLE, ASKED = 16_384, 256
CODEWORDS = 256
_STEP = 4096
# More than the rounding of a product of unit vectors, and pairs that are multiplied at a time.
_SLACK, _PAIRS = 1e-12, 65_536


def _sample(embeddings: DataFrame, width: int, rows: int) -> np.ndarray:
    """Directions of the rows with the least hash of their id."""
    picked = usable(embeddings, width).orderBy(F.xxhash64("response_id"), "response_id").limit(rows).select("embedding").collect()
    return unit_rows(np.array([r.embedding for r in picked], dtype="float64").reshape(-1, width))


def _codewords(points: np.ndarray, k: int, seed: int, iterations: int = 12) -> np.ndarray:
    """k-means of a sample; clusters that lose all points keep their place."""
    rng = np.random.default_rng(seed)
    centres = points[rng.permutation(len(points))[:k]] if len(points) else np.zeros((1, points.shape[1]))
    for _ in range(iterations if len(points) else 0):
        at = _nearest(points, centres)
        size = np.bincount(at, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, at, points)
        centres = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centres)
    return centres


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Number of the nearest centre of each point, the smaller one of equals."""
    return ((centres * centres).sum(axis=1) - 2 * points @ centres.T).argmin(axis=1)


@dataclass(frozen=True)
class Model:
    """Unit centroids (lists x width) and codewords (subspaces x codewords x width / subspaces)."""

    centroids: np.ndarray
    codewords: np.ndarray

    @property
    def width(self) -> int:
        return self.centroids.shape[1]

    def cut(self, m: np.ndarray) -> np.ndarray:
        """Rows as (row, subspace, component), filled up with zeros."""
        subspaces, _, part = self.codewords.shape
        out = np.zeros((len(m), subspaces * part))
        out[:, : m.shape[1]] = m
        return out.reshape(len(m), subspaces, part)

    def encode(self, directions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(list, code) of unit vectors; a code is one byte a subspace."""
        at = (directions @ self.centroids.T).argmax(axis=1)
        rest = self.cut(directions - self.centroids[at])
        codes = [_nearest(rest[:, s], words) for s, words in enumerate(self.codewords)]
        return at, np.column_stack(codes).astype("uint8")

    def products(self, queries: np.ndarray) -> np.ndarray:
        """(query, subspace, codeword) inner products of unit queries."""
        return np.einsum("qsp,scp->qsc", self.cut(queries), self.codewords)

    def order(self, queries: np.ndarray) -> np.ndarray:
        """Lists of each unit query, most similar centroid first."""
        return np.argsort(-(queries @ self.centroids.T), axis=1, kind="stable")


def fit(
    embeddings: DataFrame, width: int, *, lists: int = 100, subspaces: int = 16, seed: int = 17, sample: int = SAMPLE
) -> Model:
    """Centroids and codewords of an index."""
    centroids = unit_rows(fit_centroids(embeddings, width, lists=lists, seed=seed))
    directions = _sample(embeddings, width, sample)
    rest = directions - centroids[(directions @ centroids.T).argmax(axis=1)]
    part = -(-width // subspaces)
    blank = Model(centroids, np.zeros((subspaces, 1, part)))
    words = [_codewords(blank.cut(rest)[:, s], CODEWORDS, seed + s) for s in range(subspaces)]
    return Model(centroids, np.stack(words))


def encode(embeddings: DataFrame, model: Model) -> DataFrame:
    """(response_id, embedding, code, list_id) of every row with a direction; no shuffle."""
    kind = embeddings.schema["embedding"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, codes = model.encode(unit_rows(matrix(batch.column(1), model.width)))
            packed = pa.array([c.tobytes() for c in codes], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), packed, pa.array(at.astype("int32"))],
                names=["response_id", "embedding", "code", "list_id"],
            )

    return usable(embeddings, model.width).mapInArrow(run, f"response_id bigint, embedding {kind}, code binary, list_id int")


class Index:
    """An index stored in one folder: ``rows`` by list, ``model`` beside it."""

    def __init__(self, spark: SparkSession, path: str, model: Model):
        self.spark, self.path, self.model = spark, path, model

    @classmethod
    def create(cls, embeddings: DataFrame, path: str, model: Model) -> Index:
        """Write the model, then all rows."""
        subspaces, words, part = model.codewords.shape
        spark = embeddings.sparkSession
        row = (model.centroids.ravel().tolist(), model.codewords.ravel().tolist(), model.width, subspaces, words, part)
        kind = "centroids array<double>, codewords array<double>, width int, subspaces int, words int, part int"
        spark.createDataFrame([row], kind).coalesce(1).write.parquet(f"{path}/model")
        index = cls(spark, path, model)
        index.add(embeddings)
        return index

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        r = spark.read.parquet(f"{path}/model").first()
        centroids = np.array(r.centroids).reshape(-1, r.width)
        return cls(spark, path, Model(centroids, np.array(r.codewords).reshape(r.subspaces, r.words, r.part)))

    def add(self, embeddings: DataFrame) -> None:
        """Append rows; the model stays. A list of any size is split over files."""
        encode(embeddings, self.model).hint("rebalance", "list_id").write.mode("append").partitionBy("list_id").parquet(
            f"{self.path}/rows"
        )

    def rows(self, lists: Sequence[int] | None = None) -> DataFrame:
        """The stored rows, of the given lists only."""
        rows = self.spark.read.parquet(f"{self.path}/rows")
        return rows if lists is None else rows.filter(F.col("list_id").isin(*lists))

    def fit_probes(self, embeddings: DataFrame, *, k: int = 10, target: float = 0.95, asked: int = ASKED) -> int:
        """The least number of lists that hold ``target`` of a sample's exact neighbours."""
        width = self.model.width
        queries = usable(embeddings, width).orderBy(F.xxhash64("response_id"), "response_id").limit(asked)
        exact = nearest_to_many(self.rows().select("response_id", "embedding"), queries, width, k)
        lists = self.rows().select("response_id", "list_id")
        near = exact.join(lists, "response_id").select("query_id", "list_id").collect()
        order = {r.response_id: self.model.order(unit_rows(np.array([r.embedding], dtype="float64")))[0] for r in queries.collect()}
        need = sorted(int(np.flatnonzero(order[r.query_id] == r.list_id)[0]) + 1 for r in near)
        return need[max(int(np.ceil(target * len(need))), 1) - 1] if need else 1

    def _probed(self, queries: DataFrame, probes: int) -> DataFrame:
        """(query_id, embedding, list_id) of each list that a query probes."""
        model, kind = self.model, queries.schema["embedding"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                order = model.order(unit_rows(matrix(batch.column(1), model.width)))[:, :probes].astype("int32")
                at = pa.array(np.arange(len(order) + 1, dtype="int32") * order.shape[1])
                lists = pa.ListArray.from_arrays(at, pa.array(order.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["query_id", "embedding", "lists"])

        found = queries.select(F.col("response_id").alias("query_id"), "embedding").mapInArrow(
            run, f"query_id bigint, embedding {kind}, lists array<int>"
        )
        return found.select("query_id", "embedding", F.explode("lists").alias("list_id"))

    def _in_lists(self, queries: DataFrame, probes: int, column: str, found) -> DataFrame:
        """(query_id, response_id, similarity, list_id) that ``found`` gives for groups of queries and rows.

        Lists of any size: their rows are dealt into shards and their queries
        into blocks of bounded size. Of the rows only ids and ``column`` are moved.
        """
        asked = self._probed(usable(queries, self.model.width), probes)
        lists = [r.list_id for r in asked.select("list_id").distinct().collect()]
        rows = self.rows(lists)
        sizes = rows.groupBy("list_id").agg(F.expr(f"count(1) div {SHARD} + 1").alias("shards"))
        blocks = asked.groupBy("list_id").agg(F.expr(f"count(1) div {BLOCK} + 1").alias("blocks"))
        # One row a list, and the driver holds the centroids of all lists anyway.
        parts = F.broadcast(sizes.join(blocks, "list_id"))

        def each(n: str, name: str):
            return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1)).alias(name)

        left = asked.join(parts, "list_id").withColumn("block", F.expr("pmod(xxhash64(query_id), blocks)"))
        right = rows.join(parts, "list_id").withColumn("shard", F.expr("pmod(xxhash64(response_id, code), shards)"))
        group = ["list_id", "block", "shard"]
        return (
            left.select("query_id", "embedding", "list_id", "block", each("shards", "shard")).groupBy(group)
            .cogroup(right.select("response_id", column, "list_id", "shard", each("blocks", "block")).groupBy(group))
            .applyInArrow(found, "query_id bigint, response_id bigint, similarity double, list_id int")
        )

    def candidates(self, queries: DataFrame, probes: int, depth: int) -> DataFrame:
        """(query_id, response_id, list_id): the rows with the best estimates. Only ids and codes are read."""
        hits = self._in_lists(queries, probes, "code", _estimates(self.model, depth))
        order = [F.desc("similarity"), F.asc("response_id")]
        return top_per_group(hits, ["query_id"], order, depth).select("query_id", "response_id", "list_id").distinct()

    def search(self, queries: DataFrame, *, k: int = 10, probes: int = 10, depth: int | None = None) -> DataFrame:
        """(query_id, response_id, similarity, rank): the ``k`` best rows found for each query.

        ``queries`` are rows (response_id, embedding), one an id. ``depth`` rows a
        query, by default 20 k, are compared exactly.
        """
        depth, order = depth or 20 * k, [F.desc("similarity"), F.asc("response_id")]
        if depth >= self.rows().count():
            hits = self._in_lists(queries, probes, "embedding", _compared(self.model.width, k)).drop("list_id")
            return top_per_group(hits, ["query_id"], order, k)
        near = self.candidates(queries, probes, depth)
        asked = usable(queries, self.model.width).select(F.col("response_id").alias("query_id"), F.col("embedding").alias("query"))
        pairs = near.join(self.rows().drop("code"), ["list_id", "response_id"]).join(asked, "query_id")
        width = self.model.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a, b = (unit_rows(matrix(batch.column(c), width)) for c in ("query", "embedding"))
                columns = [batch.column("query_id"), batch.column("response_id"), pa.array((a * b).sum(axis=1))]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "response_id", "similarity"])

        exact = pairs.select("query_id", "response_id", "query", "embedding").mapInArrow(
            run, "query_id bigint, response_id bigint, similarity double"
        )
        return top_per_group(exact, ["query_id"], order, k)

    def search_vector(self, vector: Sequence[float], *, k: int = 10, probes: int = 10, depth: int | None = None) -> DataFrame:
        """(response_id, similarity): search for one vector, which has no id of its own."""
        row = (-1, [float(x) for x in vector])
        query = self.spark.createDataFrame([row], "response_id bigint, embedding array<double>")
        return self.search(query, k=k, probes=probes, depth=depth).orderBy("rank").select("response_id", "similarity")


def _estimates(model: Model, depth: int):
    """Cogroup function: the rows of a shard of one list with the best estimates."""

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        ids, out = queries["query_id"].to_numpy(), BestRows(0, depth)
        at = rows["list_id"][0].as_py() if rows.num_rows else 0
        if queries.num_rows and rows.num_rows:
            q = unit_rows(matrix(queries["embedding"], model.width))
            base, table = q @ model.centroids[at], model.products(q)
            found = rows["response_id"].to_numpy()
            codes = np.frombuffer(b"".join(rows["code"].to_pylist()), dtype="uint8").reshape(len(found), -1)
            out = BestRows(len(q), depth)
            for lo in range(0, len(found), _STEP):
                sims = np.repeat(base[:, None], len(found[lo : lo + _STEP]), axis=1)
                for s in range(codes.shape[1]):
                    sims += table[:, s, codes[lo : lo + _STEP, s]]
                sims[ids[:, None] == found[None, lo : lo + _STEP]] = -np.inf
                out.add(sims, found[lo : lo + _STEP])
        return _table(ids, out, at)

    return run


def _compared(width: int, k: int):
    """Cogroup function: the rows of a shard of one list that are nearest to each query.

    Rows that may be among the ``k`` are found by a matrix product. Its last
    digits depend on a row's place, so these are multiplied again one by one:
    equal rows have equal similarities.
    """

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        ids, out = queries["query_id"].to_numpy(), BestRows(0, k)
        at = rows["list_id"][0].as_py() if rows.num_rows else 0
        if queries.num_rows and rows.num_rows:
            q, found = unit_rows(matrix(queries["embedding"], width)), rows["response_id"].to_numpy()
            directions, out = unit_rows(matrix(rows["embedding"], width)), BestRows(len(q), k)
            for lo in range(0, len(found), _STEP):
                step, near = found[lo : lo + _STEP], directions[lo : lo + _STEP]
                sims = q @ near.T
                sims[ids[:, None] == step[None, :]] = -np.inf
                floor = out.floor
                if len(step) > k:
                    floor = np.maximum(floor, np.partition(sims, -k, axis=1)[:, -k])
                asked, row = np.nonzero((sims >= floor[:, None] - _SLACK) & (sims > -np.inf))
                sims[:] = -np.inf
                for a in range(0, len(asked), _PAIRS):
                    i, j = asked[a : a + _PAIRS], row[a : a + _PAIRS]
                    sims[i, j] = (q[i] * near[j]).sum(axis=1)
                out.add(sims, step)
        return _table(ids, out, at)

    return run


def _table(ids: np.ndarray, best: BestRows, at: int) -> pa.Table:
    return pa.table(
        {
            "query_id": pa.array(ids[best.query].astype("int64")),
            "response_id": pa.array(best.ids.astype("int64")),
            "similarity": pa.array(best.sims),
            "list_id": pa.array(np.full(len(best.ids), at, dtype="int32")),
        }
    )
