"""Approximate nearest neighbours by cross-polytope hashing.

*Hash.* A vector's direction is turned by a pseudo-random rotation, three rounds
of random signs and a fast Hadamard transform, and assigned to the nearest signed
axis: the coordinate of largest magnitude and its sign. A bucket of a table is
the combination of ``hashes`` such assignments. Axes are ranked by the rotated
query's coordinates, and combinations by their sum; a query probes the best
``probes`` buckets of each of ``tables`` tables (multiprobe).

*Inner products.* Vectors are dealt into octaves of their length below the
longest, and each octave is filled up to its own greatest length by one more
coordinate that queries do not have. So a large inner product means a small angle
inside an octave, and a query probes all octaves. Vectors of about equal length
all fall in the first octave and are hashed by direction alone.

*Probes.* Without a given number, it is fitted: the exact neighbours of
``SAMPLE`` queries at most (those with the least hash of their id) are found
among all rows, and the least number of probes that reaches ``target`` of them
is taken. The queries of the sample are all that the driver holds.

*Candidates.* Every row is indexed. A bucket's rows are dealt into shards and its
queries into blocks of bounded size by a hash, so a bucket of any size is many
groups; a group computes the inner products of one block and one shard and
returns k rows a query. The best k of those follow from a ranked filter.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite
component, and null ids, take no part; shorter vectors are filled up with zeros;
of rows that repeat a query's id the least vector is the query; all other rows
are candidates, those that repeat an id or a whole row too, and rows with the
query's id never; fewer candidates than k give those found; ties go to the smaller id; a score that is not a number (sums
of opposite infinities) ranks last; an empty table gives an empty result; extra
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import written

K, TABLES, TARGET, SAMPLE = 20, 4, 0.95, 256
BLOCK, SHARD = 1024, 16_384
OCTAVES = 8
# Buckets of a table that a query may probe, where several hashes make more.
MOST_PROBES = 4096
_STEP = 4096


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): vectors with a direction, as doubles."""
    raw = F.transform(vector_col, lambda x: x.cast("double"))
    valid = F.forall(raw, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(raw, lambda x: x != 0)
    return vectors.filter(F.col(id_col).isNotNull() & F.coalesce(valid, F.lit(False))).select(
        F.col(id_col).cast("bigint").alias("vec_id"), raw.alias("v")
    )


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of a list column, filled up with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    at = lists.offsets.to_numpy().astype(np.int64)
    values = lists.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]].astype(float, copy=False)
    size = np.diff(at)
    if (size == width).all():
        return values.reshape(len(size), width)
    out = np.zeros((len(size), width))
    out[np.repeat(np.arange(len(size)), size), np.arange(len(values)) - np.repeat(at[:-1] - at[0], size)] = values
    return out


def lengths(m: np.ndarray) -> np.ndarray:
    """Binary logarithm of each row's length, without overflow."""
    most = np.abs(m).max(axis=1, keepdims=True)
    return np.log2(np.linalg.norm(m / most, axis=1)) + np.log2(most[:, 0])


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row, an orthogonal map."""
    rows, n = x.shape
    step = 1
    while step < n:
        pairs = x.reshape(rows, -1, 2, step)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(rows, n)
        step *= 2
    return x / np.sqrt(n)


class Hashes:
    """Rotations of ``tables`` times ``hashes`` assignments to signed axes."""

    def __init__(self, width: int, longest: float, tables: int, hashes: int, seed: int = 0):
        self.width, self.longest, self.tables, self.hashes = width, longest, tables, hashes
        self.n = 1 << max(width - 1, 1).bit_length()
        rng = np.random.default_rng(seed)
        self.signs = rng.choice([-1.0, 1.0], (tables, hashes, 3, self.n))
        self.filler = rng.choice([-1.0, 1.0], (tables, hashes, self.n)) / np.sqrt(self.n)
        self.buckets = (2 * self.n) ** hashes

    def _turned(self, m: np.ndarray, table: int, i: int) -> np.ndarray:
        x = np.zeros((len(m), self.n))
        x[:, : self.width] = m
        for signs in self.signs[table, i]:
            x = hadamard(x * signs)
        return x

    def assign(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(octave, bucket of each table) of the rows."""
        below = self.longest - lengths(m)
        octave = np.clip(np.floor(below + 1e-9), 0, OCTAVES - 1).astype(np.int64)
        unit = m / np.abs(m).max(axis=1, keepdims=True)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        share = np.exp2(np.minimum(octave - below, 0))
        left = np.sqrt(np.maximum(1 - share * share, 0))
        found = np.zeros((len(m), self.tables), dtype=np.int64)
        for t in range(self.tables):
            for i in range(self.hashes):
                x = self._turned(unit * share[:, None], t, i) + left[:, None] * self.filler[t, i]
                axis = np.abs(x).argmax(axis=1)
                found[:, t] = found[:, t] * (2 * self.n) + 2 * axis + (x[np.arange(len(x)), axis] < 0)
        return octave, found

    def probes(self, m: np.ndarray, table: int, most: int) -> np.ndarray:
        """The ``most`` best buckets of a table for each query, best first."""
        unit = m / np.abs(m).max(axis=1, keepdims=True)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        code, score = np.zeros((len(m), 1), dtype=np.int64), np.zeros((len(m), 1))
        for i in range(self.hashes):
            x = self._turned(unit, table, i)
            signed = np.stack([x, -x], axis=2).reshape(len(x), -1)
            # The best sums of some hashes extend best sums of fewer.
            score = (score[:, :, None] + signed[:, None, :]).reshape(len(x), -1)
            code = (code[:, :, None] * (2 * self.n) + np.arange(2 * self.n)).reshape(len(x), -1)
            best = np.argsort(-score, axis=1, kind="stable")[:, :most]
            code, score = np.take_along_axis(code, best, 1), np.take_along_axis(score, best, 1)
        return code


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of row pairs; the same for a pair wherever it is computed."""
    with np.errstate(over="ignore", invalid="ignore"):
        score = (q * c).sum(axis=1)
    return np.where(np.isnan(score), -np.inf, score)


class _Best:
    """The k best rows of each query, while blocks of candidates stream by."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, q, k
        self.size = np.abs(q).sum(axis=1, keepdims=True)
        self.floor = np.full((len(q), 1), -np.inf)
        self.query, self.row, self.id = (np.zeros(0, dtype=np.int64) for _ in range(3))
        self.score = np.zeros(0)

    def add(self, ids: np.ndarray, c: np.ndarray, first: int) -> None:
        """Candidates of the rows ``first`` and following."""
        with np.errstate(over="ignore", invalid="ignore"):
            # The fast product may differ from ``products`` in its last digits.
            rough = self.q @ c.T + 1e-12 * self.size * np.abs(c).max(axis=1)[None, :]
        if len(ids) > self.k + 1:
            # The query itself may be among the best.
            best = np.partition(rough, -self.k - 1, axis=1)[:, [-self.k - 1]]
            slack = 2e-12 * self.size * np.abs(c).max(initial=0)
            floor = np.maximum(self.floor, np.where(np.isnan(best), -np.inf, best) - slack)
        else:
            floor = self.floor
        query, at = np.nonzero(~(rough < floor) & (self.ids[:, None] != ids[None, :]))
        every = [
            np.concatenate(x)
            for x in ((self.query, query), (self.score, products(self.q[query], c[at])), (self.id, ids[at]), (self.row, first + at))
        ]
        order = np.lexsort((every[3], every[2], -every[1], every[0]))
        query = every[0][order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        order = order[rank < self.k]
        self.query, self.score, self.id, self.row = (x[order] for x in every)
        last = rank[rank < self.k] == self.k - 1
        self.floor[self.query[last], 0] = self.score[last]


def _group(k: int, width: int):
    """Cogroup function: the k best rows of a shard for each query of a block."""

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        q = matrix(queries["v"], width) if queries.num_rows else np.zeros((0, width))
        ids = queries["vec_id"].to_numpy()
        best = _Best(ids, q, k)
        if len(q) and rows.num_rows:
            found, c = rows["vec_id"].to_numpy(), matrix(rows["v"], width)
            for lo in range(0, len(found), _STEP):
                best.add(found[lo : lo + _STEP], c[lo : lo + _STEP], lo)
        kept = rows.select(["part", "copies"]).take(pa.array(best.row))
        columns = {"query_id": pa.array(ids[best.query].astype(np.int64)), "vec_id": pa.array(best.id), "score": pa.array(best.score)}
        return pa.table(columns | {"part": kept["part"], "copies": kept["copies"]})

    return run


class Index:
    """All rows of a table with their buckets, written once."""

    def __init__(self, vectors: DataFrame, tables: int = TABLES, hashes: int = 1, id_col: str = "vec_id", vector_col: str = "embedding"):
        rows = usable(vectors, id_col, vector_col).groupBy("vec_id", "v").agg(F.least(F.count(F.lit(1)), F.lit(1 << 31)).alias("copies"))
        width, longest = self._extent(usable(vectors, id_col, vector_col))
        self.hashes = hash_ = Hashes(width, longest, tables, hashes)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    octave, found = hash_.assign(matrix(batch.column("v"), width))
                    keys = (np.arange(tables) * OCTAVES + octave[:, None]) * hash_.buckets + found
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype="i4") * tables), pa.array(keys.ravel()))
                    yield pa.RecordBatch.from_arrays(
                        [*batch.columns, pa.array(octave), lists], names=["vec_id", "v", "part", "copies", "octave", "keys"]
                    )

        kind = "vec_id bigint, v array<double>, part bigint, copies bigint, octave bigint, keys array<bigint>"
        found = rows.select("vec_id", "v", F.xxhash64("v").alias("part"), "copies").mapInArrow(run, kind)
        self.rows = written(found, "index")

    @staticmethod
    def _extent(rows: DataFrame) -> tuple[int, float]:
        """Greatest number of components and binary logarithm of the greatest length."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            width, longest = 0, -np.inf
            for batch in batches:
                lists = batch.column("v")
                size = np.diff(lists.offsets.to_numpy())
                if len(size):
                    width, longest = max(width, int(size.max())), max(longest, float(lengths(matrix(lists, int(size.max()))).max()))
            yield pa.RecordBatch.from_arrays([pa.array([width]), pa.array([longest])], names=["width", "longest"])

        found = rows.select("v").mapInArrow(run, "width bigint, longest double")
        width, longest = found.agg(F.max("width"), F.max("longest")).first()
        return (width, longest) if width else (1, 0.0)

    def queries(self, is_query: Column) -> DataFrame:
        """(vec_id, v) of the rows that are queries, one an id."""
        return self.rows.filter(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))

    def _probed(self, queries: DataFrame, probes: int) -> DataFrame:
        """(vec_id, v, key) of each bucket that a query probes."""
        found, width = self.hashes, self.hashes.width
        octaves = [r.octave for r in self.rows.select("octave").distinct().collect()]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, 256):
                    part = batch.slice(lo, 256)
                    m = matrix(part.column("v"), width)
                    keys = [
                        (t * OCTAVES + o) * found.buckets + code
                        for t in range(found.tables)
                        for code in (found.probes(m, t, probes),)
                        for o in octaves
                    ]
                    keys = np.concatenate(keys, axis=1) if keys else np.zeros((len(m), 0), dtype=np.int64)
                    at = pa.array(np.arange(len(m) + 1, dtype="i4") * keys.shape[1])
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(at, pa.array(keys.ravel()))], names=["vec_id", "v", "keys"])

        kind = "vec_id bigint, v array<double>, keys array<bigint>"
        return queries.select("vec_id", "v").mapInArrow(run, kind).select("vec_id", "v", F.explode("keys").alias("key"))

    def fit_probes(self, queries: DataFrame, k: int, target: float = TARGET, sample: int = SAMPLE) -> int:
        """The least number of probes that finds ``target`` of a sample's exact neighbours.

        The sample's queries meet every row, in one pass; what comes back is k
        rows a query.
        """
        found, width = self.hashes, self.hashes.width
        asked = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
        most = min(found.buckets, MOST_PROBES)
        if not asked:
            return 1
        q = np.zeros((len(asked), width))
        for row, r in zip(q, asked):
            row[: len(r.v)] = r.v
        ids = np.array([r.vec_id for r in asked], dtype=np.int64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best, codes, seen = _Best(ids, q, k), np.zeros((0, found.tables), dtype=np.int64), 0
            kept = np.zeros(0, dtype=np.int64)
            for batch in batches:
                for lo in range(0, batch.num_rows, _STEP):
                    part = batch.slice(lo, _STEP)
                    key = part.column("keys").flatten().to_numpy().reshape(part.num_rows, -1) % found.buckets
                    best.add(part.column("vec_id").to_numpy(), matrix(part.column("v"), width), seen)
                    codes, kept = np.concatenate([codes, key]), np.concatenate([kept, np.arange(seen, seen + len(key))])
                    seen += len(key)
                    used = np.isin(kept, best.row)
                    codes, kept = codes[used], kept[used]
            need = np.full(len(best.row), most, dtype=np.int64)
            code = codes[np.searchsorted(kept, best.row)]
            for t in range(found.tables):
                order = found.probes(q, t, most)
                for i in range(len(ids)):
                    mine = best.query == i
                    place = np.full(found.buckets, most) if found.buckets <= MOST_PROBES else None
                    if place is not None:
                        place[order[i]] = np.arange(most)
                        need[mine] = np.minimum(need[mine], place[code[mine, t]])
                    else:
                        hit = code[mine, t][:, None] == order[i][None, :]
                        need[mine] = np.minimum(need[mine], np.where(hit.any(axis=1), hit.argmax(axis=1), most))
            columns = [pa.array(ids[best.query]), pa.array(best.id), pa.array(best.score), pa.array(need)]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "vec_id", "score", "need"])

        exact = self.rows.select("vec_id", "v", "keys").mapInArrow(run, "query_id bigint, vec_id bigint, score double, need bigint")
        ranked = exact.withColumn("rank", F.row_number().over(_order())).filter(F.col("rank") <= k)
        need = np.sort([r.need for r in ranked.select("need").collect()])
        if not len(need):
            return 1
        return int(min(need[min(int(np.ceil(target * len(need))), len(need)) - 1] + 1, most))

    def search(self, queries: DataFrame, k: int = K, probes: int | None = None) -> DataFrame:
        """(query_id, rank, vec_id, score): the k best rows found for each query."""
        if probes is None:
            probes = self.fit_probes(queries, k)
        width, hash_ = self.hashes.width, self.hashes
        asked = written(self._probed(queries, probes), "probes")
        keyed = self.rows.select("vec_id", "v", "part", "copies", F.explode("keys").alias("key"))
        sizes = (
            keyed.groupBy("key").agg(F.expr(f"count(1) div {SHARD} + 1").alias("shards"))
            .join(asked.groupBy("key").agg(F.expr(f"count(1) div {BLOCK} + 1").alias("blocks")), "key")
        )
        if hash_.tables * OCTAVES * hash_.buckets <= 1 << 16:
            sizes = F.broadcast(sizes)
        numbers = [F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1)).alias(m) for n, m in (("shards", "shard"), ("blocks", "block"))]
        left = asked.join(sizes, "key").withColumn("block", F.expr("pmod(xxhash64(vec_id), blocks)")).select("key", "vec_id", "v", "block", numbers[0])
        right = keyed.join(sizes, "key").withColumn("shard", F.expr("pmod(xxhash64(vec_id, part), shards)"))
        right = right.select("key", "vec_id", "v", "part", "copies", "shard", numbers[1])
        group = ["key", "block", "shard"]
        hits = (
            left.groupBy(group)
            .cogroup(right.groupBy(group))
            .applyInArrow(_group(k, width), "query_id bigint, vec_id bigint, score double, part bigint, copies bigint")
        )
        # A row is found once a table at most; copies of a row are rows of their own.
        once = hits.groupBy("query_id", "vec_id", "part").agg(F.max("score").alias("score"), F.max("copies").alias("copies"))
        every = once.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.least("copies", F.lit(k)))))
        ranked = every.withColumn("rank", F.row_number().over(_order())).filter(F.col("rank") <= k)
        return ranked.select("query_id", "rank", "vec_id", "score")


def _order():
    return Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
