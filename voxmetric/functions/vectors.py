"""Cosine similarity over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """List column of equal lengths as a 2-d array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(-1, width)


def unit_rows(m: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; zero rows stay zero."""
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)


class BestRows:
    """The k most similar rows of each of n queries, kept while rows stream by.

    Memory is k rows per query and one block of similarities. Equal
    similarities go to the smaller id.
    """

    def __init__(self, n: int, k: int):
        self.k = k
        self.floor = np.full(n, -np.inf)
        self.query = np.zeros(0, dtype="int64")
        self.ids = np.zeros(0, dtype="int64")
        self.sims = np.zeros(0)

    def add(self, sims: np.ndarray, ids: np.ndarray) -> None:
        """Rows of ``sims`` are queries, columns the rows ``ids``; -inf is left out."""
        floor = self.floor
        if sims.shape[1] > self.k:
            floor = np.maximum(floor, np.partition(sims, -self.k, axis=1)[:, -self.k])
        query, at = np.nonzero((sims >= floor[:, None]) & (sims > -np.inf))
        query = np.concatenate([self.query, query])
        found = np.concatenate([self.ids, ids[at]])
        value = np.concatenate([self.sims, sims[query[len(self.query) :], at]])
        order = np.lexsort((found, -value, query))
        query, found, value = query[order], found[order], value[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        kept = rank < self.k
        self.query, self.ids, self.sims = query[kept], found[kept], value[kept]
        last = rank[kept] == self.k - 1
        self.floor[self.query[last]] = self.sims[last]


# Similarities of one block: queries of a group times rows of a step.
BLOCK_ROWS = 4096


def _blocks(ids: np.ndarray, vectors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for at in range(0, len(ids), BLOCK_ROWS):
        yield ids[at : at + BLOCK_ROWS], unit_rows(vectors[at : at + BLOCK_ROWS])


def nearest_rows(query: np.ndarray, k: int):
    """Arrow map function: the k rows of a task nearest to one query vector.

    A task emits k rows, however many batches it reads.
    """
    q = unit_rows(np.asarray([query], dtype="float64"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = BestRows(1, k)
        for batch in batches:
            rows = batch.column(0).to_numpy(zero_copy_only=False)
            for ids, m in _blocks(rows, matrix(batch.column(1), q.shape[1])):
                best.add(q @ m.T, ids)
        yield pa.RecordBatch.from_arrays(
            [pa.array(best.ids.astype("int64")), pa.array(best.sims)],
            names=["response_id", "similarity"],
        )

    return run


def nearest_pairs(k: int):
    """Cogroup function: the k rows of a shard nearest to each query of a block.

    A query is never its own neighbour.
    """

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out = BestRows(0, k)
        query_ids = queries["response_id"].to_numpy()
        if queries.num_rows and rows.num_rows:
            width = len(queries["embedding"][0])
            q = unit_rows(matrix(queries["embedding"], width))
            out = BestRows(len(q), k)
            for ids, m in _blocks(rows["response_id"].to_numpy(), matrix(rows["embedding"], width)):
                sims = q @ m.T
                sims[query_ids[:, None] == ids[None, :]] = -np.inf
                out.add(sims, ids)
        return pa.table(
            {
                "query_id": pa.array(query_ids[out.query].astype("int64")),
                "response_id": pa.array(out.ids.astype("int64")),
                "similarity": pa.array(out.sims),
            }
        )

    return run


def nearest_centroid(centroids: np.ndarray):
    """Arrow map function: every row with the id of its most similar centroid."""
    c = unit_rows(np.asarray(centroids, dtype="float64"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sims = unit_rows(matrix(batch.column(1), c.shape[1])) @ c.T
            best = sims.argmax(axis=1) if len(sims) else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(best.astype("int32"))],
                names=["response_id", "embedding", "list_id"],
            )

    return run
