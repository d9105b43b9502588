"""Exact top-k inner products by multi-resolution segment statistics.

A vector is cut into 1, 4 and 16 segments; of each segment its mean and standard
deviation are kept. For segments of length L the inner product of two vectors is
at most the sum of L (mean mean' + deviation deviation') over the segments
(Cauchy-Schwarz on the centred parts), which is the familiar lower bound of the
distance turned round. From coarse to fine, only candidates whose bound reaches
the k-th best score so far survive; the exact product is computed for survivors.

The queries are dealt into blocks and the candidates into shards, both of bounded
expected size, by a hash of the id. Each (block, shard) is one group: its bounds
are matrix products, and it returns k rows a query. The best k of those follow
from a ranked filter that Spark applies before the shuffle as well.

Components x become floor(256 x); products are sums of integers. Defined cases: a
vector that is null, or holds a null or non-finite component, takes no part;
shorter vectors are filled up with zeros; a query is never its own candidate, by
id; rows that repeat an id are candidates of their own; null ids take no part;
fewer than k candidates give all of them; ties go to the smaller id; scores
beyond the range of a long are held at its ends; an empty table gives an empty
result; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 5
BLOCK = 1024
SHARD = 16_384
LEVELS = (1, 4, 16)
_STEP = 4096
_EXACT = float(1 << 53)


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): valid vectors with components floor(256 x) as doubles."""
    x = F.transform(F.col(vector_col), lambda c: F.floor(c.cast("double") * 256).cast("double"))
    raw = F.col(vector_col)
    valid = F.forall(raw, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")) & ~F.isnan(c.cast("double")))
    return vectors.filter(F.col(id_col).isNotNull() & raw.isNotNull() & F.coalesce(valid, F.lit(False))).select(
        F.col(id_col).cast("bigint").alias("vec_id"), x.alias("v")
    )


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    lists = column.combine_chunks()
    at = lists.offsets.to_numpy()
    values = lists.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]]
    size = np.diff(at)
    if (size == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(size), width))
    out[np.repeat(np.arange(len(size)), size), np.arange(len(values)) - np.repeat(at[:-1] - at[0], size)] = values
    return out


def _statistics(m: np.ndarray, segments: int) -> np.ndarray:
    """Root of length times mean, then root of length times deviation, of each segment."""
    edges = np.unique(np.linspace(0, m.shape[1], segments + 1).astype(int))
    length = np.diff(edges)
    mean = np.add.reduceat(m, edges[:-1], axis=1) / length
    square = np.add.reduceat(m * m, edges[:-1], axis=1) / length
    deviation = np.sqrt(np.maximum(square - mean * mean, 0))
    return np.concatenate([mean, deviation], axis=1) * np.sqrt(np.tile(length, 2))


def _exact(q: np.ndarray, c: np.ndarray, big: bool) -> np.ndarray:
    """Inner products of row pairs, as long."""
    if not big:
        return np.einsum("ij,ij->i", q, c).astype(np.int64)
    ends = np.iinfo(np.int64)
    return np.array([min(max(sum(int(a) * int(b) for a, b in zip(x, y)), ends.min), ends.max) for x, y in zip(q, c)], dtype=np.int64).reshape(-1)


def _top(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (query, candidate, score) of each query among the candidates."""
    if not len(ids) or not len(query_ids):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    width = max(q.shape[1], 1)
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * width
    big = most >= _EXACT
    best = np.full((len(q), k), -np.inf)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    levels = [(_statistics(q, s), _statistics(c, s)) for s in LEVELS if s <= width] if q.shape[1] else []
    # Long vectors first: they have the highest scores more often than not.
    order = np.argsort(-(c * c).sum(axis=1), kind="stable")
    step = 64
    lo = 0
    while lo < len(order):
        part = order[lo : lo + step]
        lo, step = lo + step, _STEP
        alive = query_ids[:, None] != ids[part][None, :]
        for of_q, of_c in levels:
            bound = of_q @ of_c[part].T
            slack = 1 + 1e-9 * np.linalg.norm(of_q, axis=1)[:, None] * np.linalg.norm(of_c[part], axis=1)[None, :]
            alive &= bound + slack >= best[:, -1:]
        row, col = np.nonzero(alive)
        for a in range(0, len(row), 1 << 17):
            r, x = row[a : a + (1 << 17)], part[col[a : a + (1 << 17)]]
            score = _exact(q[r], c[x], big)
            keep = score >= best[r, -1]
            r, x, score = r[keep], x[keep], score[keep]
            found.append((r, x, score))
            if len(r):
                found = [_best(found, ids, k)]
                r, _, score = found[0]
                rank = np.arange(len(r)) - np.searchsorted(r, r)
                best[r, rank] = score
    r, x, score = found[0] if found else (np.zeros(0, np.int64),) * 3
    return query_ids[r], ids[x], score


def _best(found: list, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, in order."""
    r, x, score = (np.concatenate(p) for p in zip(*found))
    # ~score is -score - 1, which falls as the score rises and never overflows.
    order = np.lexsort((ids[x], ~score, r))
    r, x, score = r[order], x[order], score[order]
    keep = np.arange(len(r)) - np.searchsorted(r, r) < k
    return r[keep], x[keep], score[keep]


def _group(k: int):
    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        tables = (queries, candidates)
        width = max((int(np.diff(t["v"].combine_chunks().offsets.to_numpy()).max(initial=0)) for t in tables if t.num_rows), default=0)
        if queries.num_rows and candidates.num_rows:
            q, c = (_matrix(t["v"], width) for t in tables)
            a, b, s = _top(queries["vec_id"].to_numpy(), q, candidates["vec_id"].to_numpy(), c, k)
        else:
            a = b = s = np.zeros(0, np.int64)
        return pa.table({"query_id": pa.array(a), "vec_id": pa.array(b), "score": pa.array(s)})

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of each query among all other rows.

    ``is_query`` is a condition on vec_id.
    """
    v = integers(vectors)
    queries = v.filter(is_query).dropDuplicates(["vec_id"])
    n, n_queries = v.agg(F.count(F.lit(1)), F.count_if(is_query)).first()
    blocks, shards = n_queries // BLOCK + 1, n // SHARD + 1
    block, shard = (F.pmod(F.xxhash64("vec_id", *extra), F.lit(parts)) for extra, parts in (((), blocks), (("v",), shards)))
    queries = queries.withColumn("block", block).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<bigint>")))
    candidates = v.withColumn("shard", shard).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))
    found = (
        queries.groupBy("block", "shard")
        .cogroup(candidates.groupBy("block", "shard"))
        .applyInArrow(_group(k), "query_id bigint, vec_id bigint, score bigint")
    )
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
