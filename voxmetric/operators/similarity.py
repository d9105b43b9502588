"""Nearest responses by cosine similarity of their embeddings."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.vectors import nearest_centroid, nearest_pairs, nearest_rows, unit_rows
from .nps import top_per_group

# Expected queries of a block and rows of a shard; a group holds one of each.
BLOCK, SHARD = 1024, 16_384


def usable(embeddings: DataFrame, width: int) -> DataFrame:
    """Vectors of the width that have a direction; all others have no cosine."""
    lengthy = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x) > 0
    return embeddings.filter((F.size("embedding") == width) & lengthy).select("response_id", "embedding")


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = [F.desc("similarity"), F.asc("response_id")]
    return hits.orderBy(*order).limit(k).select("response_id", "similarity")


def nearest_to_vector(
    embeddings: DataFrame, vector: Sequence[float], k: int = 10
) -> DataFrame:
    """The ``k`` responses closest to a query vector: ``1 - cosine distance``."""
    run = nearest_rows(np.asarray(vector, dtype="float64"), k)
    found = usable(embeddings, len(vector)).mapInArrow(run, "response_id bigint, similarity double")
    return _ranked(found, k)


def vector_of(embeddings: DataFrame, response_id: int) -> list[float]:
    """Embedding of one response; a single row is fetched."""
    row = embeddings.filter(F.col("response_id") == response_id).select("embedding").head()
    if row is None:
        raise KeyError(f"no embedding for response {response_id}")
    return list(row[0])


def nearest_to_response(embeddings: DataFrame, response_id: int, k: int = 10) -> DataFrame:
    """The ``k`` responses closest to a given one, itself excluded."""
    others = embeddings.filter(F.col("response_id") != response_id)
    return nearest_to_vector(others, vector_of(embeddings, response_id), k)


def _parts(df: DataFrame, name: str, size: int) -> tuple[Column, Column]:
    """A part of about ``size`` rows by hash of the id, and all parts, as columns.

    The number of parts is a scalar of the same query, so no job starts early.
    """
    n = df.agg(F.floor(F.count(F.lit(1)) / size) + 1).scalar()
    return F.pmod(F.xxhash64("response_id"), n).alias(name), F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias(name)


def nearest_to_many(
    embeddings: DataFrame, queries: DataFrame, width: int, k: int = 10
) -> DataFrame:
    """The ``k`` nearest responses of each query response, ranked.

    Queries are dealt into blocks and embeddings into shards; each (block,
    shard) is one group of bounded size that returns k rows per query. Any
    number of queries can be given; they never pass through the driver.
    """
    rows, asked = usable(embeddings, width), usable(queries, width)
    block, blocks = _parts(asked, "block", BLOCK)
    shard, shards = _parts(rows, "shard", SHARD)
    left = asked.select("*", block).select("*", shards)
    right = rows.select("*", shard).select("*", blocks)
    hits = (
        left.groupBy("block", "shard")
        .cogroup(right.groupBy("block", "shard"))
        .applyInArrow(nearest_pairs(k), "query_id bigint, response_id bigint, similarity double")
    )
    return top_per_group(
        hits, ["query_id"], [F.desc("similarity"), F.asc("response_id")], k
    )


def with_responses(hits: DataFrame, responses: DataFrame, *columns: str) -> DataFrame:
    """Response columns for a top-k result; its k rows are all that is broadcast."""
    side = responses.select(F.col("id").alias("response_id"), *columns)
    return side.join(F.broadcast(hits), "response_id").orderBy(
        F.desc("similarity"), "response_id"
    )


# ------------------------------------------------------- approximate search


def fit_centroids(
    embeddings: DataFrame, width: int, *, lists: int = 100, seed: int = 17, iterations: int = 10
) -> np.ndarray:
    """Centroids of an index, by k-means on the directions of all embeddings."""
    data = usable(embeddings, width).select(
        array_to_vector(F.col("embedding").cast("array<double>")).alias("features")
    )
    model = KMeans(
        k=lists, seed=seed, maxIter=iterations, distanceMeasure="cosine", featuresCol="features"
    ).fit(data)
    return np.asarray(model.clusterCenters())


def assign_lists(embeddings: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(response_id, embedding, list_id): the list of the most similar centroid.

    Equal similarities go to the smaller list id. No shuffle.
    """
    kind = embeddings.schema["embedding"].dataType.simpleString()
    return usable(embeddings, centroids.shape[1]).mapInArrow(
        nearest_centroid(centroids), f"response_id bigint, embedding {kind}, list_id int"
    )


def write_lists(listed: DataFrame, path: str) -> None:
    """Store an index: a search reads only the folders of its lists."""
    listed.hint("rebalance", "list_id").write.partitionBy("list_id").parquet(path)


def probe_lists(centroids: np.ndarray, vector: Sequence[float], probes: int) -> list[int]:
    """Ids of the lists whose centroids are nearest to the query."""
    sims = unit_rows(np.asarray(centroids, dtype="float64")) @ unit_rows(np.asarray([vector], dtype="float64"))[0]
    return [int(i) for i in np.argsort(-sims, kind="stable")[:probes]]


def nearest_in_lists(
    listed: DataFrame,
    centroids: np.ndarray,
    vector: Sequence[float],
    *,
    k: int = 10,
    probes: int = 10,
) -> DataFrame:
    """Approximate search: exact ranking inside the probed lists only."""
    picked = probe_lists(centroids, vector, probes)
    return nearest_to_vector(listed.filter(F.col("list_id").isin(picked)), vector, k)
