"""The inverted-file index against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxmetric.operators import similarity, vector_index

WIDTH = 16


def embeddings(spark, m, first=0):
    return spark.createDataFrame(
        [(first + i, [float(x) for x in v]) for i, v in enumerate(m)], "response_id bigint, embedding array<float>"
    )


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, WIDTH))
    return centres[rng.integers(0, 12, 900)] + rng.normal(size=(900, WIDTH)) * 0.3


@pytest.fixture(scope="module")
def index(spark, clustered, tmp_path_factory):
    rows = embeddings(spark, clustered)
    model = vector_index.fit(rows, WIDTH, lists=12, subspaces=4)
    path = str(tmp_path_factory.mktemp("index") / "i")
    vector_index.Index.create(rows, path, model)
    return vector_index.Index.load(spark, path)


def pairs(df):
    return {(r.query_id, r.response_id) for r in df.collect()}


def test_clustered_rows_need_few_lists(spark, clustered, index):
    rows = embeddings(spark, clustered)
    queries = rows.filter("response_id % 50 = 0")
    probes = index.fit_probes(rows, k=10)
    assert probes <= 4
    exact = pairs(similarity.nearest_to_many(rows, queries, WIDTH, 10))
    found = pairs(index.search(queries, k=10, probes=probes))
    assert len(found) == 180
    assert len(exact & found) >= 0.9 * len(exact)


def test_all_lists_and_full_depth_are_exact(spark, clustered, index):
    rows = embeddings(spark, clustered)
    queries = rows.filter("response_id % 50 = 0")
    cols = ["query_id", "response_id", "rank"]
    exact = similarity.nearest_to_many(rows, queries, WIDTH, 7).select(cols).collect()
    found = index.search(queries, k=7, probes=12, depth=10_000).select(cols).collect()
    assert sorted(exact) == sorted(found)


def test_only_probed_folders_are_read(clustered, index):
    vector = clustered[3].tolist()
    near = index.search_vector(vector, k=5, probes=2)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(list_id" in plan and "list_id" in plan.split("PartitionFilters")[1]
    codes = index.candidates(index.spark.createDataFrame([(-1, vector)], "response_id bigint, embedding array<double>"), 2, 50)
    assert codes.select("list_id").distinct().count() <= 2
    scans = [s for s in codes._jdf.queryExecution().executedPlan().toString().split("ReadSchema: ")[1:] if "code" in s.split("\n")[0]]
    assert scans and all("embedding" not in s.split("\n")[0] for s in scans)
    assert near.first().response_id == 3


def test_rows_are_added_and_ids_may_repeat(spark, clustered, index, tmp_path):
    other = vector_index.Index.create(embeddings(spark, clustered[:100]), str(tmp_path / "j"), index.model)
    other.add(embeddings(spark, clustered[100:110], first=500))
    other.add(embeddings(spark, clustered[:1], first=7))
    assert other.rows().count() == 111
    found = other.search_vector(clustered[0].tolist(), k=2, probes=12).collect()
    assert [r.response_id for r in found] == [0, 7] and found[0].similarity == found[1].similarity


def test_rows_without_direction_are_left_out(spark, index, tmp_path):
    odd = spark.createDataFrame(
        [(1, None), (2, [0.0] * WIDTH), (3, [1.0]), (4, [1.0] * WIDTH)], "response_id bigint, embedding array<float>"
    )
    other = vector_index.Index.create(odd, str(tmp_path / "k"), index.model)
    assert [r.response_id for r in other.rows().collect()] == [4]
    assert other.search(odd, k=3, probes=12).count() == 0
    assert index.search(odd.filter(F.lit(False)), k=3, probes=12).count() == 0


def test_full_depth_ships_no_pairs(spark, clustered, index, monkeypatch):
    """Rows are compared in their lists; equal rows, repeated ids and small blocks included."""
    monkeypatch.setattr(vector_index, "SHARD", 40)
    monkeypatch.setattr(vector_index, "BLOCK", 3)
    monkeypatch.setattr(vector_index, "_STEP", 16)
    monkeypatch.setattr(vector_index.Index, "candidates", lambda *a: pytest.fail("pairs of ids are shipped"))
    rows = embeddings(spark, clustered)
    queries = rows.filter("response_id % 50 = 0")
    cols = ["query_id", "response_id", "rank"]
    exact = similarity.nearest_to_many(rows, queries, WIDTH, 7).select(cols).collect()
    assert sorted(index.search(queries, k=7, probes=12, depth=900).select(cols).collect()) == sorted(exact)


def test_equal_rows_go_to_the_smaller_ids(spark, clustered, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "_STEP", 7)
    rows = embeddings(spark, np.repeat(clustered[:6], 31, axis=0))
    made = vector_index.Index.create(rows, str(tmp_path / "i"), vector_index.fit(rows, WIDTH, lists=2, subspaces=4))
    found = made.search(rows.filter("response_id % 31 = 4"), k=9, probes=2, depth=1 << 30)
    for r in found.groupBy("query_id").agg(F.sort_array(F.collect_list("response_id")).alias("ids")).collect():
        first = r.query_id - 4
        assert r.ids == [i for i in range(first, first + 10) if i != r.query_id]
