"""Exact search with pivot bounds against brute force, and what it ships."""

import numpy as np
from pyspark.sql import functions as F

from voxmetric.operators.vector_cells import Cells

KIND = "response_id bigint, embedding array<double>"


def clustered(n, width=8, groups=12, seed=2):
    rng = np.random.default_rng(seed)
    heads = rng.normal(size=(groups, width)) * 10
    return heads[rng.integers(groups, size=n)] + rng.normal(size=(n, width)) * 0.05


def frame(spark, m):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], KIND)


def brute(m, asked, k):
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    out = {}
    for q in asked:
        sims = np.round(unit @ unit[q], 9)
        order = np.lexsort((np.arange(len(m)), -sims))
        out[q] = [int(i) for i in order if i != q][:k]
    return out


def answers(found):
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.response_id)
    return got


def test_clusters_ship_a_small_part_and_are_exact(spark):
    m = clustered(1500)
    df = frame(spark, m)
    asked = df.filter("response_id % 20 = 0").withColumn("cell", F.lit("clash"))
    cells = Cells(df.withColumn("angle", F.lit("clash")), 8, 12)
    left, right = cells.shipments(asked, 6, 30, 100)
    blocks = left.select("block").distinct().count()
    assert right.count() < 0.3 * blocks * len(m)
    assert answers(cells.search(asked, 6, 30, 100)) == brute(m, range(0, 1500, 20), 6)


def test_without_structure_and_with_more_neighbours_than_a_cell_holds(spark):
    m = np.random.default_rng(5).normal(size=(300, 6))
    df = frame(spark, m)
    asked = df.filter("response_id < 40")
    assert answers(Cells(df, 6, 16).search(asked, 7, 8, 50)) == brute(m, range(40), 7)
    assert answers(Cells(df, 6, 200).search(asked, 25, 8, 50)) == brute(m, range(40), 25)


def test_hot_cell_is_dealt_into_shards(spark):
    same = np.tile([[1.0, 2.0, 2.0]], (400, 1))
    m = np.vstack([same, clustered(60, 3, 4)])
    cells = Cells(frame(spark, m), 3, 8)
    left, right = cells.shipments(frame(spark, m).filter("response_id in (3, 450)"), 5, 30, 50)
    largest = right.groupBy("block", "cell", "shard").count().agg(F.max("count")).first()[0]
    assert largest < 120
    got = answers(cells.search(frame(spark, m).filter("response_id in (3, 450)"), 5, 30, 50))
    assert got[3] == [0, 1, 2, 4, 5] and got[450] == brute(m, [450], 5)[450]


def test_odd_vectors_and_empty_tables(spark):
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0]), (4, None), (5, [3.0, 0.0]), (6, [1.0]), (7, [None, 1.0]), (8, [float("nan"), 1.0]), (9, [float("inf"), 1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, KIND)
    assert answers(Cells(df, 2).search(df, 9)) == {2: [5, 3], 3: [2, 5], 5: [2, 3]}
    none = df.limit(0)
    assert Cells(df, 2).search(none, 3).count() == 0
    assert Cells(none, 2).search(df, 3).count() == 0
