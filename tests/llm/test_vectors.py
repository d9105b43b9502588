"""Cross-polytope search, clustering with pivots and fill-in-middle against brute force."""

import hashlib
import math

import numpy as np
import pytest
from helpers import clashing, documents, odd_rows, prose, rows_of
from pyspark.sql import functions as F

import __spark_entry__ as entry
from voxmetric.llm import crosspolytope, infill, pivots

VECTORS = "vec_id bigint, embedding array<double>, label int"
NAN, INF = float("nan"), float("inf")


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in rows], VECTORS)


def random_rows(n, width=8, seed=0, spread=0.0):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, width))
    m = m / np.linalg.norm(m, axis=1, keepdims=True) * np.exp2(-spread * rng.random((n, 1)))
    return [(i, v.tolist()) for i, v in enumerate(m)]


ODD = [
    (1000, None), (1001, []), (1002, [0.0] * 8), (1003, [None] + [1.0] * 7), (1004, [NAN] + [1.0] * 7), (1005, [INF] * 8),
    (None, [1.0] * 8), (1006, [0.5]), (1007, [1e300] * 8), (1007, [1e300] * 8), (1008, [0.1] * 8), (1008, [0.2] * 8), (0, [0.3] * 8),
]


# --------------------------------------------------------- nearest neighbours


def nearest_by_hand(rows, is_query, k):
    """Exact neighbours: (query, vec_id, score), every row but the query's own."""
    good = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    width = max((len(v) for _, v in good), default=0)
    good = [(i, [*v, *[0.0] * (width - len(v))]) for i, v in good]
    asked = {}
    for i, v in good:
        if is_query(i):
            asked[i] = min(asked.get(i, v), v)
    out = {}
    for q, a in asked.items():
        found = [(-float((np.array(a) * np.array(v)).sum()), i) for i, v in good if i != q]
        out[q] = [(i, -s) for s, i in sorted(found)[:k]]
    return out


def found_rows(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


@pytest.mark.parametrize(("hashes", "shard", "block"), [(1, 16_384, 1024), (2, 16_384, 1024), (1, 7, 3)])
def test_all_buckets_give_the_exact_neighbours(spark, monkeypatch, hashes, shard, block):
    monkeypatch.setattr(crosspolytope, "SHARD", shard)
    monkeypatch.setattr(crosspolytope, "BLOCK", block)
    rows = random_rows(150, spread=12) + ODD
    index = crosspolytope.Index(clashing(vectors(spark, rows).repartition(3)), tables=2, hashes=hashes)
    got = index.search(index.queries(F.col("vec_id") % 4 == 0), 5, probes=index.hashes.buckets)
    want = nearest_by_hand(rows, lambda i: i % 4 == 0, 5)
    found = found_rows(got)
    assert set(found) == set(want)
    for q, near in want.items():
        assert [i for i, _ in found[q]] == [i for i, _ in near]
        assert np.allclose([s for _, s in found[q]], [s for _, s in near], rtol=1e-12)


def test_equal_scores_and_copies(spark):
    rows = [(i, [1.0, 0.0]) for i in range(9)] + [(3, [1.0, 0.0])] * 4 + [(20, [0.0, 1.0])]
    index = crosspolytope.Index(vectors(spark, rows))
    found = found_rows(index.search(index.queries(F.col("vec_id") % 4 == 0), 6, probes=4))
    assert [i for i, _ in found[0]] == [1, 2, 3, 3, 3, 3]
    assert [i for i, _ in found[4]] == [0, 1, 2, 3, 3, 3]


def test_fitted_probes_reach_the_target(spark):
    rows = random_rows(1500, 32, seed=3)
    index = crosspolytope.Index(vectors(spark, rows))
    queries = index.queries(F.col("vec_id") % 20 == 0)
    probes = index.fit_probes(queries, 10)
    assert 1 <= probes < index.hashes.buckets
    found = found_rows(index.search(queries, 10, probes))
    want = nearest_by_hand(rows, lambda i: i % 20 == 0, 10)
    hits = sum(len({i for i, _ in found.get(q, [])} & {i for i, _ in near}) for q, near in want.items())
    assert hits >= 0.95 * sum(map(len, want.values()))


def test_rotation_is_orthogonal_and_probes_are_ranked():
    made = crosspolytope.Hashes(6, 0.0, 3, 2)
    assert np.allclose(made._turned(np.eye(6), 1, 1) @ made._turned(np.eye(6), 1, 1).T, np.eye(6))
    q = np.random.default_rng(1).normal(size=(5, 6))
    order = made.probes(q, 0, made.buckets)
    assert (np.sort(order, axis=1) == np.arange(made.buckets)).all()
    unit = q / np.linalg.norm(q, axis=1, keepdims=True)
    assert (order[:, 0] == made.assign(unit)[1][:, 0]).all()


def test_no_vectors(spark):
    index = crosspolytope.Index(vectors(spark, [(1, None), (2, [0.0])]))
    assert index.search(index.queries(F.lit(True))).count() == 0


def test_registered_recall(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    found = found_rows(entry.queries()["op11_cross_polytope"](spark, sf))
    want = nearest_by_hand(rows, lambda i: i % 20 == 0, 20)
    exact = dict(rows)
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in near}) for q, near in want.items())
    assert hits >= 0.9 * sum(map(len, want.values()))
    for q, near in found.items():
        assert len(near) == 20
        assert all(math.isclose(s, math.fsum(a * b for a, b in zip(exact[q], exact[i])), abs_tol=1e-12) for i, s in near)


# ------------------------------------------------------------------ clusters


def clusters_by_hand(rows, k, rounds, width):
    points = [(i, [max(min(math.floor(256 * x), 1 << 53), -(1 << 53)) if abs(256 * x) < INF else (1 << 53 if x > 0 else -(1 << 53)) for x in v])
              for i, v in rows if v and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda p: (p[0] is None, "" if p[0] is None else hashlib.sha256(f"2:{p[0]}".encode()).hexdigest(), p[1])
    centroids = [v for _, v in sorted(points, key=key)[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centroids))

    for _ in range(rounds):
        at = [near(v)[1] for _, v in points]
        groups = {}
        for i, (_, v) in zip(at, points):
            groups.setdefault(i, []).append(v)
        centroids = [[sum(x) // len(groups[i]) for x in zip(*groups[i])] if i in groups else c for i, c in enumerate(centroids)]
    last = [(i, *near(v)) for i, v in points]
    inertia = {}
    for _, d, c in last:
        inertia[c] = inertia.get(c, 0) + d
    most, whole = (1 << 63) - 1, sum(inertia.values())
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted([(i, c, min(d, most), min(inertia[c], most), min(whole, most), sha[c]) for i, d, c in last], key=repr)


COLUMNS = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


@pytest.mark.parametrize("n_pivots", [1, 4])
@pytest.mark.parametrize("rows", [
    random_rows(120) + ODD[:7] + [(7, [0.25] * 8), (7, [0.5] * 8), (None, [0.1] * 8), (200, [0.5])],
    random_rows(40) + [(500, [1e300, *[-1e300] * 7]), (501, [1e13] * 8), (502, [-3e12] * 8)],
    [(i, [0.5, 0.5]) for i in range(9)] + [(9, [0.25, 0.75])],
    [(1, [1.0] * 8)], [],
])
def test_clusters_against_brute_force(spark, rows, n_pivots):
    width = 2 if rows and rows[0][1] and len(rows[0][1]) == 2 else 8
    df = clashing(vectors(spark, rows).repartition(3))
    got = pivots.with_inertia(*pivots.clusters(df, 6, 3, width, n_pivots=n_pivots))
    assert rows_of(got, *COLUMNS) == clusters_by_hand(rows, 6, 3, width)


def test_bounds_spare_exact_distances():
    rng = np.random.default_rng(2)
    centres = rng.integers(-4000, 4000, (30, 16))
    v = (centres[rng.integers(0, 30, 2000)] + rng.integers(-20, 20, (2000, 16))).astype(np.int64)
    chosen = pivots.choose(centres, 6)
    found = pivots.Assignment(centres, chosen)
    cluster, distance = found.nearest(v, pivots._roots(v, chosen))
    exact = ((v[:, None] - centres[None]) ** 2).sum(axis=2)
    assert (cluster == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
    assert found.exact < 0.2 * exact.size


# ------------------------------------------------------------ fill-in-middle


def infill_by_hand(doc_id, text, p="<P>", s="<S>", m="<M>"):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(x in text for x in (p, s, m)) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < 20:
        return doc_id, n, "spm", a, b - a, f"{s}{text[b:]}{p}{text[:a]}{m}{text[a:b]}"
    return doc_id, n, "psm", a, b - a, f"{p}{text[:a]}{s}{text[b:]}{m}{text[a:b]}"


def infill_rows():
    mixed = ["é", "漢字", "\U0001f600x", "á", "<P", "P>", "<S>", "x<M>y", "<P>", "\x00\x7f\x80߿ࠀ￿\U00010000"]
    made = [(100 + i, t * (i % 4 + 1)) for i, t in enumerate(mixed * 6)]
    return odd_rows() + made + [(300 + i, prose(i, 40)) for i in range(40)] + [(-5, "𝔘𝔫𝔦" * 2000), (400, "z" * 300_000 + "é" + "漢" * 9)]


def test_infill_against_slices(spark):
    rows = infill_rows()
    df = clashing(documents(spark, rows)).withColumn("form", F.lit("clash")).repartition(3)
    got = infill.transform(df)
    assert got.columns == [c for c in df.columns if c not in infill._NAMES] + infill._NAMES
    want = sorted((infill_by_hand(i, t) for i, t, *_ in rows), key=repr)
    assert rows_of(got, "doc_id", "n", "form", "prefix_chars", "middle_chars", "output") == want
    assert {r.form for r in got.collect()} == {"plain", "psm", "spm"}
    back = got.select("doc_id", infill.restored(F.col("output"), F.col("form")).alias("back"))
    assert rows_of(back, "doc_id", "back") == sorted(((i, t or "") for i, t, *_ in rows), key=repr)
    assert infill.transform(df.limit(0)).count() == 0


def test_infill_with_other_sentinels(spark):
    marks = (".*", "\\E[x]", "|mid>")
    rows = [(i, prose(i, 30) + "\\E.") for i in range(30)] + [(40, "a.*b"), (41, "\\E[x]")]
    got = infill.transform(documents(spark, rows), sentinels=marks, plain_from=100, spm_below=50)
    back = got.select("doc_id", infill.restored(F.col("output"), F.col("form"), marks).alias("back"))
    assert rows_of(back, "doc_id", "back") == sorted(rows, key=repr)
    for bad in (("<P>", "<P>", "<M>"), ("", "a", "b"), ("ab", "bc", "x"), ("aa", "b", "c"), ("<P>", "x<P>y", "z")):
        with pytest.raises(ValueError):
            infill.check_sentinels(bad)


def test_exception_index():
    text = "aé漢\U0001f600z" * 5 + "plain" * 9 + "ü"
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    index = infill.Exceptions(data)
    places = np.arange(len(text) + 1)
    at = np.array([len(text[:i].encode()) for i in places])
    assert (index.to_byte(places) == at).all() and (index.to_code_point(at) == places).all()
    assert len(index.places) == 16
