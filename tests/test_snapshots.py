"""Keyed tables: commits, deltas, failures, conflicts and compaction."""

import random

import pytest
from pyspark.sql import functions as F

from voxmetric.sources import snapshots
from voxmetric.sources.snapshots import CommitConflict, KeyedTable

SCHEMA = "id bigint, value int, note string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def held(df):
    return {r.id: (r.value, r.note) for r in df.collect()}


@pytest.fixture
def table(spark, tmp_path):
    return KeyedTable.create(frame(spark, [(i, i, "a") for i in range(40)]), str(tmp_path / "t"), "id", 4)


def test_upserts_against_a_dictionary(spark, table, monkeypatch):
    monkeypatch.setattr(snapshots, "MOST_LAYERS", 3)
    want, rng = {i: (i, "a") for i in range(40)}, random.Random(1)
    states = [dict(want)]
    for step in range(6):
        rows = [(rng.randint(0, 60), rng.randint(0, 9), f"s{step}") for _ in range(rng.choice([1, 15]))]
        assert table.upsert(frame(spark, rows), newest=["value"]) == step + 2
        for i, v, n in sorted(rows, key=lambda r: r[1]):
            want[i] = (v, n)
        states.append(dict(want))
        assert held(table.read()) == want
        assert table.read().count() == len(want)
    for version, state in enumerate(states, 1):
        assert held(table.read(version)) == state
    assert max(map(len, table.files.manifest()["layers"].values())) <= 3
    table.compact()
    assert {len(x) for x in table.files.manifest()["layers"].values()} == {1}
    assert table.compact() == table.compact()
    assert held(table.read()) == want
    assert table.vacuum() and not table.vacuum()
    assert held(KeyedTable(spark, table.path).read()) == want


def test_a_failed_write_leaves_the_old_table(spark, table, monkeypatch):
    before = held(table.read())
    bad = frame(spark, [(1, 1, "new")]).withColumn("note", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        table.upsert(bad)
    assert held(table.read()) == before

    def fail(self, manifest):
        raise OSError("lost before the manifest")

    with monkeypatch.context() as m:
        m.setattr(snapshots.Snapshots, "publish", fail)
        with pytest.raises(OSError):
            table.upsert(frame(spark, [(1, 9, "new")]))
    assert held(table.read()) == before and table.files.versions() == [1]
    table.upsert(frame(spark, [(1, 9, "new")]))
    assert held(table.read()) == before | {1: (9, "new")}
    assert len(table.vacuum(keep=2)) >= 1


def test_only_one_of_two_writers_commits(spark, table):
    manifest = table.files.manifest()
    table.upsert(frame(spark, [(1, 9, "first")]))
    with pytest.raises(CommitConflict):
        table.files.publish(manifest | {"version": 2})
    assert held(table.read())[1] == (9, "first")


def test_wrong_buckets_columns_and_parents(spark, table):
    rows = frame(spark, [(1, 9, "x"), (500, 1, "y")])
    with pytest.raises(ValueError, match="4 key buckets"):
        table.upsert(rows, buckets=8)
    with pytest.raises(ValueError, match="columns"):
        table.upsert(rows.drop("note"))
    with pytest.raises(FileExistsError):
        KeyedTable.create(rows, table.path, "id", 4)
    with pytest.raises(FileNotFoundError):
        KeyedTable(spark, table.path + "-other").read()
    table.upsert(rows, parents=frame(spark, [(1, 0, "")]))
    assert 500 not in held(table.read()) and held(table.read())[1] == (9, "x")


def test_untouched_buckets_are_not_rewritten(spark, table):
    before = table.files.manifest()["layers"]
    table.upsert(frame(spark, [(1, 9, "x")]))
    after = table.files.manifest()["layers"]
    changed = [b for b in after if after[b] != before.get(b)]
    assert len(changed) == 1 and after[changed[0]][0] == before[changed[0]][0]
    plan = table.read(buckets=[int(changed[0])])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2


def test_empty_tables(spark, tmp_path):
    table = KeyedTable.create(frame(spark, []), str(tmp_path / "e"), "id", 4)
    assert held(table.read()) == {}
    table.upsert(frame(spark, []))
    table.upsert(frame(spark, [(1, 1, None), (None, 2, "n"), (None, 3, "n")]), newest=["value"])
    assert held(table.read()) == {1: (1, None), None: (3, "n")}
