"""Sums under corrections against sums of the final state, after every batch."""

import collections
import datetime as dt
import random

import pytest

from voxmetric.sources import snapshots
from voxmetric.streaming import maintained
from voxmetric.streaming.maintained import CHANGE, MaintainedTrend, maintain

START = dt.datetime(2024, 5, 1)


def random_changes(seed, batches, size):
    rng = random.Random(seed)

    def change():
        moment = None if rng.random() < 0.05 else START + dt.timedelta(hours=rng.randint(0, 100))
        score = None if rng.random() < 0.1 else rng.randint(0, 10)
        return (rng.choice([None, *range(30)]), rng.choice([None, *range(50)]), rng.choice([True, False, False, None]), rng.choice("ab"), moment, score)

    return [[change() for _ in range(size)] for _ in range(batches)]


def expected(state):
    out = collections.defaultdict(lambda: [0, 0, 0, 0])
    for _, deleted, survey, moment, score in state.values():
        if not deleted:
            row = out[survey, moment and moment.date()]
            row[0] += 1
            if score is not None:
                row[1 if score >= 9 else 2 if score >= 7 else 3] += 1
    return dict(out)


def apply(state, rows):
    """Newest version of each id; ties within a batch by the other columns, largest first."""
    best = {}
    for i, v, *rest in rows:
        if i is not None and v is not None:
            row = (v, bool(rest[0]), *rest[1:])
            low = tuple((x is not None, x) for x in row)
            if i not in best or low > best[i][0]:
                best[i] = (low, row)
    for i, (_, row) in best.items():
        if i not in state or row[0] > state[i][0]:
            state[i] = row


def found(trend):
    return {
        (r.survey_name, r.day): [r.daily_responses, r.daily_promoters, r.daily_passives, r.daily_detractors]
        for r in trend.trend().collect()
    }


def test_every_batch_equals_the_sums_of_the_state(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(maintained, "MOST_SUMS", 3)
    monkeypatch.setattr(snapshots, "MOST_LAYERS", 3)
    trend, state = MaintainedTrend(spark, str(tmp_path / "t"), 4), {}
    for number, rows in enumerate(random_changes(1, 6, 25)):
        changes = spark.createDataFrame(rows, CHANGE)
        assert trend.commit(number, changes)
        apply(state, rows)
        assert found(trend) == expected(state)
        assert not trend.commit(number, changes)
    assert found(trend) == expected(state)
    assert len(trend.table.files.manifest()["sums"]) <= 3
    trend.vacuum()
    assert found(MaintainedTrend(spark, str(tmp_path / "t"))) == expected(state)


def test_a_failed_commit_counts_nothing(spark, tmp_path, monkeypatch):
    trend, state = MaintainedTrend(spark, str(tmp_path / "t"), 4), {}
    first, second = random_changes(2, 2, 20)
    trend.commit(0, spark.createDataFrame(first, CHANGE))
    apply(state, first)

    def fail(self, manifest):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(snapshots.Snapshots, "publish", fail)
        with pytest.raises(OSError):
            trend.commit(1, spark.createDataFrame(second, CHANGE))
    assert found(trend) == expected(state)
    assert trend.commit(1, spark.createDataFrame(second, CHANGE))
    apply(state, second)
    assert found(trend) == expected(state)


def test_stream_of_files(spark, tmp_path):
    state, source = {}, str(tmp_path / "source")
    for rows in random_changes(3, 3, 20):
        # Unique versions: the order of the files does not matter then.
        rows = [(i, None if v is None else v * 1000 + n + 20 * len(state), *rest) for n, (i, v, *rest) in enumerate(rows)]
        spark.createDataFrame(rows, CHANGE).coalesce(1).write.mode("append").parquet(source)
        apply(state, rows)
    stream = spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", 1).parquet(source)
    maintain(stream, str(tmp_path / "t"), str(tmp_path / "checkpoint"), 4).awaitTermination()
    trend = MaintainedTrend(spark, str(tmp_path / "t"))
    assert found(trend) == expected(state)
    assert trend.table.files.manifest()["batch"] == 2
