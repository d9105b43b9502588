"""Side tables of files: the same rows as a scan, from fewer files."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from voxmetric.sources.skipping import IndexedTable

SCHEMA = "id bigint, themes array<string>, note string, created_at timestamp"
START = dt.datetime(2024, 1, 1)


def row(i):
    """One row of which a few have a rare theme or word; many share one moment."""
    themes = ["common", None, "t%d" % (i // 100)] if i % 9 else None
    note = None if i % 11 == 0 else f"Note {i} of the file, Größe {i % 7}" + (" NEEDLE ünder" if i in (105, 333) else "")
    moment = START + dt.timedelta(hours=i) if i % 3 else START + dt.timedelta(days=2)
    return (i, themes, note, None if i % 50 == 49 else moment)


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    made = IndexedTable(spark, str(tmp_path_factory.mktemp("indexed") / "t"), themes="themes", text="note", stamp="created_at")
    for lo in range(0, 500, 100):
        made.append(spark.createDataFrame([row(i) for i in range(lo, lo + 100)], SCHEMA).coalesce(1))
    return made


def ids(df):
    return sorted(r.id for r in df.collect())


@pytest.mark.parametrize("theme", ["common", "t3", "absent"])
def test_rows_of_a_theme(table, theme):
    assert ids(table.has_theme(theme)) == ids(table.rows().filter(F.array_contains("themes", theme)))


def test_files_of_a_theme(table):
    assert len(table.files()) == 5 and len(table.files_with_theme("t3")) == 1 and not table.files_with_theme("absent")
    assert len(table.has_theme("t3").inputFiles()) == 1
    counts = {r.theme: r.n for r in table.theme_counts().collect()}
    assert counts["common"] == sum(1 for i in range(500) if i % 9) and counts["t3"] == sum(1 for i in range(300, 400) if i % 9)


@pytest.mark.parametrize("needle", ["needle ÜNDER", "needle", "note 42", "größe 3", "ö", "", "xyzzy", "of the file"])
def test_rows_with_a_text(table, needle):
    assert ids(table.search(needle)) == ids(table.rows().filter(F.lower("note").contains(needle.lower())))


def test_skipped_files(table):
    assert len(table.search("needle").inputFiles()) == 2
    report = table.search_report("needle").first()
    assert (report.files, report.read, report.skipped_share) == (5, 2, 0.6)
    assert table.search_report("xyzzy").first().skipped_share == 1.0
    assert table.search_report("ö").first().skipped_share == 0.0


@pytest.mark.parametrize(("offset", "limit"), [(0, 10), (37, 5), (250, 3), (310, 60), (480, 50), (489, 1), (500, 5), (0, 500), (120, 1)])
def test_pages(table, offset, limit):
    got = [r.id for r in table.page(offset, limit).collect()]
    key = lambda r: (r[3] is None, -(r[3] or START).timestamp(), r[0])
    assert got == [r[0] for r in sorted(map(row, range(500)), key=key)][offset : offset + limit]


def test_a_page_sorts_its_range_only(table):
    plan = table.page(5, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "created_at" in plan.split("Filter")[1] and "Offset 500" not in plan
    hot = table.page(400, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in hot


def test_files_without_entries_are_read(spark, table, tmp_path):
    other = IndexedTable(spark, str(tmp_path / "t"), themes="themes", text="note", stamp="created_at")
    other.append(spark.createDataFrame([row(i) for i in range(10)], SCHEMA))
    # An append that fails before its entries are written.
    spark.createDataFrame([row(105)], SCHEMA).write.parquet(f"{other.path}/rows/late")
    assert ids(other.search("needle")) == [105] and ids(other.has_theme("t1")) == [105]
    assert 105 in ids(other.page(0, 20))
    other.index("rows/late")
    assert len(other.search("needle").inputFiles()) == 1
