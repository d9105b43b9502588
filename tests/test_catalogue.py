"""Every catalogue query against its SQL twin, and the shape of key plans."""

import re

import pytest
from compare import compare, connect

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()
RUNS = entry.queries()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(RUNS))
def test_query(spark, con, name):
    frame = RUNS[name](spark, SF)
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan(frame))
    if name not in SQL:
        assert frame.columns and frame.count() > 0
        return
    assert compare(frame, con, SQL[name]) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["theme_sample_quotes", "newest_enrichment", "similar_to_many", "keyword_hints"])
def test_groups_are_cut_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in plan(RUNS[name](spark, SF))


def test_predicates_and_columns_reach_the_scan(spark):
    text = plan(RUNS["pruned_scan"](spark, SF))
    assert "PushedFilters: [IsNotNull" in text and "GreaterThanOrEqual(o_orderdate" in text
    assert "o_totalprice" not in text.split("ReadSchema")[-1]
