"""Comments are read after the joins and ranks that need no text."""

import pytest
from pyspark.sql import functions as F

from voxmetric.operators import browse, text, themes
from voxmetric.plans.catalogue import ENTRIES, Tables
from voxmetric.sources import skipping

SF = "/root/testdata/sf0.001"


@pytest.fixture
def tables(spark):
    return Tables(spark, SF)


def rows(df):
    return sorted(map(repr, df.collect()))


def texts_in_joins(df):
    """Joins that move whole comments."""
    found, nodes = 0, [df._jdf.queryExecution().optimizedPlan()]
    while nodes:
        node = nodes.pop()
        below = node.children()
        below = [below.apply(i) for i in range(below.size())]
        if node.nodeName() == "Join":
            found += any("nps_explanation" in b.output().toString() for b in below)
        nodes += below
    return found


def test_references_become_the_comments(tables):
    late = tables.with_comments(tables.referenced)
    assert rows(late.select(tables.commented.columns)) == rows(tables.commented)
    none = tables.referenced.filter(F.col("comment_ref").isNull()).select("id")
    assert rows(none) == rows(tables.commented.filter(F.col("nps_explanation").isNull()).select("id"))


def test_same_rows_as_with_texts(tables):
    plain, late = tables.commented_assignments, tables.referenced_assignments
    fetch = tables.with_comments
    assert rows(themes.sample_quotes(late, comments=fetch)) == rows(themes.sample_quotes(plain))
    assert rows(text.keyword_hints(late, comments=fetch)) == rows(text.keyword_hints(plain))
    done = tables.enrichment.filter("response_id % 3 = 0")
    want = browse.unenriched_batch(tables.commented, done, 20, last=50).collect()
    batch = browse.unenriched_batch(tables.referenced, done, 20, last=50, comments=fetch)
    assert batch.select(tables.commented.select("id", "nps_explanation").columns).collect() == want and len(want) == 20


@pytest.mark.parametrize(
    "name", "key_words_theme keyword_hints enrich_pending enrich_scorer_counters enrich_with_scorer enrich_counters "
    "unenriched_batch theme_sample_quotes".split(),
)
def test_no_join_moves_comments(tables, name):
    assert texts_in_joins(ENTRIES[name].run(tables)) == 0


@pytest.mark.parametrize("name", "filter_has_theme_indexed filter_text_search_indexed theme_counts_indexed response_page_deep".split())
def test_no_join_moves_comments_of_an_indexed_table(tables, name, monkeypatch):
    seen, append = [], skipping.IndexedTable.append
    monkeypatch.setattr(skipping.IndexedTable, "append", lambda self, df: (seen.append(texts_in_joins(df)), append(self, df)))
    ENTRIES[name].run(tables)
    assert seen == [0]
