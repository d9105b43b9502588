"""Plans of the reports: what is shuffled, and what must not start a job."""

import datetime as dt
import re

import pytest
from compare import ROOT  # noqa: F401  (puts the repository on the path)
from pyspark.sql import functions as F

from voxmetric import schemas
from voxmetric.operators import enrichment, lookup, quality, survey, trends
from voxmetric.plans.catalogue import ENTRIES, Tables
from voxmetric.sources import ingest

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().sparkPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return re.findall(r"Exchange (\w+)partitioning\(([^)]*)", plan_of(df)[1])


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, SF)


def test_rollup_counts_facets_once(t):
    found = [keys for kind, keys in exchanges(ENTRIES["nps_daily_rollup"].run(t)) if "facet" in keys and "value" in keys]
    assert len(found) == 1


@pytest.mark.parametrize("name", ["survey_theme_insights", "survey_actions", "trend_survey_pivot"])
def test_no_global_sort_below_a_report(t, name):
    assert sum(kind == "range" for kind, _ in exchanges(ENTRIES[name].run(t))) <= 1


def jobs_started(spark, build):
    """Jobs but those that read the schema of a file."""
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("build", "building a frame")
    try:
        build()
        stages = [s for j in tracker.getJobIdsForGroup("build") for s in tracker.getJobInfo(j).stageIds]
        return [n for n in (tracker.getStageInfo(s).name for s in stages) if not n.startswith("parquet at")]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("name", ["reconcile_themes", "hierarchy_stats", "theme_rows_synonym_table", "similar_to_many"])
def test_building_a_frame_starts_no_job(spark, name):
    assert jobs_started(spark, lambda: ENTRIES[name].run(Tables(spark, SF))) == []


def test_hot_key_on_a_large_dictionary(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    facts = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, F.lit(7)).otherwise(F.col("id")).alias("key"))
    words = spark.range(2000).select(F.col("id").alias("key"), F.concat(F.lit("w"), "id").alias("word"))
    got = lookup.lookup_join(facts, words, "key")
    assert got.count() == 3000 and got.filter("word = 'w7'").count() == 2000
    assert got.filter("word is null").count() == 333
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")


def test_enrichment_records_follow_the_schema(spark):
    rows = spark.createDataFrame([(1, 9, "Te duur en traag"), (2, 3, "nvt"), (3, 5, None)], "id bigint, nps_score int, nps_explanation string")
    records = enrichment.enrich(rows)
    kinds = {f.name: f.dataType.simpleString() for f in records.schema}
    assert {f.name: f.dataType.simpleString() for f in schemas.ENRICHMENT}.items() <= kinds.items()
    got = {r.response_id: r for r in records.collect()}
    assert got[1].theme_scores and all(0 < v <= 1 for v in got[1].theme_scores.values())
    assert set(got[1].theme_scores) == set(got[1].themes)
    assert got[2].theme_scores is None and got[3].processing_status == "skipped"
    assert all(isinstance(r.created_at, dt.datetime) for r in got.values())


def test_merged_samples_are_the_first_different_ones(spark):
    rows = [(f"{i}", "s", "Prijs", 1, 0.5, ["x"]) for i in range(1, 6)] + [("6", "s", " prijs ", 1, 0.5, ["x", "y", "z"])]
    df = spark.createDataFrame(rows, "id string, survey_id string, theme_name string, mention_count int, sentiment_score double, sample_responses array<string>")
    got = survey.merge_theme_records(df).collect()
    assert [(r.mention_count, r.sample_responses) for r in got] == [(6, ["x", "y", "z"])]
    assert survey.merge_theme_records(df, samples=2).collect()[0].sample_responses == ["x", "y"]


def test_upsert_keeps_one_row_per_key(spark):
    current = spark.createDataFrame([(1, "a"), (2, "b")], "k bigint, v string")
    incoming = spark.createDataFrame([(1, "b"), (1, "c"), (3, "x"), (3, "x")], "k bigint, v string")
    got = sorted(map(tuple, quality.upsert(current, incoming, "k").collect()))
    assert got == [(1, "c"), (2, "b"), (3, "x")]


def test_two_answers_are_never_mixed(spark):
    answers = spark.createDataFrame(
        [(1, "p", ["x"], "negative", 0.2, None), (1, "q", ["y"], "positive", 0.9, None)],
        "response_id bigint, primary_theme string, themes array<string>, sentiment string, confidence double, new_theme string",
    )
    themes = spark.createDataFrame([("X", "x"), ("Y", "y"), ("q", "q")], "name string, slug string")
    assert [tuple(r) for r in enrichment.reconcile(answers, themes).collect()] == [(1, "q", ["Y"], "positive", 0.9)]


def test_each_file_has_its_own_separator_and_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text('SURVEY;NPS;CREATIE_DT\n"A;1";9;01/02/24\n')
    (tmp_path / "b.csv").write_text('NPS,SURVEY,CREATIE_DT,TITEL\n7,"B,2\nx",1/2/2024 10:15:00,T\n')
    (tmp_path / "c.csv").write_text("SURVEY|NPS|CREATIE_DT\nC|3|2024-02-01\n")
    rows = ingest.valid_rows(ingest.normalize(ingest.number_rows(ingest.read_csv(spark, str(tmp_path)))))
    got = sorted((r.survey_name, r.nps_score, r.creation_date, r.title_text, r.row_number) for r in rows.collect())
    day = dt.date(2024, 2, 1)
    assert got == [("A;1", 9, day, None, 1), ("B,2\nx", 7, day, "T", 1), ("C", 3, day, None, 1)]


def test_month_scores_have_the_rows_of_the_trend(t):
    assert sorted(map(tuple, trends.month_scores(t.responses).collect())) == [tuple(r) for r in trends.monthly_trend(t.responses).collect()]


def test_answers_are_parsed_once_for_all_readers(spark, t):
    """Answers that come in the session's partitions by response already, too."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = plan_of(ENTRIES["reconcile_themes"].run(t))[1]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Generate inline") == 1
    assert plan.count("from_json") == 1


def test_comments_are_searched_once_for_a_rule(t):
    assert plan_of(ENTRIES["reclassify_direct"].run(t))[0].count("ArrowEvalPython") == 1
