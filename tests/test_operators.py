import datetime as dt
import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxmetric.operators import (
    audit, browse, enrichment, mapping, nps, quality, similarity, survey, text, themes, trends,
)
from voxmetric.sources import reference_data as ref

RESPONSES = "id bigint, survey_name string, title_text string, nps_score int, creation_date date, created_at timestamp, nps_explanation string"
ENRICHMENT = "response_id bigint, themes array<string>, sentiment_score decimal(3,2), sentiment_label string, processing_status string, summary string"


def responses(spark, rows):
    """rows: (id, title, score, 'yyyy-mm-dd'[, comment])."""
    out = []
    for r in rows:
        d = dt.date.fromisoformat(r[3])
        out.append((r[0], "S", r[1], r[2], d, dt.datetime(d.year, d.month, d.day), r[4] if len(r) > 4 else None))
    return spark.createDataFrame(out, RESPONSES)


def enriched(spark, rows):
    """rows: (id, themes)."""
    return spark.createDataFrame(
        [(i, t, None, "neutral", "completed", "") for i, t in rows], ENRICHMENT
    )


# ------------------------------------------------------------------ trends


def test_change_uses_previous_present_month(spark):
    r = responses(spark, [
        (1, "A", 9, "2024-01-05"), (2, "A", 6, "2024-03-05"), (3, "A", 10, "2024-03-09"), (4, "A", 9, "2024-04-01"),
    ])
    got = trends.trend_by_title_with_change(r).orderBy("month").collect()
    assert [(x.month.month, x.nps, x.mom_delta) for x in got] == [(1, 100.0, None), (3, 0.0, -100.0), (4, 100.0, 100.0)]


def test_movers_gate_and_both_directions(spark):
    rows, n = [], 0
    for title, months in {"A": {"01": [9, 9], "02": [3, 3]}, "B": {"01": [9], "02": [3]}, "C": {"01": [9, 9]}}.items():
        for m, ss in months.items():
            for s in ss:
                n += 1
                rows.append((n, title, s, f"2024-{m}-03"))
    r = responses(spark, rows)
    got = trends.top_title_moves(r, min_responses=2).collect()
    assert sorted((x.title, x.move, x.mom_delta) for x in got) == [("A", "down", -200.0), ("A", "up", -200.0)]


def test_moves_between_latest_months_counts_missing_as_zero(spark):
    r = responses(spark, [(1, "A", 9, "2024-01-01"), (2, "A", 9, "2024-02-01"), (3, "B", 3, "2024-02-02")])
    got = {x.title_text: x for x in trends.title_moves_between_latest_months(r, min_responses=1).collect()}
    assert (got["B"].current_nps, got["B"].previous_nps, got["B"].previous_responses) == (-100.0, 0.0, 0)
    assert got["A"].mom_delta == 0.0


def test_period_change_with_empty_previous_month(spark):
    r = responses(spark, [(1, "A", 9, "2024-02-01")])
    assert tuple(nps.period_change(r, "2024-02-10").first()) == (0.0, 0.0, 0.0, 0.0)


def test_stability_needs_two_weeks(spark):
    r = responses(spark, [(1, "A", 9, "2024-02-01")])
    assert trends.weekly_stability(r).first().wow_stddev is None


# ------------------------------------------------------------------ themes


def test_theme_rows(spark):
    r = responses(spark, [(i, "A", 9, "2024-01-01") for i in range(1, 6)])
    e = enriched(spark, [(1, ["Prijs", " duur ", "te duur"]), (2, None), (3, []), (4, [" X ", "x"]), (99, ["prijs"])])
    got = themes.assignments(r, e).collect()
    assert sorted((x.response_id, x.theme, x.hits) for x in got) == [(1, "pricing", 3), (4, "x", 2)]
    only = themes.assignments(r, e, theme="pricing").collect()
    assert [(x.response_id, x.hits) for x in only] == [(1, 3)]


@pytest.mark.parametrize("limit", ["-1", "10m"])
def test_dictionary_of_any_size(spark, limit):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    rng = random.Random(1)
    words = ["prijs", "Duur", "levering", "hot", "hot", "hot", "niche"]
    r = responses(spark, [(i, "A", i % 11, "2024-01-01") for i in range(200)])
    e = enriched(spark, [(i, [rng.choice(words) for _ in range(rng.randint(0, 4))]) for i in range(200)])
    synonyms = spark.createDataFrame(ref.synonym_pairs(), "synonym string, canonical string")
    cols = ["response_id", "theme", "hits"]
    a = sorted(map(tuple, themes.assignments(r, e).select(*cols).collect()))
    b = sorted(map(tuple, themes.assignments_with_dictionary(r, e, synonyms).select(*cols).collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert a == b


def test_tail_cluster(spark):
    r = responses(spark, [(i, "A", 9 if i % 2 else 3, "2024-01-01") for i in range(8)])
    e = enriched(spark, [(i, ["big"] + ([f"t{i}"] if i < 3 else [])) for i in range(8)])
    rows = themes.assignments(r, e)
    o = {x.theme: x for x in themes.overview(rows, min_mentions=3).collect()}
    assert set(o) == {"big", ref.TAIL_CLUSTER}
    assert o[ref.TAIL_CLUSTER].mentions == 3 and o["big"].mentions == 8
    assert o[ref.TAIL_CLUSTER].pct_promoters == 0.3333
    assert set(x.theme for x in themes.overview(rows.filter("theme = 'big'"), min_mentions=3).collect()) == {"big"}
    whole = themes.overview(rows, min_mentions=None).agg(F.sum("mentions")).first()[0]
    assert whole == sum(x.mentions for x in o.values())
    assert [x.theme for x in themes.overview(rows, min_mentions=100).collect()] == [ref.TAIL_CLUSTER]


def test_shares_add_up(spark):
    rng = random.Random(5)
    r = responses(spark, [(i, "A", i % 11, "2024-01-01") for i in range(300)])
    e = enriched(spark, [(i, rng.sample("abcdefg", 2)) for i in range(300)])
    total = sum(x.share_pct for x in themes.aggregate(themes.assignments(r, e)).collect())
    assert abs(total - 100) < 0.5


# ----------------------------------------------------------------- mapping


def test_mapping_edges(spark):
    names = ["content_kwaliteit", "app ervaring", "xyz", None, "", "overige", "  ", "price list"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, theme string")
    got = [(x.main_category, x.sub_category, x.confidence) for x in mapping.map_themes(df).orderBy("i").collect()]
    assert got == [
        ("Content", "Content Kwaliteit", 0.95), ("User Experience", "App Ervaring", 0.75),
        ("Other", "Uncategorized", 0.1), ("Other", "Unknown", 0.0), ("Other", "Unknown", 0.0),
        ("Content", "Algemene Feedback", 0.95), ("Content", "Content Kwaliteit", 0.75), ("Price", "Cost", 0.8),
    ]


def test_first_rule_wins_and_others_stay(spark):
    r = responses(spark, [(1, "A", 9, "2024-01-01", "Nieuws en prijs"), (2, "A", 9, "2024-01-01", "bezorging"), (3, "A", 9, "2024-01-01", None)])
    e = enriched(spark, [(1, ["overige", "content_kwaliteit"]), (2, ["pricing"]), (3, ["overige"])])
    got = {x.response_id: x.themes for x in mapping.reclassify(e, r, ref.RECLASSIFY_DIRECT).collect()}
    assert got == {1: ["content_kwaliteit"], 2: ["pricing"], 3: ["overige"]}


def test_legacy_fold(spark):
    rng = random.Random(2)
    rows = [(f"zz{i}", rng.randint(1, 9), rng.random() * 10, rng.random()) for i in range(1500)]
    df = spark.createDataFrame(rows, "theme string, count_responses bigint, avg_nps double, avg_sentiment double")
    got = mapping.hierarchy_folded(df).collect()
    want = 0.0
    for _, _, x, _ in sorted(rows, key=lambda r: (-r[1], r[0])):
        want = (want + x) / 2
    assert len(got) == 1 and abs(got[0].avg_nps - want) < 1e-12


def test_seed_if_absent(spark):
    have = spark.createDataFrame([("a",)], "synonym string")
    seed = spark.createDataFrame([("a", "x"), ("b", "y"), ("b", "z")], "synonym string, canonical string")
    assert [x.synonym for x in mapping.seed_if_absent(have, seed, ["synonym"]).collect()] == ["b"]


# ------------------------------------------------------------------ repair


def test_newest_of_a_hot_key(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") < 4000, 0).otherwise(F.col("id")).alias("response_id"),
        F.timestamp_seconds(F.col("id") % 50).alias("created_at"), F.col("id").alias("row_id"),
    )
    got = quality.newest_per_key(df, "response_id", "created_at", "row_id")
    assert got.count() == 1001
    assert got.filter("response_id = 0").first().row_id == 3999


def test_repair_drops_orphans(spark):
    r = responses(spark, [(1, "A", 9, "2024-01-01")])
    e = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), 1), (1, dt.datetime(2024, 1, 2), 2), (7, dt.datetime(2024, 1, 1), 3), (None, dt.datetime(2024, 1, 1), 4)], "response_id bigint, created_at timestamp, row_id int")
    assert [x.row_id for x in quality.repair_enrichment(e, r, "row_id").collect()] == [2]
    assert sorted(x.row_id for x in quality.orphans(e, r, "response_id", "id").collect()) == [3, 4]


def test_survey_counts_do_not_multiply(spark):
    a = spark.createDataFrame([("s", "n", 3, "completed")], "id string, name string, total_responses bigint, status string")
    kids = lambda n: spark.createDataFrame([("s",)] * n, "survey_id string")
    got = survey.survey_summary(a, kids(3), kids(2), kids(4)).first()
    assert (got.processed_responses, got.theme_count, got.insight_count) == (3, 2, 4)


# -------------------------------------------------------------------- text


def test_answer_parsing(spark):
    texts = ['{"primary_theme":"a","themes":["a","b"],"sentiment":"promoter","confidence":0.9}',
             'Sure: {"themes":["x"],"confidence":"0.4","new_theme":""} done', "nothing", "[1]", None,
             '{"themes":"oops","confidence":null}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [x.a.asDict() for x in df.orderBy("i").select(text.parse_answer(F.col("t")).alias("a")).collect()]
    assert got[0] == {"primary_theme": "a", "themes": ["a", "b"], "sentiment": "promoter", "confidence": 0.9, "new_theme": None}
    assert got[1]["themes"] == ["x"] and got[1]["confidence"] == 0.4 and got[1]["new_theme"] is None
    for x in got[2:]:
        assert x == {"primary_theme": "", "themes": [], "sentiment": "neutral", "confidence": 0.6, "new_theme": None}


def test_theme_list_parsing(spark):
    texts = ['[{"name":"App  Use","confidence":2},{"name":"b","confidence":0}]', 'x [{"confidence":0.3}] y',
             '- "prijs_hoog" ok\n- "prijs_hoog"\n"Nope" "ja_wel"', "geen"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [[(y.name, y.confidence) for y in x[0]] for x in df.orderBy("i").select(text.parse_theme_list(F.col("t"))).collect()]
    assert got == [[("app_use", 1.0)], [("unknown_theme", 0.3)], [("prijs_hoog", 0.7), ("ja_wel", 0.7)], []]


def test_code_fence(spark):
    df = spark.createDataFrame([('```json\n[{"n":1}]\n```',), ("``` [] ```",), ("[2]",)], "t string")
    assert [x[0] for x in df.select(text.strip_code_fence(F.col("t"))).collect()] == ['[{"n":1}]', "[]", "[2]"]


def test_key_words_over_whole_text(spark):
    body = "woord " * 5000 + "einde, einde! 12345"
    r = responses(spark, [(1, "A", 9, "2024-01-01", body)])
    assert [(x.word, x["count"]) for x in text.key_words(r).collect()] == [("woord", 5000), ("einde", 2)]


def test_custom_scorer_marks_failures(spark):
    r = responses(spark, [(1, "A", 9, "2024-01-01", "goed"), (2, "A", 3, "2024-01-01", "kapot"), (3, "A", 3, "2024-01-01", " nvt "), (4, "A", 7, "2024-01-01", None)])

    def scorer(texts: pd.Series) -> pd.DataFrame:
        if texts.str.contains("kapot").any():
            raise RuntimeError("no")
        return pd.DataFrame({"themes": [["x"]] * len(texts), "sentiment_score": 0.5, "keywords": [["k"]] * len(texts)})

    out = enrichment.enrich_with(r, scorer, "m")
    got = {x.response_id: (x.processing_status, x.themes, x.sentiment_label) for x in out.collect()}
    assert got == {1: ("completed", ["x"], "positive"), 2: ("failed", None, "neutral"), 3: ("skipped", None, "neutral"), 4: ("skipped", None, "neutral")}
    assert tuple(enrichment.batch_counters(out).first()) == (1, 2, 1)


def test_reconcile(spark):
    dim = spark.createDataFrame([("pricing", "pricing"), ("Te duur", "te-duur")], "name string, slug string")
    a = spark.createDataFrame(
        [(1, "pricing", ["TE DUUR", "te-duur", "pricing"], None), (2, "Nieuw", ["pricing"], "Nieuw"), (3, "", [], None), (4, "pricing", [" ", "nieuw!"], "Anders")],
        "response_id bigint, primary_theme string, themes array<string>, new_theme string",
    ).withColumns({"sentiment": F.lit("neutral"), "confidence": F.lit(0.5)})
    got = {x.response_id: (x.primary_theme, x.themes) for x in enrichment.reconcile(a, dim).collect()}
    assert got == {1: ("pricing", ["Te duur", "pricing"]), 2: ("Nieuw", ["Nieuw", "pricing"]), 3: ("overige", ["overige"]), 4: ("pricing", ["Nieuw"])}
    assert sorted(x.name for x in enrichment.new_themes(a, dim).collect()) == ["Nieuw", "overige"]


# ------------------------------------------------------------------ vectors


def test_nearest_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(400, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "response_id bigint, embedding array<double>").repartition(5)
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    sims = unit @ unit[17]
    want = [int(i) for i in np.argsort(-sims) if i != 17][:9]
    assert [x.response_id for x in similarity.nearest_to_response(df, 17, 9).collect()] == want
    many = similarity.nearest_to_many(df, df.filter("response_id in (17, 18)"), 8, 9)
    assert [x.response_id for x in many.filter("query_id = 17").orderBy("rank").collect()] == want
    centroids = similarity.fit_centroids(df, 8, lists=8, iterations=3)
    similarity.write_lists(similarity.assign_lists(df, centroids), str(tmp_path / "lists"))
    listed = spark.read.parquet(str(tmp_path / "lists"))
    near = similarity.nearest_in_lists(listed, centroids, m[17].tolist(), k=10, probes=8).collect()
    assert [x.response_id for x in near] == [17, *want]
    few = {x.response_id for x in similarity.nearest_in_lists(listed, centroids, m[17].tolist(), k=10, probes=4).collect()}
    assert len(few & {17, *want}) >= 5
    plan = similarity.nearest_in_lists(listed, centroids, m[17].tolist(), k=10, probes=2)
    assert "PartitionFilters: [list_id" in plan._jdf.queryExecution().executedPlan().toString()


def test_vectors_without_direction_take_no_part(spark):
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0]), (4, None), (5, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "response_id bigint, embedding array<double>")
    assert [(x.response_id, x.similarity) for x in similarity.nearest_to_vector(df, [1.0, 0.0], 9).collect()] == [(2, 1.0), (5, 1.0), (3, 0.0)]
    many = similarity.nearest_to_many(df, df, 2, 1).collect()
    assert sorted((x.query_id, x.response_id) for x in many) == [(2, 5), (3, 2), (5, 2)]
    assert similarity.fit_centroids(df, 2, lists=2).shape == (2, 2)


# ------------------------------------------------------------------- survey


def answers(spark, rows):
    return spark.createDataFrame(
        rows,
        "survey_id string, row_number bigint, question_text string, question_order int, response_text string, "
        "ai_analysis struct<sentiment:string,sentiment_score:double,themes:array<string>>",
    )


def test_quotes_are_not_reused(spark):
    """Greedy quote picking against a plain loop, with a hot repeated snippet."""
    rng = random.Random(9)
    rows = []
    for i in range(250):
        label = rng.choice(["positive", "negative", "neutral"])
        tags = rng.sample(["alpha", "beta", "gamma", "delta", "eps", "zeta"], rng.randint(1, 4))
        quote = "zelfde tekst" if rng.random() < 0.4 else f"tekst {rng.randint(0, 30)}"
        rows.append(("s", i, "q", 0, quote, (label, rng.choice([0.2, 0.5, 0.9]), tags)))
    got = survey.theme_insights(answers(spark, rows)).orderBy("rank").collect()
    by_theme = defaultdict(list)
    for _, _, _, _, quote, (_, _, tags) in rows:
        for t in tags:
            by_theme[t.capitalize()].append(quote + "...")
    used = set()
    for x in got:
        want = [q for q in by_theme[x.theme] if q not in used][:3]
        assert x.quotes == want
        used |= set(want)


def test_invalid_analysis_defaults(spark):
    a = answers(spark, [("s", 1, "q", 0, "t", ("positive", 0.0, ["x"])), ("s", 2, "q", 0, "t", None), ("s", 3, "q", 0, "t", ("negative", 0.4, ["x"]))])
    got = {x.row_number: (x.sentiment_label, x.sentiment_score, x.themes) for x in survey.validated(a).collect()}
    assert got == {1: ("neutral", 0.0, []), 2: ("neutral", 0.0, []), 3: ("negative", 0.4, ["x"])}


def test_action_plan_parsing(spark):
    plan = "Intro\n\n**1. Prijs**\n• Mentioned by 3 customers\n• What customers love: \"a\"\n• Action: doe iets\n\n**2. App**\n• Why this matters: veel\n"
    df = spark.createDataFrame([("s", plan)], "survey_id string, content string")
    got = survey.parse_action_plan(df).orderBy("section").collect()
    assert [(x.section, x.title, x.positive_feedback, x.action, x.why_matters) for x in got] == [
        (1, "Prijs", '"a"', "doe iets", ""), (2, "App", "", "", "veel")]


# -------------------------------------------------------------------- audit


def test_audit_skips_missing_inputs(spark):
    r = responses(spark, [(1, "A", 9, "2024-01-01", "heel fijn")])
    got = {x.key: x.status for x in audit.run_audit(audit.audit_inputs(r, "2024-01-10")).collect()}
    assert got["fatigue"] == got["response_rate"] == got["stability"] == "skip"
    assert got["verbatim_share"] == "pass" and got["data_volume"] == "fail"
    empty = audit.run_audit(audit.audit_inputs(r, "2030-01-01")).collect()
    assert "data_volume" not in {x.key for x in empty}


def test_page_and_keyset(spark):
    r = responses(spark, [(i, "A", 9, f"2024-01-{i:02d}", "tekst") for i in range(1, 10)])
    e = enriched(spark, [(1, ["x"])])
    assert [x.id for x in browse.page(r, e, limit=3, offset=2).collect()] == [7, 6, 5]
    assert [x.id for x in browse.unenriched_batch(r, e, 2, last=None).collect()] == [2, 3]
