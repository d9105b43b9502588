"""Analysis of ad-hoc survey answers: themes, severity, insights, progress.

``answers`` are long-form rows (survey_id, row_number, question_text,
question_order, response_text, ai_analysis); every report covers all surveys
of the table at once.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import cleaning, scores
from ..functions.rounding import rounded_ratio
from .nps import top_per_group
from .text import top_words_per_question
from .themes import theme_hits

_UNITS = 10_000  # sentiment scores are summed in steps of 10^-4


def _in_order() -> list[Column]:
    """Reading order of the answers of a survey."""
    return [F.asc("row_number"), F.asc("question_order")]


def validated(answers: DataFrame) -> DataFrame:
    """Adds sentiment_label, sentiment_score, themes; defaults for invalid analyses.

    An analysis without label, score or themes is invalid, and so is score 0.
    """
    a = F.col("ai_analysis")
    valid = F.coalesce(
        (a["sentiment"] != "") & (a["sentiment_score"] != 0) & a["themes"].isNotNull(),
        F.lit(False),
    )
    return answers.withColumns(
        {
            "sentiment_label": F.when(valid, a["sentiment"]).otherwise("neutral"),
            "sentiment_score": F.when(valid, a["sentiment_score"]).otherwise(0.0),
            "themes": F.when(valid, a["themes"]).otherwise(
                F.array().cast("array<string>")
            ),
        }
    )


def answer_themes(answers: DataFrame) -> DataFrame:
    """One row per (answer, cleaned theme) with the number of raw mentions."""
    return validated(answers).select(
        "survey_id",
        "row_number",
        "question_text",
        "question_order",
        "response_text",
        "sentiment_label",
        F.round(F.col("sentiment_score") * _UNITS).cast("bigint").alias("units"),
        F.transform("themes", cleaning.theme_display_name).alias("named"),
    ).select(
        "survey_id", "row_number", "question_text", "question_order", "response_text",
        "sentiment_label", "units", F.inline(theme_hits(F.col("named"))),
    )


def _theme_sums(rows: DataFrame) -> DataFrame:
    hits, label = F.col("hits").cast("bigint"), F.col("sentiment_label")

    def weight(value: str) -> Column:
        return F.coalesce(F.sum(F.when(label == value, hits)), F.lit(0))

    return rows.groupBy("survey_id", "theme").agg(
        F.sum(hits).alias("mentions"),
        F.count(F.lit(1)).alias("answers"),
        weight("positive").alias("positive"),
        weight("negative").alias("negative"),
        F.sum(F.col("units") * hits).alias("unit_sum"),
        F.sum("units").alias("answer_units"),
    )


def theme_aggregate(answers: DataFrame) -> DataFrame:
    """Per survey and theme: mentions, negative mentions, sentiment sum and mean."""
    return _theme_sums(answer_themes(answers)).select(
        "survey_id",
        "theme",
        "mentions",
        F.col("negative").alias("negative_count"),
        (F.col("unit_sum") / float(_UNITS)).alias("sentiment_sum"),
        rounded_ratio(F.col("unit_sum"), F.col("mentions") * _UNITS, 4).alias("avg_sentiment"),
    )


def theme_records(answers: DataFrame, *, samples: int = 3) -> DataFrame:
    """Theme rows: mentions, mean sentiment over answers, first sample answers."""
    rows = answer_themes(answers)
    first = (
        top_per_group(
            rows.select("survey_id", "theme", "row_number", "question_order", "response_text"),
            ["survey_id", "theme"], _in_order(), samples,
        )
        .groupBy("survey_id", "theme")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "response_text"))).alias("s"))
    )
    return (
        _theme_sums(rows)
        .join(first, ["survey_id", "theme"])
        .select(
            "survey_id",
            F.col("theme").alias("theme_name"),
            F.col("mentions").alias("mention_count"),
            rounded_ratio(F.col("answer_units"), F.col("answers") * _UNITS, 4).alias("sentiment_score"),
            F.transform("s", lambda x: x["response_text"]).alias("sample_responses"),
        )
    )


def _survey_totals(answers: DataFrame) -> DataFrame:
    label = F.col("sentiment_label")
    return validated(answers).groupBy("survey_id").agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(label == x).alias(x) for x in ("positive", "negative", "neutral")],
    )


def severity(answers: DataFrame) -> DataFrame:
    """Severity of every theme: volume weight x sentiment impact, worst first."""
    return theme_severity(answers).orderBy("survey_id", F.desc("severity"), "theme")


def theme_severity(answers: DataFrame) -> DataFrame:
    """The rows of ``severity`` in no order, to calculate with."""
    totals = _survey_totals(answers).select("survey_id", "total")
    t = _theme_sums(answer_themes(answers)).join(totals, "survey_id")
    n = F.col("mentions")
    volume = (
        F.when(F.col("total") <= 30, F.sqrt(n))
        .when(F.col("total") <= 200, F.pow(n, F.lit(0.75)))
        .otherwise(n.cast("double"))
    )
    negative_share = F.col("negative") / n
    mean = F.col("unit_sum") / (n * float(_UNITS))
    distance = F.abs(0.5 - F.when(F.col("unit_sum") == 0, 0.5).otherwise(mean))
    impact = F.when(negative_share > 0.5, negative_share).otherwise(1 - negative_share)
    score = volume * (0.7 * impact + 0.3 * (1 + distance))
    return t.select(
        "survey_id",
        "theme",
        "total",
        "mentions",
        "answers",
        "positive",
        "negative",
        "unit_sum",
        F.round(negative_share, 6).alias("negative_share"),
        F.round(score, 6).alias("severity"),
    )


def ranked_severity(answers: DataFrame, k: int) -> DataFrame:
    """The ``k`` most severe themes of each survey with their rank."""
    return top_per_group(
        theme_severity(answers), ["survey_id"], [F.desc("severity"), F.asc("theme")], k
    )


def satisfaction(answers: DataFrame) -> DataFrame:
    """Per survey: answers, share of positive ones, number of negative ones."""
    return _survey_totals(answers).select(
        "survey_id",
        "total",
        F.col("positive").alias("positive_count"),
        F.col("negative").alias("negative_count"),
        scores.percent(F.col("positive"), F.col("total"), 0).cast("int").alias("satisfaction_rate"),
    )


# -------------------------------------------------------------- insights


def _evidence(total: Column, answers: Column) -> Column:
    size = F.when(total <= 30, 1).when(total <= 200, 2).otherwise(3)
    return F.least(size, answers.cast("int"))


def theme_insights(answers: DataFrame, *, k: int = 5) -> DataFrame:
    """Top themes with metrics, unused quotes and an impact of at most 1.

    Themes pick quotes in rank order and skip snippets an earlier theme used.
    At most 3 quotes per theme are used, so a theme never needs more than its
    first 3 rows of each of its first few snippets; everything else is cut
    before it is gathered.
    """
    most = 3
    top = ranked_severity(answers, k)
    quotes = (
        answer_themes(answers)
        .withColumn("quote", cleaning.snippet(F.col("response_text"), 150))
        .filter(F.col("quote").isNotNull())
        # k rows per survey, and the join keeps only their answers.
        .join(top.select("survey_id", "theme"), ["survey_id", "theme"])
        .select("survey_id", "theme", "row_number", "question_order", "quote", F.explode(F.sequence(F.lit(1), "hits")).alias("copy"))
    )
    order = [*_in_order(), F.asc("copy")]
    repeats = top_per_group(quotes, ["survey_id", "theme", "quote"], order, most).drop("rank")
    candidates = top_per_group(
        repeats, ["survey_id", "theme"], order, most + most * most * (k - 1)
    ).groupBy("survey_id", "theme").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct(F.col("rank").alias("r"), "quote"))),
            lambda x: x["quote"],
        ).alias("quotes")
    )
    ranked = top.join(candidates, ["survey_id", "theme"], "left").withColumn(
        "want", _evidence(F.col("total"), F.col("answers"))
    )
    # At most k rows per survey are folded in rank order.
    per_survey = ranked.groupBy("survey_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "rank", "theme", "mentions", "negative", "unit_sum", "severity", "want",
                    F.coalesce("quotes", F.array().cast("array<string>")).alias("quotes"),
                )
            )
        ).alias("themes")
    )

    def pick(state, t):
        fresh = F.filter(t["quotes"], lambda q: ~F.array_contains(state["used"], q))
        chosen = F.slice(fresh, F.lit(1), t["want"])
        return F.struct(
            F.concat(state["used"], chosen).alias("used"),
            F.concat(state["picked"], F.array(chosen)).alias("picked"),
        )

    start = F.struct(
        F.array().cast("array<string>").alias("used"),
        F.array().cast("array<array<string>>").alias("picked"),
    )
    folded = per_survey.withColumn("picked", F.aggregate("themes", start, pick)["picked"])
    flat = folded.select("survey_id", F.inline(F.arrays_zip("themes", "picked")))
    t = F.col("themes")
    mean = F.when(t["unit_sum"] == 0, F.lit(50)).otherwise(
        rounded_ratio(t["unit_sum"] * 100, t["mentions"] * _UNITS, 0)
    )
    return flat.select(
        "survey_id",
        t["rank"].alias("rank"),
        t["theme"].alias("theme"),
        t["mentions"].alias("mentions"),
        scores.percent(t["negative"], t["mentions"], 0).cast("int").alias("negative_pct"),
        mean.cast("int").alias("sentiment_pct"),
        F.col("picked").alias("quotes"),
        F.round(F.least(t["severity"] / 10, F.lit(1.0)), 6).alias("impact"),
    )


# Action by keyword in the theme name, first hit wins.
NEGATIVE_ACTIONS = (
    ("review_shipping", ("shipping", "delivery")),
    ("review_pricing", ("pricing", "cost", "price")),
    ("check_quality", ("quality", "product")),
    ("improve_support", ("support", "service")),
    ("research_usability", ("interface", "usability", "navigation")),
)


def _action(theme: Column, positive: Column, negative: Column) -> Column:
    low = F.lower(theme)
    cause = None
    for name, words in NEGATIVE_ACTIONS:
        cond = F.lit(False)
        for w in words:
            cond = cond | low.contains(w)
        cause = F.when(cond, name) if cause is None else cause.when(cond, name)
    return (
        F.when((negative > 0) & (positive > 0), "maintain_and_fix")
        .when(negative > 0, cause.otherwise("find_root_cause"))
        .when(positive > 0, "amplify")
        .otherwise("monitor")
    )


def _first_quotes(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """First ``k`` positive and negative answers per group, as arrays p and n."""
    mooded = rows.filter(F.col("sentiment_label").isin("positive", "negative")).select(
        *keys, "sentiment_label", "row_number", "question_order", "response_text"
    )
    picked = top_per_group(mooded, [*keys, "sentiment_label"], _in_order(), k)

    def texts(label: str) -> Column:
        cond = F.col("sentiment_label") == label
        gathered = F.array_sort(F.collect_list(F.when(cond, F.struct("rank", "response_text"))))
        return F.transform(gathered, lambda x: x["response_text"])

    return picked.groupBy(*keys).agg(texts("positive").alias("p"), texts("negative").alias("n"))


def action_rows(answers: DataFrame, *, k: int = 3) -> DataFrame:
    """Action plan of the top themes: counts, first quotes, action, importance."""
    keys = ["survey_id", "theme"]
    top = ranked_severity(answers, k)
    rows = answer_themes(answers).join(top.select(*keys), keys, "left_semi")
    quotes = _first_quotes(rows, keys, 2)
    t = top.join(quotes, keys, "left")

    def quote(side: str, i: int) -> Column:
        return F.try_element_at(side, F.lit(i))

    love = F.substring(quote("p", 1), 1, 200)
    issue = F.substring(quote("n", 1), 1, 200)
    more_love = F.when(issue.isNull(), cleaning.snippet(quote("p", 2), 150))
    more_issue = F.when(love.isNull(), cleaning.snippet(quote("n", 2), 150))
    action = _action(F.col("theme"), F.col("positive"), F.col("negative"))
    return t.select(
        "survey_id",
        "rank",
        "theme",
        "mentions",
        F.col("positive").alias("positive_count"),
        F.col("negative").alias("negative_count"),
        "severity",
        scores.percent(F.col("negative"), F.col("mentions"), 0).cast("int").alias("negative_pct"),
        love.alias("positive_quote"),
        issue.alias("negative_quote"),
        more_love.alias("second_positive_quote"),
        more_issue.alias("second_negative_quote"),
        action.alias("action"),
        F.when(
            action == "maintain_and_fix",
            F.concat(
                F.lit("Maintain: "), F.substring(love, 1, 50), F.lit("... | Fix: "),
                F.substring(issue, 1, 50), F.lit("..."),
            ),
        ).alias("action_detail"),
        F.when(F.col("mentions") >= 3, "significant")
        .when(F.col("mentions") >= 2, "worth_investigating")
        .otherwise("early_signal")
        .alias("importance"),
    )


def action_plan_text(actions: DataFrame) -> DataFrame:
    """Action rows of a survey as one stored text with numbered sections."""

    def line(label: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(f"• {label}"), value, F.lit("\n"))).otherwise("")

    def quoted(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.concat(F.lit('"'), F.col(c), F.lit('"')))

    section = F.concat(
        F.lit("**"), F.col("rank").cast("string"), F.lit(". "), "theme", F.lit("**\n"),
        line(
            "Mentioned by ",
            F.format_string(
                "%d customers (%d positive, %d negative)",
                "mentions", "positive_count", "negative_count",
            ),
        ),
        line("What customers love: ", quoted("positive_quote")),
        line("Issues to address: ", quoted("negative_quote")),
        line("Action: ", F.coalesce("action_detail", "action")),
        line("Why this matters: ", F.col("importance")),
        F.lit("\n"),
    )
    return actions.groupBy("survey_id").agg(
        F.concat(
            F.lit("**Actions by theme:**\n\n"),
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("rank", section.alias("t")))),
                    lambda x: x["t"],
                ),
                "",
            ),
        ).alias("content")
    )


def parse_action_plan(plans: DataFrame, column: str = "content") -> DataFrame:
    """Stored action text to one row per numbered section with its labelled fields."""
    sections = F.split(F.col(column), r"\*\*[0-9]+\.\s+")
    parts = plans.select(
        *[c for c in plans.columns if c != column],
        F.posexplode(F.slice(sections, F.lit(2), F.greatest(F.size(sections) - 1, F.lit(0)))).alias("index", "section"),
    )
    lines = F.filter(
        F.split("section", "\n"), lambda x: F.length(cleaning.strip(x)) > 0
    )

    def field(mark: str, drop: str | None = None) -> Column:
        hit = F.try_element_at(F.filter("lines", lambda x: x.contains(mark)), F.lit(1))
        text = hit if drop is None else F.replace(hit, F.lit(drop), F.lit(""))
        return F.coalesce(cleaning.strip(text), F.lit(""))

    first = F.try_element_at("lines", F.lit(1))
    title = cleaning.strip(F.replace(first, F.lit("**"), F.lit("")))
    fallback = F.concat(F.lit("Section "), (F.col("index") + 1).cast("string"))
    return parts.withColumn("lines", lines).select(
        *[c for c in plans.columns if c != column],
        (F.col("index") + 1).alias("section"),
        F.coalesce(F.nullif(title, F.lit("")), fallback).alias("title"),
        field("Mentioned by").alias("metrics"),
        field("What customers love:", "• What customers love: ").alias("positive_feedback"),
        field("Issues to address:", "• Issues to address: ").alias("issue_reported"),
        field("Action:", "• Action: ").alias("action"),
        field("Why this matters:", "• Why this matters: ").alias("why_matters"),
    )


def question_summary(answers: DataFrame) -> DataFrame:
    """Per question: answers, positive share, reading of the mood."""
    q = F.coalesce("question_text", F.lit("Unknown")).alias("question_text")
    t = validated(answers).groupBy("survey_id", q).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("sentiment_label") == "positive").alias("positive"),
        F.count_if(F.col("sentiment_label") == "negative").alias("negative"),
    )
    rate = scores.percent(F.col("positive"), F.col("total"), 0)
    return t.select(
        "survey_id",
        "question_text",
        "total",
        "positive",
        "negative",
        rate.cast("int").alias("sentiment_rate"),
        F.when(rate >= 70, "positive").when(rate <= 30, "concerns").otherwise("mixed").alias("analysis"),
    )


def question_insights(answers: DataFrame, *, k: int = 3) -> DataFrame:
    """Top themes of each question with counts and first quotes."""
    keys = ["survey_id", "question_text"]
    rows = answer_themes(answers).withColumn(
        "question_text", F.coalesce("question_text", F.lit("Unknown"))
    )
    counts = rows.groupBy(*keys, "theme").agg(F.sum("hits").alias("mentions"))
    top = top_per_group(counts, keys, [F.desc("mentions"), F.asc("theme")], k)
    quotes = _first_quotes(
        rows.join(top.select(*keys, "theme"), [*keys, "theme"], "left_semi"),
        [*keys, "theme"], 1,
    )
    return top.join(quotes, [*keys, "theme"], "left").select(
        *keys,
        "rank",
        "theme",
        "mentions",
        cleaning.snippet(F.try_element_at("p", F.lit(1)), 150).alias("positive_quote"),
        cleaning.snippet(F.try_element_at("n", F.lit(1)), 150).alias("negative_quote"),
    )


def overall_summary(answers: DataFrame, *, k: int = 5) -> DataFrame:
    """Per survey: answers, questions, moods, most mentioned themes."""
    v = validated(answers)
    base = v.groupBy("survey_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_distinct("question_text").alias("questions"),
        F.count_if(F.col("sentiment_label") == "positive").alias("positive"),
        F.count_if(F.col("sentiment_label") == "negative").alias("negative"),
    )
    return base.join(_top_theme_names(answers, ["survey_id"], k), "survey_id", "left")


def _top_theme_names(answers: DataFrame, keys: list[str], k: int) -> DataFrame:
    counts = answer_themes(answers).groupBy(*keys, "theme").agg(F.sum("hits").alias("m"))
    return (
        top_per_group(counts, keys, [F.desc("m"), F.asc("theme")], k)
        .groupBy(*keys)
        .agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("rank", "theme"))), lambda x: x["theme"]
            ).alias("top_themes")
        )
    )


def insight_records(insights: DataFrame) -> DataFrame:
    """Insight rows (survey_id, type, title, content, themes, impact) to stored form."""
    impact = F.col("impact")
    weight = F.when(impact.isNull() | (impact == 0), 0.5).otherwise(impact)
    return insights.select(
        "survey_id",
        F.when(F.col("type").isin("problem", "success"), "theme")
        .otherwise(F.col("type"))
        .alias("insight_type"),
        F.coalesce(F.nullif(F.col("title"), F.lit("")), "type").alias("title"),
        F.col("content").alias("description"),
        F.floor(weight * 10 + 0.5).cast("int").alias("priority"),
        F.to_json(
            F.struct(F.col("themes").alias("related_themes"), impact.alias("impact_score"))
        ).alias("supporting_data"),
    )


# ---------------------------------------------------------- stored results


def merge_theme_records(records: DataFrame, *, samples: int = 5) -> DataFrame:
    """Theme rows with the same name (case and blanks aside) made one.

    A theme row counts its mentions, at least one, towards the mean. The sample
    list holds the first ``samples`` different texts over all rows of the name,
    in the order of the rows and of their lists.
    """
    keys = ["survey_id", "theme_key"]
    n = F.coalesce("mention_count", F.lit(0))
    weight = F.when(n == 0, 1).otherwise(n)
    units = F.round(F.coalesce("sentiment_score", F.lit(0.0)) * _UNITS).cast("bigint")
    key = F.lower(cleaning.strip(F.col("theme_name")))
    numbered = records.withColumn("theme_key", key)
    texts = (
        numbered.select(*keys, "id", F.posexplode("sample_responses").alias("place", "text"))
        .groupBy(*keys, "text")
        .agg(F.min(F.struct("id", "place")).alias("at"))
    )
    first = (
        top_per_group(texts, keys, [F.asc("at")], samples)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("texts"))
    )
    merged = numbered.groupBy(*keys).agg(
        F.min("id").alias("id"),
        F.min_by("theme_name", "id").alias("theme_name"),
        F.sum(n).alias("mention_count"),
        F.sum(units * weight).alias("u"),
        F.sum(weight).alias("w"),
    )
    return merged.join(first, keys, "left").select(
        "survey_id",
        "id",
        "theme_name",
        "mention_count",
        rounded_ratio(F.col("u"), F.col("w") * _UNITS, 4).alias("sentiment_score"),
        F.coalesce(
            F.transform("texts", lambda x: x["text"]), F.array().cast("array<string>")
        ).alias("sample_responses"),
    )


def detail_answers(answers: DataFrame, *, k: int = 10) -> DataFrame:
    """First sample answers of each survey with defaults for missing analyses."""
    a = F.col("ai_analysis")
    mood = a["sentiment_score"]
    picked = top_per_group(answers, ["survey_id"], _in_order(), k)
    return picked.select(
        "survey_id",
        "row_number",
        "question_order",
        "response_text",
        F.when(mood.isNull() | (mood == 0), 0.5).otherwise(mood).alias("sentiment_score"),
        F.coalesce(F.nullif(a["sentiment"], F.lit("")), F.lit("neutral")).alias("sentiment_label"),
        F.coalesce(a["themes"], F.array().cast("array<string>")).alias("themes"),
        "question_text",
    )


def progress(analyses: DataFrame, answers: DataFrame) -> DataFrame:
    """Per survey: analysed answers, all answers, percentage."""
    counts = answers.groupBy("survey_id").agg(
        F.count("ai_analysis").alias("processed"), F.count(F.lit(1)).alias("total")
    )
    joined = analyses.select(F.col("id").alias("survey_id"), "name", "status").join(
        counts, "survey_id", "left"
    )
    done, total = F.coalesce("processed", F.lit(0)), F.coalesce("total", F.lit(0))
    return joined.select(
        "survey_id",
        "name",
        "status",
        done.alias("processed"),
        total.alias("total"),
        scores.percent(done, total, 0).cast("int").alias("percentage"),
    )


def survey_summary(
    analyses: DataFrame, answers: DataFrame, themes: DataFrame, insights: DataFrame
) -> DataFrame:
    """Survey headers with answer, theme and insight counts.

    Each child table is counted before the join, so counts do not multiply.
    """
    out = analyses.select(
        F.col("id").alias("survey_id"), "name", "total_responses", "status"
    )
    for name, child in (
        ("processed_responses", answers), ("theme_count", themes), ("insight_count", insights),
    ):
        counts = child.groupBy("survey_id").agg(F.count(F.lit(1)).alias(name))
        out = out.join(counts, "survey_id", "left")
    return out.na.fill(0, ["processed_responses", "theme_count", "insight_count"])


def sentiment_distribution(answers: DataFrame, *, by_question: bool = False) -> DataFrame:
    """Answers by mood per survey, or per question, with the positive share."""
    keys = ["survey_id", *(["question_text"] if by_question else [])]
    label = F.col("sentiment_label")
    t = validated(answers).groupBy(*keys).agg(
        *[F.count_if(label == x).alias(x) for x in ("positive", "negative", "neutral")]
    )
    known = F.col("positive") + F.col("negative") + F.col("neutral")
    return t.select(
        *keys,
        "positive",
        "negative",
        "neutral",
        scores.percent(F.col("positive"), known, 0).cast("int").alias("positive_pct"),
        scores.percent(F.col("negative"), known, 0).cast("int").alias("negative_pct"),
    )


def cross_question_themes(theme_rows: DataFrame, *, k: int = 5) -> DataFrame:
    """Most mentioned themes of each survey over all questions."""
    counts = theme_rows.groupBy("survey_id", "theme_name").agg(
        F.sum("mention_count").alias("mention_count")
    )
    return top_per_group(
        counts, ["survey_id"], [F.desc("mention_count"), F.asc("theme_name")], k
    )


def narratives(answers: DataFrame, *, words: int = 3) -> DataFrame:
    """Narrative class of each question with its leading themes and words."""
    keys = ["survey_id", "question_text"]
    moods = sentiment_distribution(answers, by_question=True)
    themes = _top_theme_names(answers, keys, 3)
    keyed = answers.withColumn("q", F.struct(*keys))
    top = (
        top_words_per_question(keyed, k=words, key="q")
        .groupBy("q")
        .agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]
            ).alias("top_words")
        )
        .select("q.*", "top_words")
    )
    has_theme = F.col("top_themes").isNotNull()
    pos, neg = F.col("positive_pct"), F.col("negative_pct")
    kind = (
        F.when(~has_theme, "diverse")
        .when(pos >= 70, "praise")
        .when(neg >= 50, "critical")
        .when(pos > neg, "mixed")
        .otherwise("complex")
    )
    return (
        moods.join(themes, keys, "left")
        .join(top, keys, "left")
        .select(
            *keys, "positive_pct", "negative_pct", kind.alias("narrative"), "top_themes", "top_words"
        )
    )


# ---------------------------------------------------------------- status


def latest_surveys(analyses: DataFrame, k: int = 5) -> DataFrame:
    return (
        analyses.orderBy(F.desc("created_at"), "id")
        .limit(k)
        .select("id", "name", "status", "total_responses", "created_at", "updated_at")
    )


def _idle_minutes(as_of: str | dt.datetime) -> Column:
    moment = F.lit(str(as_of)).cast("timestamp")
    return (F.unix_micros(moment) - F.unix_micros("updated_at")) / 60_000_000


def processing_surveys(analyses: DataFrame, as_of: str | dt.datetime) -> DataFrame:
    """Surveys in processing with the minutes since their last update."""
    return (
        analyses.filter(F.col("status") == "processing")
        .select(
            "id", "name", "total_responses",
            F.round(_idle_minutes(as_of), 4).alias("minutes_since_update"),
        )
        .orderBy("id")
    )


def reset_stuck(
    analyses: DataFrame, as_of: str | dt.datetime, minutes: int = 10
) -> DataFrame:
    """Survey headers with stuck ones marked failed, and a column that says so."""
    stuck = (F.col("status") == "processing") & (_idle_minutes(as_of) > minutes)
    moment = F.lit(str(as_of)).cast("timestamp")
    return analyses.withColumn("was_reset", F.coalesce(stuck, F.lit(False))).withColumns(
        {
            "status": F.when(F.col("was_reset"), "failed").otherwise(F.col("status")),
            "updated_at": F.when(F.col("was_reset"), moment).otherwise(F.col("updated_at")),
        }
    )
