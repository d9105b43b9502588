"""Month trends, month-over-month movement and stability."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import cleaning, scores
from ..functions.rounding import rounded_ratio, scaled_ratio
from .filters import Day, apply_filters, at_least, month_range, trailing
from .nps import score_totals


def monthly(responses: DataFrame, date_col: str = "creation_date") -> DataFrame:
    """Month-bucketed responses; rows without a date drop out."""
    return responses.filter(F.col(date_col).isNotNull()).select(
        cleaning.month_start(F.col(date_col)).alias("month"),
        F.col("title_text").alias("title"),
        F.col("survey_name").alias("survey_type"),
        "nps_score",
    )


def _month_rows(responses, start, end, survey, title, date_col="creation_date"):
    rows = apply_filters(responses, survey=survey, title=title)
    return monthly(month_range(rows, start, end, date_col), date_col)


def _tenths() -> Column:
    """Net score in exact tenths of a point."""
    return scaled_ratio(
        (F.col("promoters") - F.col("detractors")) * 100, F.col("total_responses"), 1
    )


def trend_by_title(
    responses: DataFrame,
    *,
    start: Day = None,
    end: Day = None,
    survey: str | None = None,
    title: str | None = None,
) -> DataFrame:
    """Month x title: counts and net score."""
    rows = _month_rows(responses, start, end, survey, title)
    return score_totals(rows, "month", "title").select(
        "month",
        "title",
        F.col("total_responses").alias("responses"),
        "promoters",
        "passives",
        "detractors",
        (_tenths() / 10.0).alias("nps"),
    ).orderBy("month", F.asc_nulls_last("title"))


def _title_series(rows: DataFrame) -> DataFrame:
    """Month series per title with exact deltas against the previous present month."""
    series = score_totals(rows, "month", "title").select(
        "month",
        "title",
        F.col("total_responses").alias("responses"),
        _tenths().alias("tenths"),
    )
    order = Window.partitionBy("title").orderBy("month")
    return series.withColumns(
        {
            "previous_tenths": F.lag("tenths").over(order),
            "previous_responses": F.lag("responses").over(order),
        }
    ).withColumn("delta_tenths", F.col("tenths") - F.col("previous_tenths"))


def trend_by_title_with_change(
    responses: DataFrame,
    *,
    start: Day = None,
    end: Day = None,
    survey: str | None = None,
    title: str | None = None,
) -> DataFrame:
    """Month x title net score with the change since the previous present month."""
    return _title_series(_month_rows(responses, start, end, survey, title)).select(
        "month",
        "title",
        "responses",
        (F.col("tenths") / 10.0).alias("nps"),
        (F.col("delta_tenths") / 10.0).alias("mom_delta"),
    ).orderBy("month", F.asc_nulls_last("title"))


def _latest_rows(responses, start, end, survey, min_responses) -> DataFrame:
    rows = _month_rows(responses, start, end, survey, None)
    latest = rows.agg(F.max("month")).scalar()
    series = _title_series(rows).filter(F.col("month") == latest)
    return at_least(series, min_responses, "responses").filter(
        F.col("delta_tenths").isNotNull()
    )


def top_title_moves(
    responses: DataFrame,
    *,
    start: Day = None,
    end: Day = None,
    survey: str | None = None,
    min_responses: int = 30,
    top_k: int = 5,
) -> DataFrame:
    """Largest risers and fallers of the latest month in the window.

    With few movers the same title may appear as ``up`` and as ``down``.
    """
    moved = _latest_rows(responses, start, end, survey, min_responses).select(
        "month",
        "title",
        "responses",
        (F.col("tenths") / 10.0).alias("nps"),
        (F.col("delta_tenths") / 10.0).alias("mom_delta"),
    )
    ties = [F.desc("responses"), F.asc_nulls_last("title")]
    up = moved.orderBy(F.desc("mom_delta"), *ties).limit(top_k)
    down = moved.orderBy(F.asc("mom_delta"), *ties).limit(top_k)
    both = up.withColumn("move", F.lit("up")).unionByName(
        down.withColumn("move", F.lit("down"))
    )
    return both.orderBy("move", F.desc("mom_delta"), F.asc_nulls_last("title"))


def title_movers(
    responses: DataFrame,
    *,
    start: Day = None,
    end: Day = None,
    survey: str | None = None,
    min_responses: int = 30,
    top_k: int = 5,
) -> DataFrame:
    """Movers by absolute change with current and previous score and volume."""
    return (
        _latest_rows(responses, start, end, survey, min_responses)
        .orderBy(
            F.desc(F.abs("delta_tenths")), F.desc("responses"), F.asc_nulls_last("title")
        )
        .limit(top_k)
        .select(
            F.col("title").alias("title_text"),
            (F.col("tenths") / 10.0).alias("current_nps"),
            (F.col("previous_tenths") / 10.0).alias("previous_nps"),
            (F.col("delta_tenths") / 10.0).alias("delta"),
            F.col("responses").alias("current_responses"),
            "previous_responses",
        )
    )


def title_moves_between_latest_months(
    responses: DataFrame,
    *,
    start: Day = None,
    end: Day = None,
    min_responses: int = 30,
    top_k: int = 5,
) -> DataFrame:
    """Change between the two latest months that have qualifying titles.

    A title without the earlier month counts as 0 there.
    """
    rows = apply_filters(responses, start=start, end=end)
    totals = score_totals(
        rows,
        cleaning.or_unknown(F.col("title_text")).alias("title_text"),
        cleaning.month_start(F.col("creation_date")).alias("month"),
    )
    monthly_rows = at_least(totals, min_responses, "total_responses").select(
        "title_text",
        "month",
        scaled_ratio(
            (F.col("promoters") - F.col("detractors")) * 100, F.col("total_responses"), 2
        ).alias("net"),
        F.col("total_responses").alias("n"),
    )
    # Two rows at most: the latest months that hold a qualifying title.
    months = monthly_rows.select("month").distinct().orderBy(F.desc("month")).limit(2)
    bounds = months.agg(F.max("month").alias("cur"), F.min("month").alias("prev"))
    cur = bounds.select("cur").scalar()
    prev = bounds.select("prev").scalar()
    is_cur = F.col("month") == cur
    is_prev = (F.col("month") == prev) & (F.col("month") < cur)
    return (
        monthly_rows.filter(is_cur | is_prev)
        .groupBy("title_text")
        .agg(
            F.max(F.when(is_cur, F.col("net"))).alias("cur_net"),
            F.coalesce(F.max(F.when(is_prev, F.col("net"))), F.lit(0)).alias("prev_net"),
            F.max(F.when(is_cur, F.col("n"))).alias("current_responses"),
            F.coalesce(F.max(F.when(is_prev, F.col("n"))), F.lit(0)).alias(
                "previous_responses"
            ),
        )
        .filter(F.col("cur_net").isNotNull())
        .select(
            "title_text",
            (F.col("cur_net") / 100.0).alias("current_nps"),
            (F.col("prev_net") / 100.0).alias("previous_nps"),
            ((F.col("cur_net") - F.col("prev_net")) / 100.0).alias("mom_delta"),
            "current_responses",
            "previous_responses",
        )
        .orderBy(F.desc("mom_delta"), "title_text")
        .limit(top_k)
    )


def theme_share_change(
    assignments: DataFrame,
    title: str,
    survey: str | None = None,
    date_col: str = "creation_date",
) -> DataFrame:
    """Monthly theme shares of a title and their change per theme."""
    rows = apply_filters(assignments, survey=survey, title=title)
    counts = rows.groupBy(
        cleaning.month_start(F.col(date_col)).alias("month"), "theme"
    ).agg(F.count(F.lit(1)).alias("count_responses"))
    totals = counts.groupBy("month").agg(F.sum("count_responses").alias("month_total"))
    shares = counts.join(totals, "month").withColumn(
        "cents",
        scaled_ratio(F.col("count_responses") * 100, F.col("month_total"), 2),
    )
    before = F.lag("cents").over(Window.partitionBy("theme").orderBy("month"))
    return shares.select(
        "month",
        "theme",
        "count_responses",
        (F.col("cents") / 100.0).alias("share_pct"),
        ((F.col("cents") - before) / 100.0).alias("mom_share_delta"),
    ).orderBy("month", F.asc_nulls_last("theme"))


def monthly_trend(
    responses: DataFrame, *, digits: int = 2, by_survey: bool = False, **filters
) -> DataFrame:
    """Overall month trend for any filter set, optionally per survey."""
    order = ["month", *(["survey_name"] if by_survey else [])]
    return month_scores(responses, digits=digits, by_survey=by_survey, **filters).orderBy(*order)


def month_scores(
    responses: DataFrame, *, digits: int = 2, by_survey: bool = False, **filters
) -> DataFrame:
    """The rows of ``monthly_trend`` in no order, to calculate with."""
    rows = monthly(apply_filters(responses, **filters))
    keys = ["month", "survey_type"] if by_survey else ["month"]
    return (
        score_totals(rows, *keys)
        .select(
            F.date_format("month", "yyyy-MM").alias("month"),
            *[F.col("survey_type").alias("survey_name") for _ in range(by_survey)],
            scores.nps_or_zero(
                F.col("promoters"), F.col("detractors"), F.col("total_responses"), digits
            ).alias("nps_score"),
            "total_responses",
            "promoters",
            "passives",
            "detractors",
        )
    )


def survey_pivot(
    responses: DataFrame, surveys: list[str], **filters
) -> DataFrame:
    """Month rows, one net-score column per named survey.

    The caller names the surveys (see ``filter_options``), which spares the
    extra pass that an open pivot needs.
    """
    trend = month_scores(responses, digits=1, by_survey=True, **filters)
    return (
        trend.groupBy("month").pivot("survey_name", surveys).agg(F.max("nps_score"))
    )


def title_trend(responses: DataFrame, title: str, **filters) -> DataFrame:
    """Monthly mean score and counts of one title."""
    rows = monthly(apply_filters(responses, title=title, **filters))
    return (
        score_totals(rows, "month")
        .select(
            F.date_format("month", "yyyy-MM").alias("month"),
            scores.mean(F.col("score_sum"), F.col("scored"), 2).alias("avg_score"),
            F.col("total_responses").alias("responses"),
            "promoters",
            "passives",
            "detractors",
        )
        .orderBy("month")
    )


def trend_direction(responses: DataFrame, **filters) -> DataFrame:
    """First against last month and the mean of the monthly net scores."""
    rows = monthly(apply_filters(responses, **filters))
    months = score_totals(rows, "month").select("month", _tenths().alias("tenths"))
    return months.agg(
        F.min_by("tenths", "month").alias("first"),
        F.max_by("tenths", "month").alias("last"),
        F.sum("tenths").alias("total"),
        F.count(F.lit(1)).alias("months"),
    ).select(
        (F.col("first") / 10.0).alias("first_nps"),
        (F.col("last") / 10.0).alias("last_nps"),
        F.when(F.col("last") > F.col("first"), "up")
        .when(F.col("last") < F.col("first"), "down")
        .otherwise("flat")
        .alias("direction"),
        rounded_ratio(F.col("total"), F.col("months") * 10, 2).alias("mean_nps"),
        "months",
    )


def counts_by_month(responses: DataFrame, **filters) -> DataFrame:
    """True promoter and detractor counts per month over all titles."""
    trend = trend_by_title(
        responses, **{k: filters.get(k) for k in ("start", "end", "survey", "title")}
    )
    return trend.groupBy("month").agg(
        F.sum("responses").alias("responses"),
        F.sum("promoters").alias("promoters"),
        F.sum("detractors").alias("detractors"),
    )


def approximate_counts(trend: DataFrame) -> DataFrame:
    """Promoters and detractors estimated from net score and volume only.

    For stored trends that kept no counts: ``round(N * (nps +- 100) / 200)``.
    """
    n, net = F.col("responses"), (F.col("nps") * 10).cast("bigint")
    return trend.groupBy("month").agg(
        F.sum("responses").alias("responses"),
        F.sum(scaled_ratio(n * (net + 1000), F.lit(2000), 0)).alias("promoters"),
        F.sum(scaled_ratio(n * (1000 - net), F.lit(2000), 0)).alias("detractors"),
    )


def top_title_trends(responses: DataFrame, *, titles: int = 6, **filters) -> DataFrame:
    """Month series of the titles with most responses."""
    rows = apply_filters(responses, **filters).filter(F.col("title_text").isNotNull())
    top = (
        rows.groupBy(F.col("title_text").alias("title"))
        .agg(F.count(F.lit(1)).alias("title_total"))
        .orderBy(F.desc("title_total"), "title")
        .limit(titles)
    )
    series = score_totals(monthly(rows), "month", "title").select(
        "month", "title", F.col("total_responses").alias("responses"),
        (_tenths() / 10.0).alias("nps"),
    )
    # At most ``titles`` rows: the limit bounds what is broadcast.
    return series.join(F.broadcast(top), "title")


def month_coverage(responses: DataFrame) -> DataFrame:
    """Rows and distinct titles per month, the two newest months labelled."""
    rows = monthly(responses)
    latest = rows.agg(F.max("month")).scalar()
    months = rows.groupBy("month").agg(
        F.count(F.lit(1)).alias("responses"),
        F.count_distinct("title").alias("titles"),
    )
    return months.select(
        "month",
        "responses",
        "titles",
        F.when(F.col("month") == latest, "LATEST")
        .when(F.col("month") == F.add_months(latest, -1), "PREVIOUS")
        .alias("label"),
    )


def weekly_stability(
    responses: DataFrame,
    *,
    as_of: str | dt.datetime | None = None,
    weeks: int = 12,
    date_col: str = "creation_date",
) -> DataFrame:
    """Population deviation of weekly mean scores; NULL for a single week."""
    if as_of is not None:
        responses = trailing(responses, date_col, as_of, 7 * weeks)
    per_week = responses.groupBy(
        cleaning.week_start_sunday(F.col(date_col).cast("date")).alias("week")
    ).agg(
        F.sum(F.coalesce("nps_score", F.lit(0))).alias("s"),
        F.count(F.lit(1)).alias("n"),
    )
    return per_week.agg(
        F.stddev_pop(F.col("s") / F.col("n")).alias("sd"),
        F.count(F.lit(1)).alias("weeks"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_n"),
    ).select(
        F.when(F.col("weeks") > 1, F.round("sd", 6)).alias("wow_stddev"),
        "weeks",
        "total_n",
    )
