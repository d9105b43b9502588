"""Satisfaction metrics by survey, title, demographic group and day."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import cleaning, scores
from ..functions.rounding import rounded_ratio
from .filters import apply_filters, at_least, day

SCORE = "nps_score"


def score_totals(df: DataFrame, *keys: Column | str) -> DataFrame:
    """One partial-aggregated pass: N, P, S, D and the sum of scores per group."""
    score = F.col(SCORE)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_responses"),
        *scores.bucket_counts(score),
        F.sum(score).alias("score_sum"),
        F.count(score).alias("scored"),
    )


def _net(digits: int = 2) -> Column:
    return scores.nps_or_zero(
        F.col("promoters"), F.col("detractors"), F.col("total_responses"), digits
    )


def _mean(digits: int) -> Column:
    return scores.mean(F.col("score_sum"), F.col("scored"), digits)


def summary(responses: DataFrame) -> DataFrame:
    """Totals, net score and mean score over all rows."""
    return score_totals(responses).select(
        "total_responses",
        _net().alias("nps_score"),
        "promoters",
        "passives",
        "detractors",
        _mean(1).alias("avg_score"),
    )


def survey_metrics(responses: DataFrame, survey: str | None = None) -> DataFrame:
    """Per survey: counts, mean, net score, first and last day."""
    score = F.col(SCORE)
    totals = (
        apply_filters(responses, survey=survey)
        .groupBy("survey_name")
        .agg(
            F.count(F.lit(1)).alias("total_responses"),
            *scores.bucket_counts(score),
            F.sum(score).alias("score_sum"),
            F.count(score).alias("scored"),
            F.min("creation_date").alias("first_response"),
            F.max("creation_date").alias("last_response"),
        )
    )
    return totals.select(
        "survey_name",
        "total_responses",
        "promoters",
        "passives",
        "detractors",
        _mean(2).alias("average_score"),
        _net().alias("nps_score"),
        "first_response",
        "last_response",
    )


def by_survey(responses: DataFrame) -> DataFrame:
    """Net score per survey, best first."""
    return (
        score_totals(responses, "survey_name")
        .select(
            "survey_name",
            _net().alias("nps_score"),
            "total_responses",
            "promoters",
            "passives",
            "detractors",
        )
        .orderBy(F.desc("nps_score"), "survey_name")
    )


def by_title(
    responses: DataFrame, *, min_responses: int = 10, include_unknown: bool = True
) -> DataFrame:
    """Net score per title with enough responses, best first."""
    if not include_unknown:
        responses = responses.filter(F.col("title_text").isNotNull())
    totals = score_totals(responses, "title_text")
    return (
        at_least(totals, min_responses, "total_responses")
        .select(
            cleaning.or_unknown(F.col("title_text")).alias("title_text"),
            _net().alias("nps_score"),
            "total_responses",
            "promoters",
            "passives",
            "detractors",
        )
        .orderBy(F.desc("nps_score"), "title_text")
    )


def demographics(responses: DataFrame) -> DataFrame:
    """Survey x gender x age x tenure; groups with missing values are kept."""
    keys = ["survey_name", "gender", "age_range", "years_employed"]
    return score_totals(responses, *keys).select(
        *keys,
        F.col("total_responses").alias("response_count"),
        _mean(2).alias("avg_score"),
        _net().alias("nps_score"),
    ).orderBy("survey_name", F.desc("response_count"))


def daily_trend(responses: DataFrame) -> DataFrame:
    """Per survey and day: counts, mean and net score."""
    return score_totals(responses, "survey_name", "creation_date").select(
        "survey_name",
        "creation_date",
        F.col("total_responses").alias("daily_responses"),
        F.col("promoters").alias("daily_promoters"),
        F.col("passives").alias("daily_passives"),
        F.col("detractors").alias("daily_detractors"),
        _mean(2).alias("daily_avg_score"),
        _net().alias("daily_nps_score"),
    ).orderBy("survey_name", "creation_date")


def kpis(responses: DataFrame, **filters) -> DataFrame:
    """KPI block for any filter set; zeros when nothing matches."""
    return score_totals(apply_filters(responses, **filters)).select(
        _net(1).alias("nps"),
        F.col("total_responses").alias("responses"),
        "promoters",
        "passives",
        "detractors",
        F.coalesce(_mean(2), F.lit(0.0)).alias("avg_score"),
    )


def period_change(responses: DataFrame, as_of: str | dt.date) -> DataFrame:
    """Change in percent, month to date against the whole month before.

    One pass over two months of rows. A change is 0 where the earlier value is
    0; the net score change divides by the absolute earlier score.
    """
    now = day(as_of)
    this_month = F.trunc(now, "month")
    previous_month = F.add_months(this_month, -1)
    created = F.col("creation_date")
    score = F.col(SCORE)
    rows = responses.filter((created >= previous_month) & (created <= now))
    current = created >= this_month

    def counts(part: Column, tag: str) -> list[Column]:
        return [
            F.count_if(part).alias(f"n_{tag}"),
            F.count_if(part & scores.is_promoter(score)).alias(f"p_{tag}"),
            F.count_if(part & scores.is_detractor(score)).alias(f"d_{tag}"),
        ]

    t = rows.agg(*counts(current, "cur"), *counts(~current, "prev"))

    def change(cur: str, prev: str) -> Column:
        return F.coalesce(
            rounded_ratio((F.col(cur) - F.col(prev)) * 100, F.col(prev), 4),
            F.lit(0.0),
        )

    wide = "decimal(20,0)"
    net_cur = (F.col("p_cur") - F.col("d_cur")).cast(wide)
    net_prev = (F.col("p_prev") - F.col("d_prev")).cast(wide)
    n_cur, n_prev = F.col("n_cur"), F.col("n_prev")
    # (a/n - b/m) / |b/m| = (a*m - b*n) / (|b|*n), all integers.
    nps_change = rounded_ratio(
        ((net_cur * n_prev - net_prev * n_cur) * 100).cast("decimal(27,0)"),
        (F.abs(net_prev) * n_cur).cast("decimal(27,0)"),
        4,
    )
    return t.select(
        F.coalesce(nps_change, F.lit(0.0)).alias("nps_change"),
        change("n_cur", "n_prev").alias("responses_change"),
        change("p_cur", "p_prev").alias("promoters_change"),
        change("d_cur", "d_prev").alias("detractors_change"),
    )


def title_leaderboard(
    responses: DataFrame,
    *,
    min_responses: int = 1,
    by: str = "responses",
    **filters,
) -> DataFrame:
    """Titles with counts, net and mean score; ordered by volume or net score."""
    rows = apply_filters(responses, **filters).filter(F.col("title_text").isNotNull())
    totals = at_least(
        score_totals(rows, "title_text"), min_responses, "total_responses"
    )
    board = totals.select(
        F.col("title_text").alias("title"),
        F.col("total_responses").alias("responses"),
        "promoters",
        "passives",
        "detractors",
        _net(1).alias("nps"),
        _mean(2).alias("avg_score"),
    )
    return board.orderBy(F.desc("nps" if by == "nps" else "responses"), "title")


def category_shares(responses: DataFrame, *keys: str) -> DataFrame:
    """Promoter, passive and detractor percentages, whole table or per key."""
    n = F.col("total_responses")
    return score_totals(responses, *keys).select(
        *keys,
        "total_responses",
        *[
            scores.percent(F.col(c), n).alias(f"pct_{c}")
            for c in ("promoters", "passives", "detractors")
        ],
    )


def filter_options(responses: DataFrame, column: str) -> DataFrame:
    """Distinct values for a filter list, sorted."""
    return (
        responses.filter(F.col(column).isNotNull())
        .select(F.col(column).alias("option"))
        .distinct()
        .orderBy("option")
    )


def top_per_group(
    df: DataFrame, keys: list[str], order: list[Column], k: int
) -> DataFrame:
    """First ``k`` rows of each group with their rank.

    The rank filter lets Spark cut each map task to ``k`` rows per group
    before the shuffle, so a group of any size reaches its reducer as a
    handful of rows.
    """
    ranked = df.withColumn(
        "rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    )
    return ranked.filter(F.col("rank") <= k)


def impact_findings(kpi: DataFrame, titles: DataFrame, words: DataFrame) -> DataFrame:
    """Rule rows for one theme: detractor share, most affected title, words, net score.

    ``kpi`` is the one-row result of the theme KPI operator, ``titles`` its
    title ranking, ``words`` its key words; each contributes one row at most.
    """
    worst = titles.orderBy(F.desc("total"), F.asc_nulls_last("title")).limit(1)
    top = words.orderBy(F.desc("count"), "word").limit(3)
    share = scores.percent(F.col("detractors"), F.col("total_responses"))
    from_kpi = kpi.select(
        F.inline(
            F.filter(
                F.array(
                    F.when(
                        F.col("detractors") * 100 > F.col("total_responses") * 50,
                        F.struct(
                            F.lit("impact").alias("type"),
                            F.concat(F.format_number(share, 1), F.lit("%")).alias("subject"),
                            F.col("detractors").alias("measure"),
                        ),
                    ),
                    F.when(
                        F.col("current_nps") < 0,
                        F.struct(
                            F.lit("nps").alias("type"),
                            F.format_number("current_nps", 1).alias("subject"),
                            F.col("detractors").alias("measure"),
                        ),
                    ),
                ),
                lambda r: r.isNotNull(),
            )
        )
    )
    scope = worst.select(
        F.lit("scope").alias("type"),
        F.col("title").alias("subject"),
        F.col("total").alias("measure"),
    )
    content = (
        top.agg(
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("o"), "word"))),
                    lambda s: s["word"],
                ),
                ", ",
            ).alias("subject"),
            F.sum("count").alias("measure"),
        )
        .filter(F.col("measure").isNotNull())
        .select(F.lit("content").alias("type"), "subject", "measure")
    )
    return from_kpi.unionByName(scope).unionByName(content)
