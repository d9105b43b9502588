"""Ordered, limited and paged views of responses."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from ..functions import cleaning, scores
from .filters import Comments, Day, apply_filters, has_comment, has_theme, held_comment, text_search, trailing
from .nps import top_per_group


def recent(responses: DataFrame, k: int = 10) -> DataFrame:
    """Newest responses; equal times are ordered by id."""
    return (
        responses.orderBy(F.desc("created_at"), "id")
        .limit(k)
        .select(
            "id",
            "nps_score",
            "nps_explanation",
            "survey_name",
            cleaning.or_unknown(F.col("title_text")).alias("title_text"),
            "nps_category",
            "creation_date",
            "created_at",
        )
    )


def with_enrichment(
    responses: DataFrame, enrichment: DataFrame, *columns: str, how: str = "left"
) -> DataFrame:
    """Responses joined to chosen enrichment columns by response."""
    side = enrichment.select(F.col("response_id").alias("id"), *columns)
    return responses.join(side, "id", how)


def summary_rows(responses: DataFrame, enrichment: DataFrame) -> DataFrame:
    """Every response with its enrichment, where there is one."""
    return with_enrichment(
        responses, enrichment, "themes", "sentiment_score", "sentiment_label",
        "keywords", "summary", "processing_status",
    )


def last_days(
    responses: DataFrame,
    enrichment: DataFrame,
    as_of: str | dt.datetime,
    days: int = 30,
) -> DataFrame:
    """Responses of the last days with their enrichment, newest first."""
    rows = trailing(responses, "created_at", as_of, days)
    return with_enrichment(
        rows, enrichment, "themes", "sentiment_score", "sentiment_label",
        "keywords", "summary",
    ).orderBy(F.desc("created_at"), "id")


def page(
    responses: DataFrame,
    enrichment: DataFrame,
    *,
    search: str | None = None,
    bucket: str | None = None,
    theme: str | None = None,
    limit: int = 50,
    offset: int = 0,
    start: Day = None,
    end: Day = None,
    survey: str | None = None,
    title: str | None = None,
) -> DataFrame:
    """One page of the filtered response browser, newest first.

    Deep pages sort ``offset + limit`` rows; use ``after`` to walk a table.
    """
    rows = apply_filters(
        responses, start=start, end=end, survey=survey, title=title, bucket=bucket,
        date_col="created_at",
    )
    if search:
        rows = text_search(rows, search)
    side = enrichment
    if theme:
        side = has_theme(side, theme)
    columns = ("themes", "sentiment_score", "sentiment_label")
    # The cut comes last: adaptive execution may drop a sort that follows a join
    # of an already limited page, and the page would lose its order.
    joined = with_enrichment(rows, side, *columns, how="inner" if theme else "left")
    cut = joined.orderBy(F.desc("created_at"), "id").offset(offset).limit(limit)
    return cut.select(
        "id", "created_at", "title_text", "survey_name", "nps_score",
        "nps_explanation", *columns,
    )


def after(df: DataFrame, key: str, last: int | None, limit: int) -> DataFrame:
    """Keyset paging: the next rows after a key."""
    rows = df if last is None else df.filter(F.col(key) > last)
    return rows.orderBy(key).limit(max(limit, 1))


def unenriched_batch(
    responses: DataFrame, enrichment: DataFrame, limit: int, last: int | None = None,
    comments: Comments | None = None,
) -> DataFrame:
    """Next responses with text that have no enrichment, by id.

    With ``comments`` the responses hold references, and it fetches the texts of the batch.
    """
    held = held_comment(comments)
    open_rows = (
        responses.filter(F.col(held).isNotNull())
        .select("id", held)
        .join(enrichment.select(F.col("response_id").alias("id")), "id", "left_anti")
    )
    batch = after(open_rows, "id", last, limit)
    return comments(batch).orderBy("id") if comments else batch


def samples(responses: DataFrame, *, k: int = 10, **filters) -> DataFrame:
    """Newest commented responses for a filter set."""
    rows = apply_filters(responses, **filters).filter(has_comment(F.col("nps_explanation")))
    return (
        rows.orderBy(F.desc("creation_date"), "id")
        .limit(k)
        .select("id", "nps_score", "nps_explanation", "creation_date", "title_text")
    )


def theme_samples(rows: DataFrame, theme: str, *, k: int = 5, **filters) -> DataFrame:
    """Commented responses that mention a theme."""
    kept = apply_filters(rows.filter(F.col("theme") == theme), **filters)
    return (
        kept.filter(F.col("nps_explanation").isNotNull())
        .orderBy(F.desc("creation_date"), "response_id")
        .limit(k)
        .select("response_id", "nps_score", "nps_explanation", "title_text", "creation_date")
    )


def theme_extremes(rows: DataFrame, theme: str, *, k: int = 5, **filters) -> DataFrame:
    """First promoters and first detractors who commented on a theme."""
    score = F.col("nps_score")
    kept = apply_filters(rows.filter(F.col("theme") == theme), **filters)
    bucket = scores.category(score)
    tagged = kept.filter(
        has_comment(F.col("nps_explanation"))
        & (scores.is_promoter(score) | scores.is_detractor(score))
    ).select("response_id", "nps_score", "nps_explanation", "creation_date", bucket.alias("bucket"))
    return top_per_group(
        tagged, ["bucket"], [F.desc("creation_date"), F.asc("response_id")], k
    )
