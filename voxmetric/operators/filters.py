"""Row filters. An argument left at ``None`` adds no predicate at all."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import cleaning, scores

Day = str | dt.date | None

#: Puts ``nps_explanation`` in place of the reference, for rows that are few or end here.
Comments = Callable[[DataFrame], DataFrame]
#: Stands for a comment that is not read yet; null where there is none.
REFERENCE = "comment_ref"

_BUCKETS = {
    scores.PROMOTER: scores.is_promoter,
    scores.PASSIVE: scores.is_passive,
    scores.DETRACTOR: scores.is_detractor,
}


def day(value: str | dt.date) -> Column:
    return F.lit(str(value)).cast("date")


def date_range(df: DataFrame, start: Day, end: Day, column: str) -> DataFrame:
    """Inclusive range; on a timestamp the whole end day counts."""
    stamp = isinstance(
        df.schema[column].dataType, (T.TimestampType, T.TimestampNTZType)
    )
    if start is not None:
        df = df.filter(F.col(column) >= day(start))
    if end is not None:
        if stamp:
            df = df.filter(F.col(column) < F.date_add(day(end), 1))
        else:
            df = df.filter(F.col(column) <= day(end))
    return df


def apply_filters(
    df: DataFrame,
    *,
    start: Day = None,
    end: Day = None,
    survey: str | None = None,
    title: str | None = None,
    bucket: str | None = None,
    date_col: str = "creation_date",
) -> DataFrame:
    """Optional-filter bundle over response columns."""
    df = date_range(df, start, end, date_col)
    if survey is not None:
        df = df.filter(F.col("survey_name") == survey)
    if title is not None:
        df = df.filter(F.col("title_text") == title)
    if bucket is not None:
        df = by_bucket(df, bucket)
    return df


def by_bucket(df: DataFrame, bucket: str) -> DataFrame:
    return df.filter(_BUCKETS[bucket](F.col("nps_score")))


def month_range(
    df: DataFrame, start: Day, end: Day, column: str = "creation_date"
) -> DataFrame:
    """Whole months touched by the range, as bounds on the day column itself.

    Bounding the stored column instead of the truncated one keeps the
    predicate usable for file and row-group pruning.
    """
    if start is not None:
        df = df.filter(F.col(column) >= F.trunc(day(start), "month"))
    if end is not None:
        df = df.filter(F.col(column) <= F.last_day(day(end)))
    return df


def trailing(
    df: DataFrame, column: str, as_of: str | dt.datetime, days: int
) -> DataFrame:
    """Rows of the last ``days`` days before an explicit moment."""
    moment = F.lit(str(as_of)).cast("timestamp")
    return df.filter(F.col(column) >= moment - F.make_dt_interval(F.lit(days)))


def text_search(df: DataFrame, needle: str, column: str = "nps_explanation") -> DataFrame:
    """Case-insensitive substring search for literal text."""
    return df.filter(F.lower(F.col(column)).contains(needle.lower()))


def has_theme(df: DataFrame, theme: str, column: str = "themes") -> DataFrame:
    return df.filter(F.array_contains(F.col(column), theme))


def is_verbatim(col: Column) -> Column:
    """A real comment: longer than two characters and not a 'not applicable' mark."""
    low = F.lower(col)
    return (
        col.isNotNull()
        & (F.length(cleaning.strip(col)) > 2)
        & ~low.contains("n.v.t.")
        & ~low.contains("nvt")
    )


def has_comment(col: Column) -> Column:
    return col.isNotNull() & (col != "")


def held_comment(comments: Comments | None) -> str:
    """The column that rows hold: the comment, or its reference."""
    return REFERENCE if comments else "nps_explanation"


def written(comments: Comments | None) -> Column:
    """``has_comment`` of rows that may hold references."""
    return F.col(REFERENCE).isNotNull() if comments else has_comment(F.col("nps_explanation"))


def is_long_text(col: Column, minimum: int = 10) -> Column:
    """More than ``minimum`` characters after trimming."""
    return F.coalesce(F.length(cleaning.strip(col)) > minimum, F.lit(False))


def at_least(df: DataFrame, minimum: int, column: str) -> DataFrame:
    """Quality gate on group size."""
    return df.filter(F.col(column) >= minimum)
