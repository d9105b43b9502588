"""Score classes and satisfaction metrics."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .rounding import rounded_ratio

PROMOTER, PASSIVE, DETRACTOR = "promoter", "passive", "detractor"


def category(score: Column) -> Column:
    """Bucket of a 0..10 score; NULL stays NULL."""
    return (
        F.when(score >= 9, PROMOTER)
        .when(score >= 7, PASSIVE)
        .when(score.isNotNull(), DETRACTOR)
    )


def is_promoter(score: Column) -> Column:
    return score >= 9


def is_passive(score: Column) -> Column:
    return score.between(7, 8)


def is_detractor(score: Column) -> Column:
    return score <= 6


def flags(score: Column) -> list[Column]:
    """Boolean columns promoter_flag, passive_flag, detractor_flag."""
    return [
        is_promoter(score).alias("promoter_flag"),
        is_passive(score).alias("passive_flag"),
        is_detractor(score).alias("detractor_flag"),
    ]


def bucket_counts(score: Column, weight: Column | None = None) -> list[Column]:
    """Aggregates promoters / passives / detractors, optionally weighted."""

    def total(cond: Column) -> Column:
        if weight is None:
            return F.count_if(cond)
        return F.coalesce(F.sum(F.when(cond, weight)), F.lit(0)).cast("bigint")

    return [
        total(is_promoter(score)).alias("promoters"),
        total(is_passive(score)).alias("passives"),
        total(is_detractor(score)).alias("detractors"),
    ]


def nps(
    promoters: Column, detractors: Column, total: Column, digits: int = 2
) -> Column:
    """Net score ``(P - D) / N * 100``; NULL for an empty group."""
    return rounded_ratio((promoters - detractors) * 100, total, digits)


def nps_or_zero(
    promoters: Column, detractors: Column, total: Column, digits: int = 2
) -> Column:
    """Net score with 0 for an empty group."""
    return F.coalesce(nps(promoters, detractors, total, digits), F.lit(0.0))


def mean(total: Column, count: Column, digits: int = 2) -> Column:
    """Mean of integer scores from their sum and count."""
    return rounded_ratio(total, count, digits)


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """``part / whole * 100``; 0 for an empty whole."""
    return F.coalesce(rounded_ratio(part * 100, whole, digits), F.lit(0.0))


def sentiment_label(score: Column) -> Column:
    """Above 0.1 positive, below -0.1 negative, else (and for NULL) neutral."""
    return (
        F.when(score > F.lit(0.1).cast("decimal(3,2)"), "positive")
        .when(score < F.lit(-0.1).cast("decimal(3,2)"), "negative")
        .otherwise("neutral")
    )


def sentiment_proxy(score_sum: Column, count: Column) -> Column:
    """Sentiment stand-in from the mean score: >=7 0.5, >=5 0, else -0.5."""
    return (
        F.when(score_sum >= 7 * count, 0.5)
        .when(score_sum >= 5 * count, 0.0)
        .otherwise(-0.5)
    )


def priority_level(net: Column, detractor_share_pct: Column) -> Column:
    """Urgency class from the net score and the detractor percentage."""
    return (
        F.when((net < -20) | (detractor_share_pct > 60), "critical")
        .when((net < 0) | (detractor_share_pct > 40), "high")
        .when((net < 20) | (detractor_share_pct > 25), "medium")
        .otherwise("low")
    )
