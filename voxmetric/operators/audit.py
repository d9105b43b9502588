"""Rule-based survey health audit.

``audit_inputs`` condenses the responses to one row; ``run_audit`` turns that
row into one row per rule. A rule whose input is missing yields ``skip``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scores
from ..functions.rounding import rounded_ratio
from .filters import is_verbatim, trailing
from .trends import weekly_stability

# Rule thresholds (pass, warn).
RESPONSE_RATE = (20, 10)
VERBATIM_SHARE = (55, 35)
FATIGUED_USERS = (0, 5)
IN_APP_SHARE = (50, 30)
STABILITY_LIMIT = 8.0
STABILITY_ROWS = 100
COMPLETION_SECONDS = (25, 45)
LOW_SEGMENTS = (0, 2)
VOLUME = (1000, 500)
NET_SCORE = (0, -10)
LOW_SEGMENT_PCT = 10


def audit_inputs(
    responses: DataFrame,
    as_of: str | dt.datetime,
    *,
    date_col: str = "creation_date",
    channel_col: str = "survey_name",
    user_col: str | None = None,
    invites: int | None = None,
    segment_col: str | None = None,
    completion_col: str | None = None,
    have_events: bool = False,
    have_devices: bool = False,
    have_locales: bool = False,
) -> DataFrame:
    """One row of audit inputs over the last 90 days, 30 days and 12 weeks."""
    quarter = trailing(responses, date_col, as_of, 90)
    month = trailing(responses, date_col, as_of, 30)
    score = F.col("nps_score")
    base = quarter.agg(
        F.count(F.lit(1)).alias("total_responses"),
        F.count_if(is_verbatim(F.col("nps_explanation"))).alias("verbatim"),
        F.count_if(F.col(channel_col) == "in_app").alias("in_app"),
        F.count_if(F.col(channel_col) == "email").alias("email"),
        *scores.bucket_counts(score),
        (
            F.avg(completion_col) if completion_col else F.lit(None).cast("double")
        ).alias("completion_time"),
    )
    # One struct per scalar subquery: its fields share a single execution.
    stability = (
        weekly_stability(responses, as_of=as_of, date_col=date_col)
        .select(F.struct("wow_stddev", "total_n"))
        .scalar()
    )
    fatigued: Column = F.lit(None).cast("bigint")
    if user_col:
        fatigued = (
            month.filter(F.col(user_col).isNotNull())
            .groupBy(user_col)
            .agg(F.count(F.lit(1)).alias("n"))
            .agg(F.count_if(F.col("n") >= 2))
            .scalar()
        )
    low_segments: Column = F.lit(None).cast("bigint")
    if segment_col:
        sizes = quarter.groupBy(segment_col).agg(F.count(F.lit(1)).alias("n"))
        total = quarter.agg(F.count(F.lit(1))).scalar()
        low_segments = sizes.agg(
            F.count_if(F.col("n") * 100 < total * LOW_SEGMENT_PCT)
        ).scalar()
    return base.select(
        "*",
        month.agg(F.count(F.lit(1))).scalar().alias("responses_30d"),
        F.lit(invites).cast("bigint").alias("invites"),
        fatigued.alias("fatigued_users"),
        stability["wow_stddev"].alias("wow_stddev"),
        stability["total_n"].alias("stability_n"),
        low_segments.alias("low_segments"),
        F.lit(have_events).alias("have_events"),
        (F.lit(have_devices) & F.lit(have_locales)).alias("have_device_locale"),
    )


def _share_status(part: Column, whole: Column, limits: tuple[int, int]) -> Column:
    """Status of ``part / whole`` against percent limits, by integer comparison."""
    good, fair = limits
    return (
        F.when(part * 100 >= whole * good, "pass")
        .when(part * 100 >= whole * fair, "warn")
        .otherwise("fail")
    )


def _low_status(value: Column, limits: tuple[int, int]) -> Column:
    good, fair = limits
    return F.when(value <= good, "pass").when(value <= fair, "warn").otherwise("fail")


def _high_status(value: Column, limits: tuple[int, int]) -> Column:
    good, fair = limits
    return F.when(value >= good, "pass").when(value >= fair, "warn").otherwise("fail")


def _pct(part: Column, whole: Column, digits: int) -> Column:
    share = scores.percent(part, whole, digits)
    return F.format_string(f"%.{digits}f%%", share)


def _rule(
    key: str, title: str, category: str, status: Column, metric: Column, present: Column
) -> Column:
    state = F.when(present, status).otherwise("skip")
    return F.struct(
        F.lit(key).alias("key"),
        F.lit(title).alias("title"),
        state.alias("status"),
        F.lit(category).alias("category"),
        F.when(state == "fail", "critical")
        .when(state == "warn", "warning")
        .otherwise("info")
        .alias("severity"),
        F.when(present, metric).alias("metric"),
    )


def run_audit(inputs: DataFrame) -> DataFrame:
    """Audit rows (key, title, status, category, severity, metric)."""
    c = F.col
    total, always = c("total_responses"), F.lit(True)
    none = F.lit(None).cast("string")
    net = scores.nps_or_zero(c("promoters"), c("detractors"), total, 1)
    channels = F.greatest(total, F.lit(1))
    limit = F.lit(STABILITY_LIMIT)
    rules = [
        _rule(
            "response_rate", "Response Rate (30 days)", "data_quality",
            _share_status(c("responses_30d"), c("invites"), RESPONSE_RATE),
            _pct(c("responses_30d"), c("invites"), 1),
            F.coalesce(c("invites") > 0, F.lit(False)),
        ),
        _rule(
            "verbatim_share", "Verbatim Comment Rate (90 days)", "data_quality",
            F.when(total > 0, _share_status(c("verbatim"), total, VERBATIM_SHARE)).otherwise("fail"),
            _pct(c("verbatim"), total, 1), always,
        ),
        _rule(
            "fatigue", "Survey Fatigue (30 days)", "strategy",
            _low_status(c("fatigued_users"), FATIGUED_USERS),
            F.concat(c("fatigued_users").cast("string"), F.lit(" users ≥2 surveys")),
            c("fatigued_users").isNotNull(),
        ),
        _rule(
            "channel_mix", "Channel Mix", "strategy",
            _share_status(c("in_app"), channels, IN_APP_SHARE),
            F.concat(
                F.lit("In-app "), _pct(c("in_app"), channels, 0),
                F.lit(", Email "), _pct(c("email"), channels, 0),
            ),
            always,
        ),
        _rule(
            "stability", "NPS Stability (Week-over-Week)", "signal",
            F.when(c("wow_stddev") <= limit, "pass")
            .when(c("stability_n") < STABILITY_ROWS, "warn")
            .otherwise("fail"),
            F.format_string("σ=%.1f (n=%d)", c("wow_stddev"), c("stability_n")),
            c("wow_stddev").isNotNull(),
        ),
        _rule(
            "completion_time", "Survey Completion Time", "data_quality",
            _low_status(c("completion_time"), COMPLETION_SECONDS),
            F.format_string("%.1fs average", c("completion_time")),
            F.coalesce(c("completion_time") != 0, F.lit(False)),
        ),
        _rule(
            "segment_coverage", "Segment Coverage", "strategy",
            _low_status(c("low_segments"), LOW_SEGMENTS),
            F.concat(c("low_segments").cast("string"), F.lit(" segments <10% coverage")),
            c("low_segments").isNotNull(),
        ),
        _rule(
            "touchpoints", "Touchpoint Coverage", "technical",
            F.when(c("have_events"), "pass").otherwise("warn"), none, always,
        ),
        _rule(
            "device_locale", "Device/Locale Coverage", "technical",
            F.when(c("have_device_locale"), "pass").otherwise("warn"), none, always,
        ),
        F.when(
            total > 0,
            _rule(
                "data_volume", "Data Volume", "data_quality",
                _high_status(total, VOLUME),
                F.concat(F.format_number(total, 0), F.lit(" responses")), always,
            ),
        ),
        _rule(
            "nps_distribution", "NPS Score Distribution", "signal",
            _high_status(net, NET_SCORE),
            F.format_string("Average: %.1f", net), always,
        ),
    ]
    rows = F.filter(F.array(*rules), lambda r: r.isNotNull())
    return inputs.select(F.inline(rows))


def audit_score(rows: DataFrame, *, by_category: bool = False) -> DataFrame:
    """Share of passed rules, critical and warning counts."""
    status = F.col("status")
    keys = ["category"] if by_category else []
    t = rows.groupBy(*keys).agg(
        F.count_if(status != "skip").alias("rules"),
        F.count_if(status == "pass").alias("passed"),
        F.count_if((F.col("severity") == "critical") & (status != "pass")).alias("critical_issues"),
        F.count_if((F.col("severity") == "warning") & (status != "pass")).alias("warning_issues"),
    )
    return t.select(
        *keys,
        "rules",
        "passed",
        F.coalesce(rounded_ratio(F.col("passed") * 100, F.col("rules"), 0), F.lit(0.0)).alias("score"),
        "critical_issues",
        "warning_issues",
    )
