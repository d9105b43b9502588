"""Coverage, profile and constraint reports; repair of enrichment tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import cleaning, scores
from ..functions.rounding import hundredths, rounded_ratio
from .filters import Day, apply_filters, date_range, has_comment
from .nps import top_per_group


# ---------------------------------------------------------------- coverage


def data_coverage(
    responses: DataFrame, enrichment: DataFrame, *, start: Day = None, end: Day = None
) -> DataFrame:
    """Total, share with a comment, share of those that carry theme and sentiment."""
    side = enrichment.select(
        (F.col("themes").isNotNull() & F.col("sentiment_score").isNotNull()).alias("ok")
    )
    enriched = side.agg(F.count_if("ok")).scalar()
    totals = date_range(responses, start, end, "creation_date").agg(
        F.count(F.lit(1)).alias("total"),
        F.count("nps_explanation").alias("commented"),
    )
    return totals.select(
        "total",
        scores.percent(F.col("commented"), F.col("total"), 0).alias("with_comments_pct"),
        scores.percent(enriched, F.col("commented"), 0).alias("enriched_pct"),
    )


def enrichment_coverage(responses: DataFrame, enrichment: DataFrame) -> DataFrame:
    """Totals, commented, enriched, share and the last enrichment time."""
    side = (
        enrichment.agg(F.count(F.lit(1)).alias("n"), F.max("created_at").alias("last"))
        .select(F.struct("n", "last"))
        .scalar()
    )
    totals = responses.agg(
        F.count(F.lit(1)).alias("total_responses"),
        F.count_if(has_comment(F.col("nps_explanation"))).alias("responses_with_comments"),
    )
    enriched = side["n"]
    return totals.select(
        "total_responses",
        "responses_with_comments",
        enriched.alias("enriched_responses"),
        scores.percent(enriched, F.col("responses_with_comments"), 0).alias(
            "enrichment_percentage"
        ),
        side["last"].alias("last_run"),
    )


def title_coverage(
    responses: DataFrame, enrichment: DataFrame, **filters
) -> DataFrame:
    """Per title: responses, commented, enriched and the two shares."""
    rows = apply_filters(responses, **filters).select(
        "id", "title_text", has_comment(F.col("nps_explanation")).alias("commented")
    )
    ids = enrichment.select(F.col("response_id").alias("id"), F.lit(True).alias("hit"))
    # One enrichment row per response, so a joined row is an enriched response.
    t = (
        rows.join(ids, "id", "left")
        .groupBy(F.col("title_text").alias("title"))
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if("commented").alias("with_comments"),
            F.count("hit").alias("enriched"),
        )
    )
    return t.select(
        "title",
        "total",
        "with_comments",
        "enriched",
        scores.percent(F.col("with_comments"), F.col("total")).alias("pct_with_comments"),
        scores.percent(F.col("enriched"), F.col("with_comments")).alias("pct_enriched"),
    )


def enrichment_stats(responses: DataFrame, enrichment: DataFrame) -> DataFrame:
    """Total, enriched, pending, distinct themes, mean sentiment, last run."""
    side = enrichment.agg(
        F.count(F.lit(1)).alias("enriched_responses"),
        F.sum(hundredths(F.col("sentiment_score"))).alias("mood_sum"),
        F.count("sentiment_score").alias("mood_count"),
        F.max("created_at").alias("last_enrichment"),
    )
    base = (
        responses.agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(has_comment(F.col("nps_explanation"))).alias("commented"),
        )
        .select(F.struct("n", "commented"))
        .scalar()
    )
    names = enrichment.select(F.explode("themes").alias("t")).distinct().agg(
        F.count("t")
    )
    n, commented = base["n"], base["commented"]
    return side.select(
        n.alias("total_responses"),
        "enriched_responses",
        F.greatest(F.lit(0), commented - F.col("enriched_responses")).alias(
            "pending_responses"
        ),
        names.scalar().alias("themes_found"),
        F.coalesce(
            rounded_ratio(F.col("mood_sum"), F.col("mood_count") * 100, 3), F.lit(0.0)
        ).alias("avg_sentiment"),
        "last_enrichment",
    )


def period_counts(responses: DataFrame, unit: str = "year") -> DataFrame:
    """Rows per year or month of the creation date."""
    created = F.col("creation_date")
    label = F.year(created).cast("string") if unit == "year" else cleaning.month_text(created)
    return (
        responses.groupBy(label.alias("period"))
        .agg(F.count(F.lit(1)).alias("responses"))
        .orderBy("period")
    )


def newest_dates(responses: DataFrame, k: int = 10) -> DataFrame:
    """Newest rows with date, title and survey."""
    return (
        responses.orderBy(F.desc("creation_date"), "id")
        .limit(k)
        .select("id", "creation_date", "title_text", "survey_name")
    )


def date_span(responses: DataFrame) -> DataFrame:
    created = F.col("creation_date")
    return responses.agg(
        F.min(created).alias("earliest"),
        F.max(created).alias("latest"),
        F.count(created).alias("dated"),
    )


def column_date_coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """Min, max and non-null count per date column, one row each, one pass."""
    stats = df.agg(
        *[
            f(c).alias(f"{c}__{n}")
            for c in columns
            for n, f in (("min", F.min), ("max", F.max), ("n", F.count))
        ]
    )
    return stats.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("column_name"),
                        F.col(f"{c}__min").cast("date").alias("earliest"),
                        F.col(f"{c}__max").cast("date").alias("latest"),
                        F.col(f"{c}__n").alias("non_null"),
                    )
                    for c in columns
                ]
            )
        )
    )


def field_profile(df: DataFrame) -> DataFrame:
    """Per column: type, non-null rows, rows that look like ISO timestamps."""
    fields = [f for f in df.schema.fields]

    def looks(f) -> Column:
        if not isinstance(f.dataType, T.StringType):
            return F.lit(0).cast("bigint")
        c = F.col(f.name)
        return F.count_if(c.contains("-") & c.contains("T"))

    stats = df.agg(
        *[F.count(f.name).alias(f"n_{i}") for i, f in enumerate(fields)],
        *[looks(f).alias(f"d_{i}") for i, f in enumerate(fields)],
    )
    return stats.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(f.name).alias("column_name"),
                        F.lit(f.dataType.simpleString()).alias("data_type"),
                        F.col(f"n_{i}").alias("non_null"),
                        F.col(f"d_{i}").alias("date_like"),
                    )
                    for i, f in enumerate(fields)
                ]
            )
        )
    )


def title_counts(responses: DataFrame, k: int = 10) -> DataFrame:
    return (
        responses.groupBy("title_text")
        .agg(F.count(F.lit(1)).alias("responses"))
        .orderBy(F.desc("responses"), F.asc_nulls_last("title_text"))
        .limit(k)
    )


def title_theme_check(
    responses: DataFrame, assignments: DataFrame, *, min_mentions: int = 3
) -> DataFrame:
    """Per title: responses, theme mentions, their difference and the tail share.

    Tail themes are those with few mentions over the whole table.
    """
    theme_sizes = assignments.groupBy("theme").agg(F.sum("hits").alias("m"))
    tail = theme_sizes.filter(F.col("m") < min_mentions).select("theme", F.lit(True).alias("tail"))
    per_theme = assignments.groupBy("title_text", "theme").agg(F.sum("hits").alias("m"))
    mentions = (
        per_theme.join(tail, "theme", "left")
        .groupBy("title_text")
        .agg(
            F.sum("m").alias("mentions"),
            F.coalesce(F.sum(F.when(F.col("tail"), F.col("m"))), F.lit(0)).alias("tail_mentions"),
        )
    )
    counts = responses.groupBy("title_text").agg(F.count(F.lit(1)).alias("responses"))
    joined = counts.join(
        mentions.withColumnRenamed("title_text", "t"),
        F.col("title_text").eqNullSafe(F.col("t")),
        "left",
    )
    m = F.coalesce("mentions", F.lit(0))
    return joined.select(
        F.col("title_text").alias("title"),
        "responses",
        m.alias("mentions"),
        (m - F.col("responses")).alias("difference"),
        scores.percent(F.coalesce("tail_mentions", F.lit(0)), F.col("responses")).alias("tail_pct"),
    )


# ------------------------------------------------------------- constraints


def check_report(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Violations per rule: one pass, one output row per rule."""
    names = list(rules)
    counts = df.agg(
        *[F.count_if(rules[n]).alias(f"v_{i}") for i, n in enumerate(names)],
        F.count(F.lit(1)).alias("n"),
    )
    return counts.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(n).alias("rule"),
                        F.col(f"v_{i}").alias("violations"),
                        F.col("n").alias("checked"),
                    )
                    for i, n in enumerate(names)
                ]
            )
        )
    )


def response_rules() -> dict[str, Column]:
    score, kind = F.col("nps_score"), F.col("nps_category")
    return {
        "score_missing": score.isNull(),
        "score_range": ~score.between(0, 10),
        "category_values": ~kind.isin("promoter", "passive", "detractor"),
        "category_matches_score": ~kind.eqNullSafe(scores.category(score)),
        "survey_missing": F.col("survey_name").isNull(),
        "date_missing": F.col("creation_date").isNull(),
    }


def enrichment_rules() -> dict[str, Column]:
    return {
        "response_missing": F.col("response_id").isNull(),
        "status_values": ~F.col("processing_status").isin(
            "pending", "processing", "completed", "failed"
        ),
        "sentiment_range": ~F.col("sentiment_score").between(-1, 1),
        "label_values": ~F.col("sentiment_label").isin("positive", "negative", "neutral"),
        "confidence_range": ~F.col("confidence").between(0, 1),
    }


def hierarchy_rules() -> dict[str, Column]:
    return {
        "theme_missing": F.col("original_theme").isNull(),
        "confidence_range": ~F.col("confidence").between(0, 1),
        "source_values": ~F.col("source").isin("pattern", "ai", "fallback"),
    }


def survey_rules() -> dict[str, Column]:
    return {"status_values": ~F.col("status").isin("processing", "completed", "failed")}


def insight_rules() -> dict[str, Column]:
    return {
        "type_values": ~F.col("insight_type").isin(
            "theme", "sentiment", "recommendation", "summary"
        )
    }


def duplicate_keys(df: DataFrame, keys: list[str], rule: str = "unique_key") -> DataFrame:
    """Keys that occur more than once and the surplus rows."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    return sizes.agg(
        F.count(F.lit(1)).alias("duplicate_keys"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus_rows"),
    ).select(F.lit(rule).alias("rule"), "duplicate_keys", "surplus_rows")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows without a parent; rows without a key count as orphans."""
    ids = parent.select(F.col(parent_key).alias(child_key))
    return child.join(ids, child_key, "left_anti")


# ------------------------------------------------------------------ repair


def with_parent(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose parent exists."""
    ids = parent.select(F.col(parent_key).alias(child_key))
    return child.join(ids, child_key, "left_semi")


def newest_per_key(df: DataFrame, key: str, stamp: str, tie: str) -> DataFrame:
    """Newest row per key; equal times are decided by a unique column.

    Each map task keeps one row per key before the shuffle, so a key with any
    number of copies stays cheap.
    """
    return top_per_group(
        df, [key], [F.desc_nulls_first(stamp), F.desc_nulls_first(tie)], 1
    ).drop("rank")


def repair_enrichment(enrichment: DataFrame, responses: DataFrame, tie: str) -> DataFrame:
    """Orphans removed, then the newest row per response kept."""
    kept = with_parent(enrichment, responses, "response_id", "id")
    return newest_per_key(kept, "response_id", "created_at", tie)


def one_per_key(rows: DataFrame, key: str, newest: Sequence[str] = ()) -> DataFrame:
    """One row per key, the same one on every run."""
    rest = [
        F.to_json(c) if isinstance(f.dataType, (T.MapType, T.VariantType)) else F.col(c)
        for c, f in ((f.name, f) for f in rows.schema)
        if c != key and c not in newest
    ]
    order = [F.desc_nulls_last(c) for c in newest] + [c.desc_nulls_last() for c in rest]
    return top_per_group(rows, [key], order or [F.lit(1).asc()], 1).drop("rank")


def upsert(
    current: DataFrame,
    incoming: DataFrame,
    key: str,
    parents: DataFrame | None = None,
    parent_key: str = "id",
    newest: Sequence[str] = (),
) -> DataFrame:
    """New table contents: incoming rows with a parent replace those with the same key.

    Of incoming rows that share a key one stays: the largest by the columns
    ``newest``, then by all its columns that can be compared.
    """
    if parents is not None:
        incoming = with_parent(incoming, parents, key, parent_key)
    incoming = one_per_key(incoming, key, newest)
    untouched = current.join(incoming.select(key), key, "left_anti")
    return untouched.unionByName(incoming)


