"""Theme assignments and theme metrics.

Themes arrive as an array per response. They are made canonical and
de-duplicated inside the row, so after the explode there is exactly one row
per (response, theme) with the number of raw mentions in ``hits``:
``count(*)`` is the number of distinct responses and ``sum(hits)`` the number
of mentions, both with map-side partial aggregation and no distinct shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import cleaning, scores
from ..functions.matching import first_label
from ..functions.rounding import hundredths, rounded_ratio, scaled_ratio
from ..sources import reference_data as ref
from .filters import REFERENCE, Comments, apply_filters, held_comment, written
from .lookup import lookup_join, total_of
from .nps import top_per_group

Synonyms = Mapping[str, tuple[str, ...]]
RESPONSE_COLUMNS = (
    "survey_name", "title_text", "nps_score", "creation_date", "created_at",
)


# ----------------------------------------------------------- assignments


def canonical_theme(col: Column, synonyms: Synonyms = ref.SYNONYM_GROUPS) -> Column:
    """Lower-case, trimmed theme replaced by its canonical name; one hop only."""
    key = cleaning.theme_key(col)
    branches = None
    for canonical, spellings in synonyms.items():
        words = [s.lower() for s in spellings]
        cond = key.isin(*words)
        branches = (
            F.when(cond, canonical) if branches is None else branches.when(cond, canonical)
        )
    return key if branches is None else branches.otherwise(key)


def theme_hits(named: Column) -> Column:
    """Array of (theme, hits, lead): distinct themes of a response, mention counts.

    ``lead`` marks one row per response, so responses with any theme can be
    counted later without a distinct. ``named`` should be a plain column: it
    is read once per distinct theme.
    """

    def hits(t: Column) -> Column:
        return F.size(F.filter(named, lambda x: x.eqNullSafe(t)))

    distinct = F.array_distinct(named)

    def entries(count: Callable[[Column], Column]) -> Column:
        return F.transform(
            distinct,
            lambda t, i: F.struct(t.alias("theme"), count(t).alias("hits"), (i == 0).alias("lead")),
        )

    # Only a list with repeats needs to be searched for each of its themes.
    return F.when(F.size(distinct) < F.size(named), entries(hits)).otherwise(entries(lambda t: F.lit(1)))


def assignments(
    responses: DataFrame,
    enrichment: DataFrame,
    *,
    synonyms: Synonyms | None = ref.SYNONYM_GROUPS,
    raw: bool = False,
    theme: str | None = None,
) -> DataFrame:
    """One row per (response, theme) with response and enrichment columns.

    ``raw`` keeps theme names as stored. ``theme`` keeps one theme only and is
    tested on the array before the join, so other responses are never moved.
    The join happens while themes are still packed in their array.
    """
    if raw:
        name = lambda t: t
    else:
        name = lambda t: canonical_theme(t, synonyms or {})
    rows = enrichment.filter(F.size("themes") > 0)
    if theme is not None:
        rows = rows.filter(F.exists("themes", lambda t: name(t) == theme))
    extra = [c for c in ("sentiment_score", "sentiment_label", "processing_status")
             if c in enrichment.columns]
    packed = rows.select(
        "response_id", *extra, F.transform("themes", name).alias("named")
    ).select("response_id", *extra, theme_hits(F.col("named")).alias("packed"))
    keep = [c for c in (*RESPONSE_COLUMNS, "nps_explanation", REFERENCE) if c in responses.columns]
    side = responses.select(F.col("id").alias("response_id"), *keep)
    # Both sides are facts and keep their shuffle. Named as a merge join, the join
    # is not planned anew at run time, so a grand total over the same rows
    # (``total_of``) finds the shuffled groups instead of building them again. The
    # rows of one theme may be few: there the engine chooses.
    joined = packed.join(side if theme is not None else side.hint("merge"), "response_id")
    out = joined.select("response_id", *keep, *extra, F.inline("packed"))
    return out if theme is None else out.filter(F.col("theme") == theme)


def assignments_with_dictionary(
    responses: DataFrame, enrichment: DataFrame, synonyms: DataFrame
) -> DataFrame:
    """``assignments`` with a synonym table of any size.

    ``synonyms`` has columns synonym and canonical; the key is folded to lower
    case and made unique first.
    """
    dictionary = synonyms.groupBy(F.lower("synonym").alias("theme_key")).agg(
        F.min("canonical").alias("canonical")
    )
    extra = [c for c in ("sentiment_score", "sentiment_label", "processing_status")
             if c in enrichment.columns]
    exploded = enrichment.select(
        "response_id", *extra, F.transform("themes", cleaning.theme_key).alias("named")
    ).select(
        "response_id",
        *extra,
        F.inline(theme_hits(F.col("named"))).alias("theme_key", "hits", "lead"),
    )
    named = lookup_join(exploded, dictionary, "theme_key").select(
        "response_id",
        *extra,
        F.coalesce("canonical", "theme_key").alias("theme"),
        "hits",
        "lead",
    )
    merged = named.groupBy("response_id", "theme").agg(
        F.sum("hits").alias("hits"),
        F.max("lead").alias("lead"),
        *[F.first(c).alias(c) for c in extra],
    )
    keep = [c for c in RESPONSE_COLUMNS if c in responses.columns]
    return merged.join(
        responses.select(F.col("id").alias("response_id"), *keep), "response_id"
    )


# --------------------------------------------------------------- metrics


def _mention_sum(value: Column) -> Column:
    return F.sum(value * F.col("hits"))


def theme_totals(rows: DataFrame, *keys: str) -> DataFrame:
    """Mentions, distinct responses and exact sums per theme; one shuffle."""
    score, mood = F.col("nps_score"), F.col("sentiment_score")
    hits = F.col("hits").cast("bigint")

    def weight(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, hits)), F.lit(0)).cast("bigint")

    mood_parts = (
        [
            weight(mood > 0).alias("positive"),
            weight(mood < 0).alias("negative"),
            _mention_sum(hundredths(mood)).alias("mood_sum"),
            weight(mood.isNotNull()).alias("mood_count"),
        ]
        if "sentiment_score" in rows.columns
        else []
    )
    return rows.groupBy(*(keys or ("theme",))).agg(
        F.sum(hits).alias("mentions"),
        F.count(F.lit(1)).alias("responses"),
        *scores.bucket_counts(score, hits),
        _mention_sum(score).alias("score_sum"),
        weight(score.isNotNull()).alias("scored"),
        *mood_parts,
    )


# Output column -> (numerator, denominator) of the overview metrics. Sentiment
# sums count hundredths, so its denominator is scaled alike.
_OVERVIEW = {
    "pct_promoters": ("promoters", "mentions", 1),
    "pct_passives": ("passives", "mentions", 1),
    "pct_detractors": ("detractors", "mentions", 1),
    "pct_pos_sentiment": ("positive", "mentions", 1),
    "pct_neg_sentiment": ("negative", "mentions", 1),
    "avg_sentiment": ("mood_sum", "mood_count", 100),
    "avg_nps": ("score_sum", "scored", 1),
}
_TAIL_DIGITS = 9


def overview(
    rows: DataFrame, *, min_mentions: int | None = 3, digits: int = 4
) -> DataFrame:
    """Theme metrics; themes below ``min_mentions`` collapse into one cluster.

    The cluster sums mentions and takes the unweighted mean of the other
    metrics. There is no cluster row without tail themes. ``None`` keeps all.
    """
    totals = theme_totals(rows)
    if min_mentions is None:
        return totals.select(
            "theme",
            "mentions",
            *[
                rounded_ratio(F.col(n), F.col(d) * m, digits).alias(out)
                for out, (n, d, m) in _OVERVIEW.items()
            ],
        ).orderBy(F.desc_nulls_last("mentions"), "theme")
    tail = F.col("mentions") < min_mentions
    # A head theme forms a group of its own: its sums pass through unchanged.
    # Tail themes add up their metric in fixed units of 10^-9.
    grouped = totals.groupBy(
        tail.alias("is_tail"),
        F.when(tail, ref.TAIL_CLUSTER).otherwise(F.col("theme")).alias("theme"),
    ).agg(
        F.sum("mentions").alias("mentions"),
        *[
            part
            for out, (n, d, m) in _OVERVIEW.items()
            for part in (
                F.sum(
                    F.when(tail, scaled_ratio(F.col(n), F.col(d) * m, _TAIL_DIGITS))
                ).alias(f"{out}_units"),
                F.count_if(tail & (F.col(d) > 0)).alias(f"{out}_n"),
                F.sum(F.when(~tail, F.col(n))).alias(f"{out}_num"),
                F.sum(F.when(~tail, F.col(d) * m)).alias(f"{out}_den"),
            )
        ],
    )
    return grouped.select(
        "theme",
        "mentions",
        *[
            F.when(
                F.col("is_tail"),
                rounded_ratio(
                    F.col(f"{out}_units"), F.col(f"{out}_n") * 10**_TAIL_DIGITS, digits
                ),
            )
            .otherwise(rounded_ratio(F.col(f"{out}_num"), F.col(f"{out}_den"), digits))
            .alias(out)
            for out in _OVERVIEW
        ],
    ).orderBy(F.desc_nulls_last("mentions"), "theme")


def tail_breakdown(rows: DataFrame, *, min_mentions: int = 3) -> DataFrame:
    """Themes that make up the cluster."""
    return (
        rows.groupBy("theme")
        .agg(F.sum("hits").alias("mentions"))
        .filter(F.col("mentions") < min_mentions)
        .orderBy(F.desc("mentions"), "theme")
    )


def overview_counts(rows: DataFrame) -> DataFrame:
    """Counts and one-decimal percentages per theme, no tail."""
    n = F.col("mentions")
    return theme_totals(rows).select(
        "theme",
        "mentions",
        scores.mean(F.col("score_sum"), F.col("scored"), 1).alias("avg_nps"),
        "promoters",
        "passives",
        "detractors",
        *[
            rounded_ratio(F.col(c) * 100, n, 1).alias(f"pct_{c}")
            for c in ("promoters", "passives", "detractors")
        ],
    ).orderBy(F.desc("mentions"), F.asc_nulls_last("theme"))


def aggregate(rows: DataFrame, *, date_col: str = "created_at", **filters) -> DataFrame:
    """Distinct responses, share of all theme counts, mean sentiment and score."""
    by_theme = theme_totals(apply_filters(rows, date_col=date_col, **filters)).select(
        "theme", "responses", "mood_sum", "mood_count", "score_sum", "scored"
    )
    total = total_of(by_theme, "responses")
    return by_theme.select(
        "theme",
        F.col("responses").alias("count_responses"),
        scores.percent(F.col("responses"), total).alias("share_pct"),
        rounded_ratio(F.col("mood_sum"), F.col("mood_count") * 100, 3).alias("avg_sentiment"),
        scores.mean(F.col("score_sum"), F.col("scored"), 1).alias("avg_nps"),
    ).orderBy(F.desc("count_responses"), F.asc_nulls_last("theme"))


def promoter_detractor(
    rows: DataFrame, *, date_col: str = "created_at", **filters
) -> DataFrame:
    """Distinct promoter and detractor responses per theme, most mentioned first."""
    score = F.col("nps_score")
    return (
        apply_filters(rows, date_col=date_col, **filters)
        .groupBy("theme")
        .agg(
            F.count_if(scores.is_promoter(score)).alias("promoters"),
            F.count_if(scores.is_detractor(score)).alias("detractors"),
        )
        .orderBy(F.desc(F.col("promoters") + F.col("detractors")), F.asc_nulls_last("theme"))
    )


def sentiment_by_survey(rows: DataFrame) -> DataFrame:
    """Theme sentiment per survey over completed enrichments."""
    label, hits = F.col("sentiment_label"), F.col("hits")
    done = rows.filter(F.col("processing_status") == "completed")

    def counted(value: str) -> Column:
        return (
            F.coalesce(F.sum(F.when(label == value, hits)), F.lit(0))
            .cast("bigint")
            .alias(f"{value}_count")
        )

    grouped = done.groupBy("survey_name", "theme").agg(
        F.sum(hits).alias("theme_count"),
        F.sum(hundredths(F.col("sentiment_score")) * hits).alias("mood_sum"),
        F.sum(F.when(F.col("sentiment_score").isNotNull(), hits)).alias("mood_count"),
        *[counted(v) for v in ("positive", "negative", "neutral")],
    )
    return grouped.select(
        "survey_name",
        "theme",
        "theme_count",
        rounded_ratio(F.col("mood_sum"), F.col("mood_count") * 100, 3).alias("avg_sentiment"),
        "positive_count",
        "negative_count",
        "neutral_count",
    ).orderBy("survey_name", F.desc("theme_count"), F.asc_nulls_last("theme"))


def top_themes(
    rows: DataFrame,
    *,
    k: int = 10,
    distinct_responses: bool = False,
    null_sentiment_as_zero: bool = True,
    **filters,
) -> DataFrame:
    """Largest themes with share, mean sentiment and mean score.

    Counts mentions, or distinct responses when asked; the means are per
    mention either way.
    """
    size = "responses" if distinct_responses else "mentions"
    moods = F.col("mentions") if null_sentiment_as_zero else F.col("mood_count")
    t = theme_totals(apply_filters(rows, **filters)).select(
        "theme", F.col(size).alias("size"), "mentions", moods.alias("moods"), "mood_sum",
        "score_sum", "promoters", "detractors",
    )
    count, moods, total = F.col("size"), F.col("moods"), total_of(t, "size")
    return (
        t.orderBy(F.desc(count), F.asc_nulls_last("theme"))
        .limit(k)
        .select(
            "theme",
            count.alias("count_responses"),
            scores.percent(count, total, 2).alias("share_pct"),
            F.coalesce(
                rounded_ratio(F.coalesce("mood_sum", F.lit(0)), moods * 100, 3), F.lit(0.0)
            ).alias("avg_sentiment"),
            rounded_ratio(F.col("score_sum"), F.col("mentions"), 2).alias("avg_nps"),
            "promoters",
            "detractors",
        )
    )


def relevance(count: Column, high: int, low: int | None = None) -> Column:
    """``high`` from a threshold, ``low`` below another, else medium."""
    if low is None:
        return F.when(count >= high, "high").otherwise("low")
    return F.when(count >= high, "high").when(count < low, "low").otherwise("medium")


def source_class(theme: Column, base: tuple[str, ...] = ref.BASE_THEMES) -> Column:
    return F.when(theme.isin(*base), "base").otherwise("ai")


def theme_list(
    rows: DataFrame,
    *,
    min_mentions: int = 3,
    global_metrics: bool = False,
    **filters,
) -> DataFrame:
    """Theme listing: filtered counts, share, relevance, source, metrics.

    Metrics come from the filtered rows, or with ``global_metrics`` from the
    overview of all rows, where themes of the tail cluster have no entry and
    drop out.
    """
    kept = apply_filters(rows, **filters)
    used = sorted({c for n, d, _ in _OVERVIEW.values() for c in (n, d)} - {"mentions"})
    counts = theme_totals(kept).select(
        "theme", "mentions", *([] if global_metrics else used)
    )
    total = total_of(counts, "mentions")
    theme, n = F.col("theme"), F.col("mentions")
    listing = counts.select(
        "theme",
        n.alias("count_responses"),
        scores.percent(n, total).alias("share_pct"),
        rounded_ratio(n, total, 6).alias("frequency"),
        source_class(theme).alias("source"),
        relevance(n, 100, 10).alias("business_relevance"),
        F.when(theme.isin(*ref.BASE_THEMES), 1.0).otherwise(0.8).alias("confidence"),
        *([] if global_metrics else _list_metrics()),
    )
    if not global_metrics:
        return listing
    whole = theme_totals(rows).filter(n >= min_mentions).select("theme", *_list_metrics())
    return listing.join(whole, "theme")


def _list_metrics() -> list[Column]:
    out = []
    for name, (num, den, mult) in _OVERVIEW.items():
        digits = {"avg_sentiment": 2, "avg_nps": 1}.get(name, 0)
        scale = 100 if digits == 0 else 1
        out.append(
            F.coalesce(
                rounded_ratio(F.col(num) * scale, F.col(den) * mult, digits), F.lit(0.0)
            ).alias(name)
        )
    return out


def theme_kpis(rows: DataFrame, theme: str, **filters) -> DataFrame:
    """KPI block over the mentions of one theme."""
    kept = apply_filters(rows.filter(F.col("theme") == theme), **filters)
    hits = F.col("hits").cast("bigint")
    totals = kept.agg(
        F.coalesce(F.sum(hits), F.lit(0)).alias("total_responses"),
        *scores.bucket_counts(F.col("nps_score"), hits),
        F.sum(F.col("nps_score") * hits).alias("score_sum"),
    )
    n = F.col("total_responses")
    return totals.select(
        scores.nps_or_zero(F.col("promoters"), F.col("detractors"), n, 2).alias("current_nps"),
        "total_responses",
        "promoters",
        "passives",
        "detractors",
        F.coalesce(rounded_ratio(F.col("score_sum"), n, 2), F.lit(0.0)).alias("avg_score"),
    )


def _mention_board(rows: DataFrame, key: str, out: str) -> DataFrame:
    hits = F.col("hits").cast("bigint")
    t = rows.groupBy(F.col(key).alias(out)).agg(
        F.sum(hits).alias("total"),
        *scores.bucket_counts(F.col("nps_score"), hits),
        F.sum(F.col("nps_score") * hits).alias("score_sum"),
    )
    n = F.col("total")
    return t.withColumns(
        {
            "nps": scores.nps_or_zero(F.col("promoters"), F.col("detractors"), n, 2),
            "avg_score": rounded_ratio(F.col("score_sum"), n, 2),
        }
    )


def theme_titles(rows: DataFrame, theme: str, *, k: int = 10, **filters) -> DataFrame:
    """Titles in which a theme is mentioned, largest first."""
    kept = apply_filters(rows.filter(F.col("theme") == theme), **filters)
    return (
        _mention_board(kept, "title_text", "title")
        .orderBy(F.desc("total"), F.asc_nulls_last("title"))
        .limit(k)
        .drop("score_sum")
    )


def title_themes(
    rows: DataFrame,
    title: str,
    *,
    k: int = 10,
    high: int = 5,
    medium: int | None = 3,
    **filters,
) -> DataFrame:
    """Themes of a title with counts, scores, stand-in sentiment and class."""
    kept = apply_filters(rows, title=title, **filters)
    n = F.col("total")
    return (
        _mention_board(kept, "theme", "theme")
        .orderBy(F.desc("total"), F.asc_nulls_last("theme"))
        .limit(k)
        .select(
            "theme",
            n.alias("title_mentions"),
            "promoters",
            "passives",
            "detractors",
            "nps",
            "avg_score",
            scores.sentiment_proxy(F.col("score_sum"), n).alias("avg_sentiment"),
            source_class(F.col("theme"), ref.TITLE_BASE_THEMES).alias("source"),
            relevance(n, high, medium).alias("business_relevance"),
        )
    )


def counts_from_percentages(overview_rows: DataFrame, *, digits: int = 4) -> DataFrame:
    """Promoter and detractor counts rebuilt from overview percentages."""
    unit = 10**digits

    def rebuilt(name: str) -> Column:
        units = F.round(F.col(f"pct_{name}") * unit).cast("bigint")
        return scaled_ratio(units * F.col("mentions"), F.lit(unit), 0).alias(name)

    return overview_rows.select("theme", rebuilt("promoters"), rebuilt("detractors"))


def share_sparklines(rows: DataFrame, *, k: int = 5, **filters) -> DataFrame:
    """Monthly share of the top themes among responses with any theme.

    One job: month counts per theme, month totals over responses, and a grid
    of months x top themes so that a month without the theme shows 0.
    """
    kept = apply_filters(rows, **filters).withColumn(
        "month", cleaning.month_text(F.col("creation_date"))
    )
    top = (
        rows.groupBy("theme")
        .agg(F.sum("hits").alias("m"))
        .orderBy(F.desc("m"), F.asc_nulls_last("theme"))
        .limit(k)
    )
    counts = kept.groupBy("month", "theme").agg(F.count(F.lit(1)).alias("with_theme"))
    totals = kept.groupBy("month").agg(F.count_if("lead").alias("total"))
    # The k top themes travel as one array value: no join is needed for the grid.
    names = top.agg(F.array_sort(F.collect_list("theme"))).scalar()
    grid = totals.select("month", "total", F.explode(names).alias("theme"))
    return grid.join(counts, ["month", "theme"], "left").select(
        "theme",
        "month",
        scores.percent(F.coalesce("with_theme", F.lit(0)), F.col("total"), 2).alias("share_pct"),
    )


def distribution(rows: DataFrame, *, k: int | None = None) -> DataFrame:
    """Mentions per theme with their share of all mentions."""
    counts = rows.groupBy("theme").agg(F.sum("hits").alias("mentions"))
    total = total_of(counts, "mentions")
    if k is not None:
        counts = counts.orderBy(F.desc("mentions"), F.asc_nulls_last("theme")).limit(k)
    return counts.select(
        "theme", "mentions", scores.percent(F.col("mentions"), total).alias("percentage")
    )


def share_of_enrichment(
    enrichment: DataFrame, theme: str = ref.CATCH_ALL
) -> DataFrame:
    """Mentions of one stored theme against the number of enrichment rows."""
    hits = F.size(F.filter("themes", lambda t: t == theme))
    return (
        enrichment.agg(
            F.sum(F.when(F.col("themes").isNotNull(), hits)).alias("mentions"),
            F.count(F.lit(1)).alias("n"),
        )
        .filter(F.col("mentions") > 0)
        .select(
            F.lit(theme).alias("theme"),
            F.col("mentions").cast("bigint").alias("mentions"),
            scores.percent(F.col("mentions"), F.col("n")).alias("percentage"),
        )
    )


def vocabulary(enrichment: DataFrame) -> DataFrame:
    """Distinct stored theme names, sorted."""
    return (
        enrichment.select(F.explode("themes").alias("theme")).distinct().orderBy("theme")
    )


def business_category(theme: Column) -> Column:
    """First business category with a keyword inside the theme name."""
    return first_label(theme, ref.BUSINESS_CATEGORY_RULES, F.lit("Other"))


def category_summary(listing: DataFrame) -> DataFrame:
    """Business categories over a theme listing (theme, count_responses, avg_*).

    Means are unweighted over themes; a missing value counts as 0.
    """
    order = F.array_position(
        F.array(*map(F.lit, ref.BUSINESS_CATEGORY_ORDER)), F.col("category")
    )

    def tenths(name: str, digits: int) -> Column:
        return F.sum(
            F.round(F.coalesce(F.col(name), F.lit(0.0)) * 10**digits).cast("bigint")
        )

    return (
        listing.filter(F.col("theme").isNotNull() & (F.col("theme") != ""))
        .withColumn("category", business_category(F.col("theme")))
        .groupBy("category")
        .agg(
            F.count(F.lit(1)).alias("total_themes"),
            F.sum("count_responses").alias("total_responses"),
            tenths("avg_nps", 1).alias("s1"),
            tenths("avg_sentiment", 2).alias("s2"),
            F.min_by(
                "theme", F.struct((-F.col("count_responses")).alias("o"), "theme")
            ).alias("top_theme"),
        )
        .select(
            "category",
            order.cast("int").alias("position"),
            "total_themes",
            "total_responses",
            rounded_ratio(F.col("s1"), F.col("total_themes") * 10, 2).alias("avg_nps"),
            rounded_ratio(F.col("s2"), F.col("total_themes") * 100, 3).alias("avg_sentiment"),
            "top_theme",
        )
        .orderBy("position")
    )


def listing_counts(listing: DataFrame) -> DataFrame:
    """Themes by source and relevance."""
    return listing.agg(
        F.count(F.lit(1)).alias("themes"),
        F.count_if(F.col("source") == "base").alias("base_themes"),
        F.count_if(F.col("source") == "ai").alias("ai_themes"),
        *[
            F.count_if(F.col("business_relevance") == r).alias(f"{r}_relevance")
            for r in ("high", "medium", "low")
        ],
    )


def sample_quotes(rows: DataFrame, *, k: int = 3, comments: Comments | None = None) -> DataFrame:
    """Up to ``k`` comments per theme for promoters and for detractors.

    Newest first with the response id as tie-break; rows, not arrays. With
    ``comments`` the rows hold references, and it fetches the texts of the quotes.
    """
    score = F.col("nps_score")
    bucket = F.when(scores.is_promoter(score), scores.PROMOTER).when(
        scores.is_detractor(score), scores.DETRACTOR
    )
    held = held_comment(comments)
    quoted = rows.filter(written(comments)).select(
        "theme", bucket.alias("bucket"), "creation_date", "response_id", held
    )
    picked = top_per_group(
        quoted.filter(F.col("bucket").isNotNull()),
        ["theme", "bucket"],
        [F.desc("creation_date"), F.asc("response_id")],
        k,
    )
    texts = comments(picked) if comments else picked
    return texts.select(
        "theme", "bucket", "creation_date", "response_id", F.col("nps_explanation").alias("quote"), "rank"
    )


def array_sets(enrichment: DataFrame, theme: str = ref.CATCH_ALL) -> DataFrame:
    """How often each whole theme array occurs among rows with a given theme."""
    return (
        enrichment.filter(F.array_contains("themes", theme))
        .groupBy("themes")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"))
    )
