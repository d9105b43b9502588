"""Daily rollup table with breakdown maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import cleaning, scores
from ..sources import reference_data as ref
from .themes import Synonyms, canonical_theme

_DIMENSIONS = {
    "gender": "gender_breakdown",
    "age_range": "age_breakdown",
    "years_employed": "employment_breakdown",
    "sentiment": "sentiment_distribution",
}


def facet_counts(
    responses: DataFrame,
    enrichment: DataFrame,
    synonyms: Synonyms = ref.SYNONYM_GROUPS,
) -> DataFrame:
    """Count of every (survey, day, facet, value) in one pass and one shuffle.

    Facets are the score bucket, three demographic columns, the sentiment
    label and each distinct canonical theme of a response.
    """

    def facet(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("facet"), value.alias("value"))

    joined = responses.join(
        enrichment.select(
            F.col("response_id").alias("id"), "themes", F.col("sentiment_label")
        ),
        "id",
        "left",
    )
    themes = F.array_distinct(
        F.transform(
            F.coalesce("themes", F.array().cast("array<string>")),
            lambda t: canonical_theme(t, synonyms),
        )
    )
    facets = F.concat(
        F.array(
            facet("bucket", scores.category(F.col("nps_score"))),
            *[
                facet(c, cleaning.or_unknown(F.col(c)))
                for c in ("gender", "age_range", "years_employed")
            ],
        ),
        F.when(
            F.col("sentiment_label").isNotNull(),
            F.array(facet("sentiment", F.col("sentiment_label"))),
        ).otherwise(F.array().cast("array<struct<facet:string,value:string>>")),
        F.transform(themes, lambda t: facet("theme", t)),
    )
    return (
        joined.select("survey_name", "creation_date", F.inline(facets))
        .groupBy("survey_name", "creation_date", "facet", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def daily_rollup(
    responses: DataFrame,
    enrichment: DataFrame,
    *,
    top_themes: int = 5,
    synonyms: Synonyms = ref.SYNONYM_GROUPS,
) -> DataFrame:
    """One row per survey and day: counts, net score, breakdown maps, top themes.

    Maps are gathered from counts, so an entry stands for a distinct value
    and no group ever holds the responses themselves. The maps hold the
    vocabulary of a dimension, which must be of a size for one row. Counts are
    made once and ranked in place.
    """
    keys = ["survey_name", "creation_date"]
    counts = facet_counts(responses, enrichment, synonyms)
    place = Window.partitionBy(*keys, "facet").orderBy(F.desc("n"), F.asc("value"))
    rows = counts.withColumn("rank", F.row_number().over(place)).filter(
        (F.col("facet") != "theme") | (F.col("rank") <= top_themes)
    )
    n, value, name = F.col("n"), F.col("value"), F.col("facet")

    def bucket(label: str) -> Column:
        return F.coalesce(
            F.sum(F.when((name == "bucket") & (value == label), n)), F.lit(0)
        )

    def breakdown(facet: str) -> Column:
        entries = F.collect_list(F.when(name == facet, F.struct(value, n)))
        return F.map_from_entries(F.array_sort(entries))

    themes = F.transform(
        F.array_sort(F.collect_list(F.when(name == "theme", F.struct("rank", "value", "n")))),
        lambda s: F.struct(s["value"].alias("theme"), s["n"].alias("mentions")),
    )
    grouped = rows.groupBy(*keys).agg(
        F.sum(F.when(name == "bucket", n)).alias("total_responses"),
        bucket(scores.PROMOTER).alias("promoters"),
        bucket(scores.PASSIVE).alias("passives"),
        bucket(scores.DETRACTOR).alias("detractors"),
        *[breakdown(f).alias(out) for f, out in _DIMENSIONS.items()],
        themes.alias("top_themes"),
    )
    return grouped.withColumnRenamed("creation_date", "rollup_date").withColumn(
        "nps_score",
        scores.nps_or_zero(
            F.col("promoters"), F.col("detractors"), F.col("total_responses")
        ),
    )
