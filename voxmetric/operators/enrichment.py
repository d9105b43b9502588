"""From open comments to enrichment rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .. import schemas
from ..functions import cleaning, scores
from ..sources import reference_data as ref
from .lookup import lookup_join
from .nps import top_per_group
from .text import classify_comment, matched_keywords, theme_scores

COMPLETED, SKIPPED, FAILED = "completed", "skipped", "failed"
SCORED = "themes array<string>, sentiment_score decimal(3,2), keywords array<string>"


def pending(responses: DataFrame, enrichment: DataFrame) -> DataFrame:
    """Responses without an enrichment row."""
    done = enrichment.select(F.col("response_id").alias("id"))
    return responses.join(done, "id", "left_anti")


def enrich(pending_rows: DataFrame, model: str = "taxonomy") -> DataFrame:
    """Enrichment rows by the built-in keyword taxonomy, without leaving the JVM.

    Comments that are blank or 'not applicable' come back as ``skipped``.
    """
    text = cleaning.comment(F.col("nps_explanation"))
    scored = pending_rows.select(
        F.col("id").alias("response_id"),
        "nps_score",
        F.when(text.isNull(), SKIPPED).otherwise(COMPLETED).alias("processing_status"),
        F.when(text.isNotNull(), classify_comment(text)).alias("themes"),
        F.lit(None).cast("decimal(3,2)").alias("sentiment_score"),
        F.when(text.isNotNull(), matched_keywords(text)).alias("keywords"),
    )
    return build_records(scored.withColumn("theme_scores", theme_scores(F.col("keywords"))), model)


def enrich_with(
    pending_rows: DataFrame,
    scorer: Callable[[pd.Series], pd.DataFrame],
    model: str,
) -> DataFrame:
    """Enrichment rows by a custom scorer that takes a batch of comments.

    ``scorer`` returns themes, sentiment_score and keywords aligned with its
    input. A batch that raises is halved until the comments that raise alone
    are found; only those are marked ``failed``.
    """

    names = ("themes", "sentiment_score", "keywords")

    def score(texts: pd.Series) -> list[tuple]:
        try:
            result = scorer(texts)
            return list(zip(*(result[name] for name in names), [COMPLETED] * len(texts), strict=True))
        except Exception:
            if len(texts) == 1:
                return [(None, None, None, FAILED)]
            half = len(texts) // 2
            return score(texts.iloc[:half]) + score(texts.iloc[half:])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["comment"].dropna()
            found = dict(zip(texts.index, score(texts) if len(texts) else []))
            rows = [found.get(i, (None, None, None, SKIPPED)) for i in batch.index]
            scored = pd.DataFrame(rows, columns=[*names, "processing_status"], index=batch.index)
            yield pd.concat([batch[["response_id", "nps_score"]], scored], axis=1)

    rows = pending_rows.select(
        F.col("id").alias("response_id"),
        "nps_score",
        cleaning.comment(F.col("nps_explanation")).alias("comment"),
    )
    scored = rows.mapInPandas(
        run,
        "response_id bigint, nps_score int, themes array<string>, sentiment_score double, "
        "keywords array<string>, processing_status string",
    ).withColumn("sentiment_score", F.col("sentiment_score").cast("decimal(3,2)"))
    return build_records(scored, model)


def build_records(scored: DataFrame, model: str, language: str = "nl") -> DataFrame:
    """Enrichment rows from scored comments: label, flags, summary, status.

    What a scorer does not give is null: ``theme_scores``, ``confidence``,
    ``embedding``. ``created_at`` is the time of the run.
    """
    size = F.coalesce(F.array_size("themes"), F.lit(0))

    def given(name: str) -> Column:
        kind = schemas.ENRICHMENT[name].dataType
        value = F.col(name) if name in scored.columns else F.lit(None)
        return value.cast(kind).alias(name)

    return scored.select(
        "response_id",
        "themes",
        F.try_element_at("themes", F.lit(1)).alias("primary_theme"),
        given("theme_scores"),
        "sentiment_score",
        scores.sentiment_label(F.col("sentiment_score")).alias("sentiment_label"),
        "keywords",
        given("confidence"),
        given("embedding"),
        *scores.flags(F.col("nps_score")),
        F.concat(F.lit("Analyse van "), size.cast("string"), F.lit(" thema's")).alias("summary"),
        "processing_status",
        F.lit(model).alias("model"),
        F.lit(language).alias("language"),
        F.current_timestamp().alias("created_at"),
    )


def batch_counters(records: DataFrame) -> DataFrame:
    """Processed, skipped and failed rows of an enrichment run."""
    status = F.col("processing_status")
    return records.agg(
        F.count_if(status == COMPLETED).alias("processed"),
        F.count_if(status == SKIPPED).alias("skipped"),
        F.count_if(status == FAILED).alias("failed"),
    )


# ------------------------------------------------------------ reconciliation

_NEW = -1


def _clean_answers(answers: DataFrame) -> DataFrame:
    def tidy(c: Column) -> Column:
        return F.coalesce(
            cleaning.strip(c, cleaning.SPACES_WITH_CONTROLS), F.lit("")
        )

    return answers.select(
        "response_id",
        "sentiment",
        "confidence",
        tidy(F.col("primary_theme")).alias("primary"),
        tidy(F.col("new_theme")).alias("proposed"),
        F.filter(
            F.transform(F.coalesce("themes", F.array().cast("array<string>")), tidy),
            lambda t: t != "",
        ).alias("themes"),
    )


def _named(answers: DataFrame, dimension: DataFrame) -> DataFrame:
    """Answer rows exploded to (response, position, name).

    Position -1 is an accepted new theme; a row without any theme gets the
    catch-all.
    """
    known = dimension.select(F.col("name").alias("primary")).distinct().withColumn("known", F.lit(True))
    rows = lookup_join(_clean_answers(answers), known, "primary")
    adopted = (F.col("proposed") != "") & (
        (F.lower("primary") == F.lower("proposed")) | F.col("known").isNull()
    )
    packed = F.transform(
        "themes", lambda t, i: F.struct(i.alias("position"), t.alias("name"))
    )
    proposal = F.array(F.struct(F.lit(_NEW).alias("position"), F.col("proposed").alias("name")))
    catch_all = F.array(F.struct(F.lit(0).alias("position"), F.lit(ref.CATCH_ALL).alias("name")))
    entries = F.when(adopted, F.concat(proposal, packed)).otherwise(packed)
    return rows.select(
        "response_id",
        "sentiment",
        "confidence",
        "primary",
        F.inline(F.when(F.size(entries) > 0, entries).otherwise(catch_all)),
    )


def _canonical(used: DataFrame, dimension: DataFrame) -> DataFrame:
    """(name, slug, canonical, fresh) of every name that is used.

    The canonical name of a known slug is the dimension's, that of a new one its
    first use. Least uses merge: a task sends one row for each of its names, and
    slugs are made from distinct names.
    """
    # The place of a use as one number, which a hash aggregation keeps in place.
    at = F.col("response_id").cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(10,0)") + F.col("position")
    # The hash keeps all columns of ``used`` alive, so that its shuffled rows
    # are the ones that the caller reads, and are made once.
    by_name = used.groupBy("name").agg(F.min(at).alias("at"), F.max(F.xxhash64(*used.columns)).alias("whole"))
    by_name = by_name.filter(F.col("whole").isNotNull()).select("name", "at", cleaning.slug(F.col("name")).alias("slug"))
    first = by_name.groupBy("slug").agg(F.min(F.struct("at", "name")).alias("use"))
    known = dimension.groupBy("slug").agg(F.min("name").alias("known"))
    canonical = first.join(known, "slug", "left").select(
        "slug", F.coalesce("known", "use.name").alias("canonical"), F.col("known").isNull().alias("fresh")
    )
    return by_name.select("name", "slug").join(canonical, "slug")


def one_answer(answers: DataFrame) -> DataFrame:
    """One answer per response: the one with the highest confidence, then the largest.

    Two answers of one response are never mixed.
    """
    rest = [c for c in answers.columns if c not in ("response_id", "confidence")]
    order = [F.desc_nulls_last("confidence"), *[F.desc_nulls_last(c) for c in rest]]
    return top_per_group(answers, ["response_id"], order, 1).drop("rank")


def new_themes(answers: DataFrame, dimension: DataFrame) -> DataFrame:
    """Dimension rows (name, slug) to append: one per unseen slug, first use wins."""
    found = _canonical(_named(one_answer(answers), dimension), dimension).filter("fresh")
    return found.select(F.col("canonical").alias("name"), "slug").distinct()


def reconcile(answers: DataFrame, dimension: DataFrame) -> DataFrame:
    """Answers with themes replaced by the names of the theme dimension.

    Themes are matched by slug; a slug that the dimension lacks gets the name
    that ``new_themes`` gives it. Order is kept and repeats are dropped. An
    accepted new theme becomes the primary theme and leads the list. Nothing is
    written and no job starts before the result is read.
    """
    # One shuffle that both the dictionary and the join read, and the grouping by
    # response finds in place. The rows may come in the session's number of
    # partitions by response already; a shuffle to the same would be left out,
    # and every reader would make the rows anew.
    used = _named(one_answer(answers), dimension)
    used = used.repartition(int(used.sparkSession.conf.get("spark.sql.shuffle.partitions")) + 1, "response_id")
    rows = lookup_join(used, _canonical(used, dimension).select("name", "canonical"), "name")
    grouped = rows.groupBy("response_id").agg(
        F.min(F.struct("sentiment", "confidence", "primary")).alias("answer"),
        F.array_sort(F.collect_list(F.struct("position", "name", "canonical"))).alias("e"),
    )
    proposal = F.try_element_at(
        F.filter("e", lambda x: x["position"] == _NEW), F.lit(1)
    )["canonical"]
    rest = F.filter("e", lambda x: x["position"] != _NEW)
    listed = F.transform(rest, lambda x: x["canonical"])
    present = F.array_contains(F.transform(rest, lambda x: x["name"]), proposal)
    ordered = F.when(
        proposal.isNotNull() & ~present, F.concat(F.array(proposal), listed)
    ).otherwise(listed)
    themes = F.array_distinct(ordered)
    return grouped.select(
        "response_id",
        F.coalesce(
            proposal, F.nullif(F.col("answer.primary"), F.lit("")), themes[0]
        ).alias("primary_theme"),
        themes.alias("themes"),
        F.col("answer.sentiment").alias("sentiment"),
        F.col("answer.confidence").alias("confidence"),
    )
