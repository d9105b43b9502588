"""Key words, keyword themes and parsing of model output."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import cleaning
from ..functions.automaton import found_groups
from ..functions.matching import let, word_array
from ..functions.rounding import rounded_ratio
from ..sources import reference_data as ref
from .filters import Comments, held_comment, written
from .nps import top_per_group

_PUNCTUATION = ".,!?;:()[]"


# ---------------------------------------------------------------- key words


def words(text: Column, *, strip_punctuation: bool = True) -> Column:
    """Lower-case whitespace-separated words of a text."""
    return cleaning.split_words(
        F.lower(text), others=_PUNCTUATION if strip_punctuation else ""
    )


def word_counts(
    texts: DataFrame,
    column: str,
    *,
    keys: Sequence[str] = (),
    min_length: int = 4,
    stop_words: Sequence[str] = ref.DUTCH_STOP_WORDS,
    strip_punctuation: bool = True,
    drop_numbers: bool = True,
) -> DataFrame:
    """Frequency of meaningful words over whole texts, optionally per key."""
    word = F.col("word")
    rows = texts.select(
        *keys,
        F.explode(words(F.col(column), strip_punctuation=strip_punctuation)).alias("word"),
    ).filter((F.length(word) >= min_length) & ~word.isin(*stop_words))
    if drop_numbers:
        rows = rows.filter(~word.rlike("^[0-9]+$"))
    return rows.groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("count"))


def key_words(texts: DataFrame, column: str = "nps_explanation", *, k: int = 10, **options) -> DataFrame:
    """Most frequent meaningful words."""
    return word_counts(texts, column, **options).orderBy(F.desc("count"), "word").limit(k)


def top_words_per_question(
    answers: DataFrame,
    *,
    k: int = 5,
    key: str = "question_text",
    column: str = "response_text",
) -> DataFrame:
    """Top words of each question's answers: three letters and up, English stop list."""
    counts = word_counts(
        answers, column, keys=[key], min_length=3, stop_words=ref.ENGLISH_STOP_WORDS,
        strip_punctuation=False, drop_numbers=False,
    )
    return top_per_group(counts, [key], [F.desc("count"), F.asc("word")], k)


def keyword_hints(
    assignments: DataFrame,
    *,
    key: str = "theme",
    samples: int = 5,
    k: int = 5,
    stop_words: Sequence[str] = ref.HINT_STOP_WORDS,
    comments: Comments | None = None,
) -> DataFrame:
    """First distinct words of a few sample comments per theme, in reading order.

    Samples are the newest commented responses; a theme of any size reaches
    its group as that many texts. With ``comments`` the rows hold references,
    and it fetches the texts of the samples.
    """
    picked = top_per_group(
        assignments.filter(written(comments)).select(
            key, "creation_date", "response_id", held_comment(comments)
        ),
        [key],
        [F.desc("creation_date"), F.asc("response_id")],
        samples,
    )
    picked = comments(picked) if comments else picked
    found = F.regexp_extract_all(
        F.lower("nps_explanation"), F.lit("([A-Za-z0-9_]{3,})"), F.lit(1)
    )
    stop = word_array(stop_words)
    gathered = picked.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("rank", found.alias("w")))).alias("s")
    )
    in_order = F.array_except(F.flatten(F.transform("s", lambda x: x["w"])), stop)
    return gathered.select(key, F.slice(F.array_distinct(in_order), 1, k).alias("keywords"))


# ----------------------------------------------------------- keyword themes


def theme_keywords(theme: str) -> tuple[str, ...]:
    return ref.FREQUENCY_KEYWORDS.get(theme, (theme,))


def theme_frequency(
    responses: DataFrame, themes: Sequence[str], column: str = "nps_explanation"
) -> DataFrame:
    """Share of responses whose comment holds any keyword of a theme.

    All themes are counted in one pass over the comments.
    """
    found = found_groups(F.lower(column), [[k.lower() for k in theme_keywords(t)] for t in themes])
    totals = responses.select(found.alias("found")).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.array_contains("found", F.lit(i))).alias(f"m_{i}") for i in range(len(themes))],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(t).alias("theme"),
                F.col(f"m_{i}").alias("matches"),
                F.col("n").alias("responses"),
            )
            for i, t in enumerate(themes)
        ]
    )
    return totals.select(F.inline(rows)).select(
        "theme",
        "matches",
        "responses",
        F.coalesce(rounded_ratio(F.col("matches"), F.col("responses"), 6), F.lit(0.0)).alias("frequency"),
    )


def business_relevance(theme: Column, source: Column) -> Column:
    return (
        F.when((source == "base") | theme.isin(*ref.HIGH_RELEVANCE_THEMES), "high")
        .when(theme.isin(*ref.MEDIUM_RELEVANCE_THEMES), "medium")
        .otherwise("low")
    )


def generate_themes(
    responses: DataFrame,
    discovered: Sequence[tuple[str, float, str]] = (),
    *,
    base: Sequence[str] = ref.BASE_THEMES,
    min_frequency: float = 0.05,
    max_themes: int = 8,
    column: str = "nps_explanation",
) -> DataFrame:
    """Base and discovered themes with frequency, ranked by relevance and frequency.

    ``discovered`` is the short list a model proposed: (name, confidence,
    explanation).
    """
    spark = responses.sparkSession
    rows = [(i, t, "base", 1.0, "Predefined business category") for i, t in enumerate(base)]
    rows += [
        (len(base) + i, n, "ai_discovered", float(c), e)
        for i, (n, c, e) in enumerate(discovered)
    ]
    themes = spark.createDataFrame(
        rows, "position int, name string, source string, confidence double, explanation string"
    )
    names = list(dict.fromkeys(r[1] for r in rows))
    frequency = theme_frequency(responses, names, column).select(
        F.col("theme").alias("name"), "frequency"
    )
    relevance = business_relevance(F.col("name"), F.col("source"))
    weight = F.when(relevance == "high", 3).when(relevance == "medium", 2).otherwise(1)
    return (
        themes.join(frequency, "name")
        .filter(F.col("frequency") >= min_frequency)
        .withColumn("business_relevance", relevance)
        .orderBy(F.desc(weight + F.col("frequency")), "position")
        .limit(max_themes)
        .select("name", "source", "frequency", "confidence", "explanation", "business_relevance")
    )


def classify_comment(
    comment: Column, taxonomy: Sequence[tuple[str, Sequence[str]]] = ref.COMMENT_TAXONOMY
) -> Column:
    """Labels of the taxonomy whose keywords occur in a comment; catch-all if none."""
    labels = word_array([label for label, _ in taxonomy])
    found = found_groups(F.lower(comment), [[k.lower() for k in kws] for _, kws in taxonomy])
    hits = F.transform(found, lambda i: F.get(labels, i))
    return F.when(F.size(hits) > 0, hits).otherwise(F.array(F.lit(ref.CATCH_ALL)))


def matched_keywords(
    comment: Column, taxonomy: Sequence[tuple[str, Sequence[str]]] = ref.COMMENT_TAXONOMY
) -> Column:
    """Taxonomy keywords that occur in a comment."""
    kws = list(dict.fromkeys(k for _, group in taxonomy for k in group))
    words_ = word_array(kws)
    return F.transform(found_groups(F.lower(comment), [[k] for k in kws]), lambda i: F.get(words_, i))


def theme_scores(
    keywords: Column, taxonomy: Sequence[tuple[str, Sequence[str]]] = ref.COMMENT_TAXONOMY
) -> Column:
    """Label to the share of its taxonomy keywords among those found in a comment."""
    shares = F.array(
        *[
            F.struct(
                F.lit(label).alias("label"),
                (F.size(F.array_intersect(keywords, word_array(kws))) / F.lit(len(set(kws)))).alias("share"),
            )
            for label, kws in taxonomy
        ]
    )
    found = F.map_from_entries(F.filter(shares, lambda s: s["share"] > 0))
    return F.when(keywords.isNotNull(), found)


# ------------------------------------------------------- model output text

_ANSWER = (
    "primary_theme string, themes array<string>, sentiment string, "
    "confidence string, new_theme string"
)


def parse_answer(text: Column) -> Column:
    """Classification answer to a struct with defaults.

    Takes the JSON object of the text, also when prose surrounds it; a text
    without one gives the defaults.
    """
    body = F.when(
        ~F.coalesce(text.rlike(r"(?s)^\s*\[.*\]\s*$"), F.lit(True)),
        F.regexp_extract(text, r"(?s)\{.*\}", 0),
    )
    # Fields read from the parsed column itself would be parsed one by one.
    return let(
        F.from_json(F.nullif(body, F.lit("")), _ANSWER),
        lambda parsed: F.struct(
            F.coalesce(parsed["primary_theme"], F.lit("")).alias("primary_theme"),
            F.coalesce(parsed["themes"], F.array().cast("array<string>")).alias("themes"),
            F.coalesce(parsed["sentiment"], F.lit("neutral")).alias("sentiment"),
            F.coalesce(parsed["confidence"].try_cast("double"), F.lit(0.6)).alias("confidence"),
            F.nullif(parsed["new_theme"], F.lit("")).alias("new_theme"),
        ),
    )


_THEME_LIST = (
    "array<struct<name:string,confidence:double,explanation:string,businessRelevance:string>>"
)
_DISCOVERED = "AI-discovered theme from customer feedback"


def parse_theme_list(text: Column) -> Column:
    """Theme list text to an array of (name, confidence, explanation, relevance).

    A JSON array; else the first bracketed part as JSON; else the first quoted
    snake-case word of each line, once each, with confidence 0.7. Names become
    identifiers, confidences are clamped, entries without either are dropped.
    """
    direct = F.when(text.rlike(r"(?s)^\s*\["), F.from_json(text, _THEME_LIST))
    inner = F.nullif(F.regexp_extract(text, r"(?s)\[.*?\]", 0), F.lit(""))
    bracketed = F.transform(
        F.from_json(inner, _THEME_LIST),
        lambda t: F.struct(
            F.coalesce(F.nullif(t["name"], F.lit("")), F.lit("unknown_theme")).alias("name"),
            F.coalesce(F.nullif(t["confidence"], F.lit(0.0)), F.lit(0.7)).alias("confidence"),
            F.coalesce(t["explanation"], F.lit("AI-discovered theme")).alias("explanation"),
            F.lit(None).cast("string").alias("businessRelevance"),
        ),
    )
    per_line = F.transform(
        F.split(text, "\n"),
        lambda line: F.nullif(F.regexp_extract(line, '"([a-z_]+)"', 1), F.lit("")),
    )
    quoted = F.transform(
        F.array_distinct(F.filter(per_line, lambda w: w.isNotNull())),
        lambda w: F.struct(
            w.alias("name"),
            F.lit(0.7).alias("confidence"),
            F.lit("AI-discovered theme (extracted from text)").alias("explanation"),
            F.lit(None).cast("string").alias("businessRelevance"),
        ),
    )
    items = F.coalesce(direct, bracketed, quoted)
    valid = F.filter(
        items,
        lambda t: F.coalesce(
            (t["name"] != "") & (t["confidence"] != 0), F.lit(False)
        ),
    )
    return F.transform(
        valid,
        lambda t: F.struct(
            cleaning.theme_id(t["name"]).alias("name"),
            cleaning.clamp_unit(t["confidence"]).alias("confidence"),
            F.coalesce(F.nullif(t["explanation"], F.lit("")), F.lit(_DISCOVERED)).alias("explanation"),
            F.coalesce(F.nullif(t["businessRelevance"], F.lit("")), F.lit("medium")).alias("business_relevance"),
        ),
    )


def strip_code_fence(text: Column) -> Column:
    """Text without a Markdown code fence around it."""
    body = cleaning.strip(text)
    bare = F.regexp_replace(
        F.regexp_replace(body, r"^```(json)?\s*", ""), r"\s*```\z", ""
    )
    return F.when(body.startswith("```"), bare).otherwise(body)


def parse_sub_themes(text: Column, schema: str) -> Column:
    """JSON array inside an optional code fence; NULL when it is not an array."""
    bare = strip_code_fence(text)
    return F.when(bare.rlike(r"(?s)^\s*\["), F.from_json(bare, schema))
