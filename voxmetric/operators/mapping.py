"""Theme rules, category mapping and hierarchy.

Rule tables are fixed lists (see ``sources.reference_data``) and cost no join.
Keywords are found by one automaton for all rules. Names are looked up on theme
totals, one row per distinct theme, wherever a theme name is enough.
"""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import scores
from ..functions.automaton import Automaton, found_groups
from ..functions.matching import contains_any, let, word_array
from ..functions.rounding import rounded_ratio
from ..sources import reference_data as ref
from .lookup import lookup_join, total_of
from .nps import top_per_group

Rules = tuple[tuple[str, tuple[str, ...]], ...]


# ------------------------------------------------------- reclassification


def rule_target(comment: Column, rules: Rules) -> Column:
    """Theme of the first rule with a keyword in the comment, else NULL."""
    found = found_groups(F.lower(comment), [[w.lower() for w in words] for _, words in rules], once=True)
    return F.get(word_array([label for label, _ in rules]), F.get(found, F.lit(0)))


def reclassify(
    enrichment: DataFrame,
    responses: DataFrame,
    *rule_sets: Rules,
    catch_all: str = ref.CATCH_ALL,
) -> DataFrame:
    """Re-label the catch-all theme by comment keywords.

    Rule sets run in sequence; the first hit wins because the label is gone
    afterwards. Rules are evaluated where the comment is read, so only
    (response, new label) pairs of hits enter the join, never the text.
    """
    flat = tuple(rule for rules in rule_sets for rule in rules)
    targets = responses.select(
        F.col("id").alias("response_id"), rule_target(F.col("nps_explanation"), flat).alias("target")
    ).filter(F.col("target").isNotNull())
    # Only repeats that the replacement makes go: the target is put where the
    # first catch-all was, unless the list has it already.
    others = F.filter("themes", lambda t: t.isNull() | (t != catch_all))
    place = F.greatest(F.array_position("themes", catch_all).cast("int"), F.lit(1))
    replaced = F.when(
        F.array_contains(others, F.col("target")), others
    ).otherwise(F.array_insert(others, place, F.col("target")))
    hit = F.array_contains("themes", catch_all) & F.col("target").isNotNull()
    return (
        enrichment.join(targets, "response_id", "left")
        .withColumn("themes", F.when(hit, replaced).otherwise(F.col("themes")))
        .drop("target")
    )


def reclassify_by_summary(
    enrichment: DataFrame,
    *,
    words: tuple[str, ...] = ref.CONTENT_SUMMARY_WORDS,
    target: str = "content_kwaliteit",
    catch_all: str = ref.CATCH_ALL,
) -> DataFrame:
    """Replace the whole array of a catch-all row by one label on a summary keyword."""
    hit = F.array_contains("themes", catch_all) & let(
        F.lower("summary"), lambda low: contains_any(low, words)
    )
    return enrichment.withColumn(
        "themes", F.when(hit, F.array(F.lit(target))).otherwise(F.col("themes"))
    )


def _stored_counts(enrichment: DataFrame) -> DataFrame:
    return (
        enrichment.select(F.explode("themes").alias("theme"))
        .groupBy("theme")
        .agg(F.count(F.lit(1)).alias("mentions"))
    )


def reclassification_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Mentions per theme before and after, with shares and the difference."""
    b, a = _stored_counts(before), _stored_counts(after)
    total_b, total_a = total_of(b, "mentions"), total_of(a, "mentions")
    both = (
        b.select("theme", F.col("mentions").alias("mentions_before"))
        .join(a.select("theme", F.col("mentions").alias("mentions_after")), "theme", "full_outer")
        .na.fill(0, ["mentions_before", "mentions_after"])
    )
    return both.select(
        "theme",
        "mentions_before",
        "mentions_after",
        (F.col("mentions_after") - F.col("mentions_before")).alias("difference"),
        scores.percent(F.col("mentions_before"), total_b).alias("pct_before"),
        scores.percent(F.col("mentions_after"), total_a).alias("pct_after"),
    )


# ----------------------------------------------------------------- mapping


class _NameRules:
    """The outcome of every theme name as a number.

    Patterns contained in a name come from one automaton over the names, and the
    patterns that contain a name from a table of all their substrings, each with
    its first pattern. So a name costs one pass over its bytes and two look-ups,
    however many patterns there are.
    """

    def __init__(self):
        patterns = ref.theme_patterns()
        families = ref.THEME_KEYWORD_FAMILIES
        self.exact, self.within = {}, {}
        words = []
        for i, (pattern, _, _) in enumerate(patterns):
            self.exact.setdefault(pattern, i)
            words.append(() if pattern == ref.CATCH_ALL else (pattern,))
            for a in range(len(pattern) + 1 if words[-1] else 0):
                for b in range(a, len(pattern) + 1):
                    self.within.setdefault(pattern[a:b], i)
        self.patterns = len(patterns)
        self.none = 2 * len(patterns) + len(families)
        self.machine = Automaton([*words, *[f for _, _, f in families]])
        found = [(m, s) for _, m, s in patterns]
        #: (main, sub, confidence, source) by number; the last two are for unknown and missing names.
        self.outcomes = [
            *[(m, s, 0.95, "pattern") for m, s in found], *[(m, s, 0.75, "pattern") for m, s in found],
            *[(m, s, 0.8, "pattern") for m, s, _ in families],
            ("Other", "Uncategorized", 0.1, "fallback"), ("Other", "Unknown", 0.0, "fallback"),
        ]

    def number(self, name: str, hits: list[int]) -> int:
        """Exact pattern, else first pattern that contains the name or is in it, else first family."""
        if name in self.exact:
            return self.exact[name]
        near = [self.within[name]] if name in self.within else []
        near += [i for i in hits[:1] if i < self.patterns]
        if near:
            return self.patterns + min(near)
        return self.patterns + hits[0] if hits else self.none

    def numbers(self, names: pa.Array) -> pa.Array:
        hits = self.machine.numbers(names).to_pylist()
        return pa.array(
            [None if n is None else self.number(n, h) for n, h in zip(names.to_pylist(), hits)], pa.int32()
        )


@functools.cache
def _name_rules() -> _NameRules:
    return _NameRules()


def theme_mapping(theme: Column) -> Column:
    """Struct (main_category, sub_category, confidence, source) of a theme name.

    Exact pattern 0.95; else the first pattern that contains the name or is
    contained in it 0.75; else a keyword family 0.8; else uncategorised 0.1.
    A missing name maps to Other / Unknown with confidence 0. Not for use inside
    a function of array elements.
    """
    rules = _name_rules()

    @F.arrow_udf("int")
    def run(names: pa.Array) -> pa.Array:
        return rules.numbers(names)

    missing = theme.isNull() | (theme == "")
    at = F.coalesce(F.when(~missing, run(F.trim(F.lower(theme)))), F.lit(rules.none + 1))
    main, sub, confidence, source = zip(*rules.outcomes)
    numbers = F.array(*[F.lit(c) for c in confidence])
    return F.struct(
        F.get(word_array(main), at).alias("main_category"),
        F.get(word_array(sub), at).alias("sub_category"),
        F.get(numbers, at).alias("confidence"),
        F.get(word_array(source), at).alias("source"),
    )


def category_colour(main: Column) -> Column:
    """Display colour of a main category; unknown categories get that of Other."""
    colours = {name: colour for name, colour, _, _ in ref.MAIN_CATEGORIES}
    out = None
    for name, colour in colours.items():
        cond = main == name
        out = F.when(cond, colour) if out is None else out.when(cond, colour)
    return out.otherwise(colours["Other"])


def map_themes(themes: DataFrame, column: str = "theme") -> DataFrame:
    """Adds main_category, sub_category, confidence, source and colour."""
    mapped = themes.withColumn("mapping", theme_mapping(F.col(column)))
    return mapped.select(
        *themes.columns, "mapping.*", category_colour(F.col("mapping.main_category")).alias("color")
    )


def hierarchy(theme_rows: DataFrame) -> DataFrame:
    """(main, sub) totals over rows (theme, count_responses, avg_nps, avg_sentiment).

    Score and sentiment are means weighted by count. Members stay rows (see
    ``hierarchy_members``), because one bucket may hold most of the themes.
    """
    n = F.col("count_responses")
    mapped = map_themes(theme_rows)
    tenths = F.round(F.col("avg_nps") * 10).cast("bigint")
    mills = F.round(F.coalesce("avg_sentiment", F.lit(0.0)) * 1000).cast("bigint")
    return (
        mapped.groupBy("main_category", "sub_category")
        .agg(
            F.sum(n).alias("count"),
            F.count(F.lit(1)).alias("themes"),
            F.sum(tenths * n).alias("score_sum"),
            F.sum(F.when(F.col("avg_nps").isNotNull(), n)).alias("scored"),
            F.sum(mills * n).alias("mood_sum"),
            F.min_by("theme", F.struct((-n).alias("o"), "theme")).alias("top_theme"),
        )
        .select(
            "main_category",
            "sub_category",
            "count",
            "themes",
            rounded_ratio(F.col("score_sum"), F.col("scored") * 10, 2).alias("avg_nps"),
            rounded_ratio(F.col("mood_sum"), F.col("count") * 1000, 3).alias("sentiment"),
            "top_theme",
        )
        .orderBy(F.desc("count"), "main_category", "sub_category")
    )


def hierarchy_members(theme_rows: DataFrame) -> DataFrame:
    """Themes of every bucket, one row each."""
    return map_themes(theme_rows).drop("color")


# A folded value weighs half of the next one. The smallest positive double is
# 2^-1074 and no score or sentiment reaches 2^4, so the value with this many
# successors is a product of exactly 0: leaving it out changes no result.
_FOLD_DEPTH = 1080


def hierarchy_folded(theme_rows: DataFrame) -> DataFrame:
    """(main, sub) with the legacy running average ``avg = (avg + x) / 2``.

    Themes are folded by descending count, then name. Starting from 0 the fold
    equals ``sum(x_i / 2^(n-i+1))``, so the last themes carry all the weight;
    the ones that still register are picked per bucket and summed.
    """
    mapped = map_themes(theme_rows)
    keys = ["main_category", "sub_category"]
    counts = mapped.groupBy(*keys).agg(F.sum("count_responses").alias("count"))
    last = top_per_group(
        mapped, keys, [F.asc("count_responses"), F.desc("theme")], _FOLD_DEPTH
    )
    weight = F.pow(F.lit(2.0), -F.col("rank"))
    folded = last.groupBy(*keys).agg(
        F.sum(F.coalesce("avg_nps", F.lit(0.0)) * weight).alias("avg_nps"),
        F.sum(F.coalesce("avg_sentiment", F.lit(0.0)) * weight).alias("sentiment"),
    )
    return counts.join(folded, keys)


def top_sub_themes(theme_rows: DataFrame, *, k: int = 3) -> DataFrame:
    """Largest sub categories outside Other with their share of all counts."""
    buckets = hierarchy(theme_rows).select("main_category", "sub_category", "count")
    total = total_of(buckets, "count")
    return (
        buckets.filter(F.col("main_category") != "Other")
        .orderBy(F.desc("count"), "main_category", "sub_category")
        .limit(k)
        .select(
            "main_category",
            "sub_category",
            "count",
            scores.percent(F.col("count"), total).alias("share_pct"),
        )
    )


# --------------------------------------------------------- category tables


def main_categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(n, n, c, d, o) for n, c, o, d in ref.MAIN_CATEGORIES],
        "name string, display_name string, color string, description string, sort_order int",
    )


def sub_categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(m, n, n, d, o) for m, n, o, d in ref.SUB_CATEGORIES],
        "main_category string, name string, display_name string, description string, sort_order int",
    )


def seed_sub_categories(mains: DataFrame, seed: DataFrame) -> DataFrame:
    """Sub category rows whose main category exists."""
    known = mains.select(F.col("name").alias("main_category"))
    return seed.join(known, "main_category", "left_semi")


def seed_if_absent(existing: DataFrame, seed: DataFrame, keys: list[str]) -> DataFrame:
    """Seed rows to append: one per key, none whose key exists already."""
    return seed.dropDuplicates(keys).join(existing, keys, "left_anti")


def static_hierarchy(spark: SparkSession) -> DataFrame:
    """The fixed mapping of common themes."""
    rows = spark.createDataFrame(
        list(ref.STATIC_THEME_MAPPING),
        "theme_name string, main_category string, sub_category string, "
        "confidence string, source string, response_count int, avg_nps string",
    )
    return rows.withColumns(
        {
            "confidence": F.col("confidence").cast("decimal(3,2)"),
            "avg_nps": F.col("avg_nps").cast("decimal(4,2)"),
        }
    )


def build_hierarchy(theme_rows: DataFrame) -> DataFrame:
    """``theme_hierarchy`` rows from observed themes (theme, count_responses, avg_nps)."""
    return map_themes(theme_rows).select(
        F.col("theme").alias("original_theme"),
        "main_category",
        "sub_category",
        F.col("confidence").cast("decimal(3,2)").alias("confidence"),
        "source",
        F.col("count_responses").alias("response_count"),
        F.col("avg_nps").cast("decimal(4,2)").alias("avg_nps"),
    )


def _with_categories(table: DataFrame, mains: DataFrame, subs: DataFrame) -> DataFrame:
    """Adds category attributes; categories are matched by name, subs within their main."""
    m = mains.select(
        F.col("name").alias("main_category"),
        F.col("display_name").alias("main_category_display"),
        F.col("color").alias("main_category_color"),
        F.col("sort_order").alias("main_order"),
    )
    s = subs.select(
        F.concat_ws("\u0001", "main_category", "name").alias("category_key"),
        F.col("display_name").alias("sub_category_display"),
        F.col("description").alias("sub_category_description"),
        F.col("sort_order").alias("sub_order"),
    )
    keyed = lookup_join(table, m, "main_category").withColumn(
        "category_key", F.concat_ws("\u0001", "main_category", "sub_category")
    )
    return lookup_join(keyed, s, "category_key").drop("category_key")


def hierarchy_detail(table: DataFrame, mains: DataFrame, subs: DataFrame) -> DataFrame:
    """Hierarchy rows with display names, colour and description, in display order."""
    return (
        _with_categories(table, mains, subs)
        .orderBy(
            F.asc_nulls_last("main_order"),
            F.asc_nulls_last("sub_order"),
            F.desc("response_count"),
            "original_theme",
        )
        .drop("main_order", "sub_order")
    )


def hierarchy_stats(table: DataFrame, mains: DataFrame, subs: DataFrame) -> DataFrame:
    """Themes, responses, mean score, mean confidence and source counts per sub."""
    scored = F.col("avg_nps").isNotNull()
    return (
        _with_categories(table, mains, subs)
        .groupBy(
            "main_category", "sub_category", "main_category_display",
            "main_category_color", "sub_category_display", "main_order", "sub_order",
        )
        .agg(
            F.count(F.lit(1)).alias("total_themes"),
            F.sum("response_count").alias("total_responses"),
            F.sum((F.col("avg_nps") * 100).cast("bigint")).alias("s"),
            F.count_if(scored).alias("sn"),
            F.sum((F.col("confidence") * 100).cast("bigint")).alias("c"),
            *[
                F.count_if(F.col("source") == x).alias(f"{x}_mapped")
                for x in ("pattern", "ai", "fallback")
            ],
        )
        .orderBy(
            F.asc_nulls_last("main_order"), F.asc_nulls_last("sub_order"),
            F.desc("total_responses"),
        )
        .select(
            "main_category", "sub_category", "main_category_display",
            "main_category_color", "sub_category_display", "total_themes",
            "total_responses",
            rounded_ratio(F.col("s"), F.col("sn") * 100, 4).alias("avg_nps"),
            rounded_ratio(F.col("c"), F.col("total_themes") * 100, 4).alias("avg_confidence"),
            "pattern_mapped", "ai_mapped", "fallback_mapped",
        )
    )


def lookup_mapping(table: DataFrame, theme: str) -> DataFrame:
    """Stored mapping of one theme."""
    return (
        table.filter(F.col("original_theme") == theme)
        .select("main_category", "sub_category", "confidence", "source")
        .limit(1)
    )


def hierarchical_listing(table: DataFrame) -> DataFrame:
    return table.select(
        "main_category",
        "sub_category",
        F.col("original_theme").alias("theme_name"),
        "response_count",
        "avg_nps",
        "confidence",
        "source",
    ).orderBy("main_category", "sub_category", F.desc("response_count"), "theme_name")


def hierarchy_rollup(table: DataFrame, *, by_sub: bool = False) -> DataFrame:
    """Responses and unweighted mean score per main (or main and sub) category."""
    keys = ["main_category", "sub_category"] if by_sub else ["main_category"]
    return (
        table.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("themes"),
            F.sum("response_count").alias("total_responses"),
            F.sum((F.coalesce("avg_nps", F.lit(0).cast("decimal(4,2)")) * 100).cast("bigint")).alias("s"),
        )
        .select(
            *keys,
            "themes",
            "total_responses",
            rounded_ratio(F.col("s"), F.col("themes") * 100, 2).alias("avg_nps"),
        )
    )


def stats_rollup(stats: DataFrame) -> DataFrame:
    """Main category totals over hierarchy stats; means are unweighted over subs."""

    def units(name: str) -> Column:
        return F.round(F.coalesce(F.col(name), F.lit(0.0)) * 10000).cast("bigint")

    n = F.col("sub_categories")
    return (
        stats.groupBy("main_category")
        .agg(
            F.count(F.lit(1)).alias("sub_categories"),
            F.sum("total_themes").alias("total_themes"),
            F.sum("total_responses").alias("total_responses"),
            F.sum(units("avg_nps")).alias("s"),
            F.sum(units("avg_confidence")).alias("c"),
            *[
                F.sum(f"{x}_mapped").alias(f"{x}_mapped")
                for x in ("pattern", "ai", "fallback")
            ],
        )
        .select(
            "main_category",
            "sub_categories",
            "total_themes",
            "total_responses",
            rounded_ratio(F.col("s"), n * 10000, 2).alias("avg_nps"),
            rounded_ratio(F.col("c"), n * 10000, 2).alias("avg_confidence"),
            "pattern_mapped",
            "ai_mapped",
            "fallback_mapped",
        )
    )
