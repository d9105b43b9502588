"""Reclassification, category mapping and hierarchy."""

from pyspark.sql import functions as F

from ...operators import mapping, themes
from ...sources import reference_data as ref
from .. import bindings
from .base import (
    THEME_AGGREGATE, add, percent, quote, ratio, values, with_commented_enrichment,
    with_enrichment, with_mentions, words,
)

ALL_RULES = (ref.RECLASSIFY_DIRECT, ref.RECLASSIFY_SIMPLE, ref.RECLASSIFY_TARGETED)


def _rules(*sets):
    flat = [rule for rules in sets for rule in rules]
    return values(
        "rules", "position, target, keyword",
        [(i, target, w.lower()) for i, (target, ws) in enumerate(flat) for w in ws],
    )


def _after(*sets, source="enrichment"):
    return f"""{_rules(*sets)},
      targets as (select c.id, arg_min(r.target, r.position) as target
        from commented c join rules r on contains(lower(c.nps_explanation), r.keyword) group by c.id),
      after as (select e.* exclude (themes), case when t.target is null
            or not coalesce(list_contains(e.themes, 'overige'), false) then e.themes
          when list_contains(list_filter(e.themes, lambda x: x <> 'overige'), t.target)
            then list_filter(e.themes, lambda x: x <> 'overige')
          else list_concat(e.themes[:list_position(e.themes, 'overige') - 1], [t.target],
            list_filter(e.themes[list_position(e.themes, 'overige') + 1:], lambda x: x <> 'overige'))
          end as themes
        from {source} e left join targets t on t.id = e.response_id)"""


def _flat(df):
    return df.select("response_id", bindings.joined("themes").alias("themes"))


for _name, _sets in (
    ("direct", ALL_RULES[:1]), ("simple", ALL_RULES[1:2]), ("targeted", ALL_RULES[2:]),
    ("sequence", ALL_RULES),
):
    add(
        f"reclassify_{_name}", "MAP-1 JN-12 Q22 ARR-1",
        lambda t, s=_sets: _flat(mapping.reclassify(t.enrichment, t.commented, *s)),
        with_commented_enrichment(
            f""", {_after(*_sets)} select response_id,
            array_to_string(themes, '|') as themes from after"""
        ),
    )
_REPEATS = """doubled as (select * replace (
      case when response_id % 3 = 0 and themes is not null then list_concat(themes, themes) else themes end as themes) from enrichment)"""


def _repeated(t):
    """Enrichment whose lists name every theme twice in some rows."""
    twice = F.when(F.col("response_id") % 3 == 0, F.concat("themes", "themes"))
    return t.enrichment.withColumn("themes", F.coalesce(twice, "themes"))


add(
    "reclassify_repeats", "MAP-1 Q22",
    lambda t: _flat(mapping.reclassify(_repeated(t), t.commented, *ALL_RULES)),
    with_commented_enrichment(
        f""", {_REPEATS}, {_after(*ALL_RULES, source="doubled")} select response_id,
        array_to_string(themes, '|') as themes from after"""
    ),
)
add(
    "reclassify_by_summary", "MAP-2",
    lambda t: _flat(mapping.reclassify_by_summary(t.enrichment)),
    with_enrichment(
        f"""select response_id, case when list_contains(themes, 'overige') and ("""
        + " or ".join(f"lower(summary) like '%{w}%'" for w in ref.CONTENT_SUMMARY_WORDS)
        + ") then 'content_kwaliteit' else array_to_string(themes, '|') end as themes from enrichment"
    ),
)
add(
    "reclassification_report", "MAP-3 THM-20",
    lambda t: mapping.reclassification_report(
        t.enrichment, mapping.reclassify(t.enrichment, t.commented, *ALL_RULES)
    ),
    with_commented_enrichment(
        f""", {_after(*ALL_RULES)},
        b as (select u.t as theme, count(*) as n from enrichment e, unnest(e.themes) as u(t) group by 1),
        a as (select u.t as theme, count(*) as n from after e, unnest(list_distinct(e.themes)) as u(t) group by 1),
        both_sides as (select coalesce(b.theme, a.theme) as theme, coalesce(b.n, 0) as mentions_before,
          coalesce(a.n, 0) as mentions_after from b full outer join a on a.theme = b.theme)
        select *, mentions_after - mentions_before as difference,
          {percent('mentions_before', '(select sum(n) from b)')} as pct_before,
          {percent('mentions_after', '(select sum(n) from a)')} as pct_after from both_sides"""
    ),
)

# -------------------------------------------------------------- mapping SQL

_PATTERNS = values(
    "patterns", "position, pattern, main, sub",
    [(i, *row) for i, row in enumerate(ref.theme_patterns())],
)
_FAMILIES = values(
    "families", "position, main, sub, keyword",
    [(i, m, s, w) for i, (m, s, ws) in enumerate(ref.THEME_KEYWORD_FAMILIES) for w in ws],
)
_COLOURS = values("colours", "main, color", [(n, c) for n, c, _, _ in ref.MAIN_CATEGORIES])


def _mapped(source):
    """CTEs that map the themes of ``source`` (theme, ...) to ``mapped``."""
    return f"""{_PATTERNS}, {_FAMILIES}, {_COLOURS},
      keyed as (select *, trim(lower(theme)) as name from {source}),
      exact as (select k.theme, p.main, p.sub from keyed k join patterns p on p.pattern = k.name),
      partial as (select k.theme, arg_min(p.main, p.position) as main, arg_min(p.sub, p.position) as sub
        from keyed k join patterns p on p.pattern <> 'overige'
          and (contains(k.name, p.pattern) or contains(p.pattern, k.name)) group by k.theme),
      family as (select k.theme, arg_min(f.main, f.position) as main, arg_min(f.sub, f.position) as sub
        from keyed k join families f on contains(k.name, f.keyword) group by k.theme),
      mapped as (select k.* exclude (name),
          case when coalesce(k.theme, '') = '' then 'Other'
            else coalesce(e.main, p.main, f.main, 'Other') end as main_category,
          case when coalesce(k.theme, '') = '' then 'Unknown'
            else coalesce(e.sub, p.sub, f.sub, 'Uncategorized') end as sub_category,
          cast(case when coalesce(k.theme, '') = '' then 0 when e.main is not null then 0.95
            when p.main is not null then 0.75 when f.main is not null then 0.8 else 0.1 end as double) as confidence,
          case when coalesce(k.theme, '') = '' then 'fallback' when coalesce(e.main, p.main, f.main) is null
            then 'fallback' else 'pattern' end as source
        from keyed k left join exact e on e.theme = k.theme
          left join partial p on p.theme = k.theme left join family f on f.theme = k.theme)"""


LISTED = f"a as ({THEME_AGGREGATE})"
MAPPED = f", {LISTED}, {_mapped('a')}"


def _word_themes(t):
    """Distinct words of the part types and names, a vocabulary to map."""
    parts = bindings.table(t.spark, t.sf_dir, "part")
    ws = F.split(F.concat_ws(" ", "p_name", "p_type", "p_brand"), " ")
    return parts.select(F.explode(ws).alias("theme")).distinct()


add(
    "theme_mapping", "MAP-4 MAP-7 Q12",
    lambda t: mapping.map_themes(
        themes.vocabulary(t.enrichment).unionByName(t.listing.select("theme")).distinct()
    ),
    with_mentions(
        f""", v as (select distinct raw_theme as theme from mentions
            union select distinct theme from mentions
            union select u.t from enrichment e, unnest(e.themes) as u(t)), {_mapped('v')}
        select m.*, c.color from mapped m join colours c on c.main = m.main_category"""
    ),
)
add(
    "theme_mapping_words", "MAP-4",
    lambda t: mapping.map_themes(_word_themes(t)).drop("color"),
    f"""with v as (select distinct unnest(string_split(p_name || ' ' || p_type || ' ' || p_brand, ' ')) as theme
        from part), {_mapped('v')} select * from mapped""",
)
_H = f"""select main_category, sub_category, cast(sum(count_responses) as bigint) as count,
  count(*) as themes,
  {ratio('sum(cast(round(avg_nps * 10) as bigint) * count_responses)', 'sum(count_responses) * 10', 2)} as avg_nps,
  {ratio('sum(cast(round(coalesce(avg_sentiment, 0) * 1000) as bigint) * count_responses)', 'sum(count_responses) * 1000', 3)} as sentiment,
  first(theme order by count_responses desc, theme) as top_theme
  from mapped group by all"""
add("theme_hierarchy", "MAP-5 Q4", lambda t: mapping.hierarchy(t.listing), with_mentions(f"{MAPPED} {_H}"))
add(
    "theme_hierarchy_members", "MAP-5",
    lambda t: mapping.hierarchy_members(t.listing),
    with_mentions(f"{MAPPED} select * from mapped"),
)


def _folded(t):
    f = mapping.hierarchy_folded(t.listing)
    return f.select(
        "main_category", "sub_category", "count",
        F.round("avg_nps", 6).alias("avg_nps"), F.round("sentiment", 6).alias("sentiment"),
    )


add(
    "theme_hierarchy_folded", "MAP-5 Q4",
    _folded,
    with_mentions(
        f"""{MAPPED} select main_category, sub_category, cast(sum(count_responses) as bigint) as count,
        round(list_reduce(list_prepend(0.0::double, list(avg_nps order by count_responses desc, theme)),
          lambda acc, x: (acc + x) / 2), 6) as avg_nps,
        round(list_reduce(list_prepend(0.0::double, list(coalesce(avg_sentiment, 0) order by count_responses desc, theme)),
          lambda acc, x: (acc + x) / 2), 6) as sentiment
        from mapped group by all"""
    ),
)
add(
    "theme_top_sub_themes", "MAP-6",
    lambda t: mapping.top_sub_themes(t.listing),
    with_mentions(
        f"""{MAPPED}, h as ({_H}) select main_category, sub_category, count,
        {percent('count', '(select sum(count_responses) from a)')} as share_pct
        from h where main_category <> 'Other' order by count desc, main_category, sub_category limit 3"""
    ),
)

# ---------------------------------------------------------- category tables

_MAINS = values("mains", "name, color, sort_order, description", ref.MAIN_CATEGORIES)
_SUBS = values("subs", "main, name, sort_order, description", ref.SUB_CATEGORIES)
_TABLE = f"""{MAPPED}, {_MAINS}, {_SUBS},
  hierarchy as (select theme as original_theme, main_category, sub_category, confidence, source,
    count_responses as response_count, cast(avg_nps as decimal(4,2)) as avg_nps from mapped)"""
_DETAIL = """select h.*, m.name as main_category_display, m.color as main_category_color,
  s.name as sub_category_display, s.description as sub_category_description
  from hierarchy h left join mains m on m.name = h.main_category
  left join subs s on s.main = m.name and s.name = h.sub_category"""


def _doubles(df):
    return df.withColumns(
        {c: F.col(c).cast("double") for c in ("confidence", "avg_nps") if c in df.columns}
    )


def _table(t):
    return mapping.build_hierarchy(t.listing)


add(
    "hierarchy_table", "MAP-15",
    lambda t: _doubles(_table(t)),
    with_mentions(f"{_TABLE} select * replace (cast(avg_nps as double) as avg_nps) from hierarchy"),
)
add(
    "hierarchy_detail", "MAP-8 JN-5 MAP-14 ING-19",
    lambda t: _doubles(
        mapping.hierarchy_detail(
            _table(t), mapping.main_categories(t.spark),
            mapping.seed_sub_categories(
                mapping.main_categories(t.spark), mapping.sub_categories(t.spark)
            ),
        )
    ),
    with_mentions(f"{_TABLE}, d as ({_DETAIL}) select * replace (cast(avg_nps as double) as avg_nps) from d"),
)
_STATS = f"""select main_category, sub_category, main_category_display, main_category_color,
  sub_category_display, count(*) as total_themes, cast(sum(response_count) as bigint) as total_responses,
  {ratio('sum(cast(avg_nps * 100 as bigint))', 'count(avg_nps) * 100', 4)} as avg_nps,
  {ratio('sum(cast(round(confidence * 100) as bigint))', 'count(*) * 100', 4)} as avg_confidence,
  count(*) filter (where source = 'pattern') as pattern_mapped,
  count(*) filter (where source = 'ai') as ai_mapped,
  count(*) filter (where source = 'fallback') as fallback_mapped
  from ({_DETAIL}) group by all"""


def _stats(t):
    return mapping.hierarchy_stats(
        _table(t), mapping.main_categories(t.spark), mapping.sub_categories(t.spark)
    )


add("hierarchy_stats", "MAP-9", _stats, with_mentions(f"{_TABLE} {_STATS}"))
add(
    "hierarchy_lookup", "MAP-10",
    lambda t: _doubles(mapping.lookup_mapping(_table(t), "pricing")),
    with_mentions(
        f"""{_TABLE} select main_category, sub_category, confidence, source from hierarchy
        where original_theme = 'pricing' limit 1"""
    ),
)
add(
    "hierarchy_listing", "MAP-11",
    lambda t: _doubles(mapping.hierarchical_listing(_table(t))),
    with_mentions(
        f"""{_TABLE} select main_category, sub_category, original_theme as theme_name, response_count,
        cast(avg_nps as double) as avg_nps, confidence, source from hierarchy"""
    ),
)


def _static(t):
    s = mapping.static_hierarchy(t.spark)
    return _doubles(
        t.listing.select("theme", "count_responses").join(
            s.withColumnRenamed("theme_name", "theme"), "theme"
        )
    )


add(
    "hierarchy_static", "MAP-12 ING-19",
    _static,
    with_mentions(
        f""", {LISTED}, {values('static', 'theme, main_category, sub_category, confidence, source, response_count, avg_nps',
            [(a, b, c, float(d), e, f, float(g)) for a, b, c, d, e, f, g in ref.STATIC_THEME_MAPPING])}
        select s.* replace (cast(confidence as double) as confidence, cast(s.avg_nps as double) as avg_nps),
          a.count_responses from static s join a on a.theme = s.theme"""
    ),
)


def _rollup_sql(keys):
    return with_mentions(
        f"""{_TABLE} select {keys}, count(*) as themes, cast(sum(response_count) as bigint) as total_responses,
        {ratio('sum(cast(coalesce(avg_nps, 0) * 100 as bigint))', 'count(*) * 100', 2)} as avg_nps
        from hierarchy group by {keys}"""
    )


add(
    "hierarchy_rollup_main", "MAP-13",
    lambda t: mapping.hierarchy_rollup(_table(t)), _rollup_sql("main_category"),
)
add(
    "hierarchy_rollup_sub", "MAP-13",
    lambda t: mapping.hierarchy_rollup(_table(t), by_sub=True),
    _rollup_sql("main_category, sub_category"),
)
add(
    "hierarchy_stats_rollup", "MAP-13",
    lambda t: mapping.stats_rollup(_stats(t)),
    with_mentions(
        f"""{_TABLE}, st as ({_STATS}) select main_category, count(*) as sub_categories,
        cast(sum(total_themes) as bigint) as total_themes, cast(sum(total_responses) as bigint) as total_responses,
        {ratio('sum(cast(round(coalesce(avg_nps, 0) * 10000) as bigint))', 'count(*) * 10000', 2)} as avg_nps,
        {ratio('sum(cast(round(coalesce(avg_confidence, 0) * 10000) as bigint))', 'count(*) * 10000', 2)} as avg_confidence,
        cast(sum(pattern_mapped) as bigint) as pattern_mapped, cast(sum(ai_mapped) as bigint) as ai_mapped,
        cast(sum(fallback_mapped) as bigint) as fallback_mapped from st group by main_category"""
    ),
)


def _seed(t):
    """Observed themes as seed rows against a dictionary that holds some already."""
    seed = t.listing.select(F.col("theme").alias("synonym"), F.col("theme").alias("canonical"))
    present = t.spark.createDataFrame(
        [(s,) for s, _ in ref.synonym_pairs()], "synonym string"
    )
    return mapping.seed_if_absent(present, seed, ["synonym"])


add(
    "seed_if_absent", "ING-20",
    _seed,
    with_mentions(
        """select distinct theme as synonym, theme as canonical from mentions
        where theme not in (select synonym from synonyms)"""
    ),
)
