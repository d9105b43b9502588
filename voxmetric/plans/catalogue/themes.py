"""Theme metrics."""

from pyspark.sql import functions as F

from ...functions import scores
from ...operators import browse, nps, text, themes
from ...sources import reference_data as ref
from .. import bindings
from .base import (
    D, HUNDREDTHS, P, PSD, S, THEME_AGGREGATE, add, mean_score, net, percent, ratio, values,
    with_commented_mentions, with_enrichment, with_mentions, words,
)

RANGE = "creation_date between date '1996-01-01' and date '1998-12-31'"
YEARS = {"start": "1996-01-01", "end": "1998-12-31"}
BASE = words(ref.BASE_THEMES)

add(
    "theme_rows_raw", "THM-1 JN-2 JN-3",
    lambda t: themes.assignments(t.responses, t.enrichment, raw=True).select(
        "response_id", "creation_date", "survey_name", "title_text", "nps_score",
        F.col("sentiment_score").cast("double").alias("sentiment_score"), "theme", "hits",
    ),
    with_mentions(
        """select response_id, creation_date, survey_name, title_text, nps_score,
        cast(sentiment_score as double) as sentiment_score, raw_theme as theme,
        cast(count(*) as int) as hits from mentions group by all"""
    ),
)
add(
    "theme_rows_canonical", "THM-2 CLN-14 JN-4",
    lambda t: t.assignments.select("response_id", "theme", "hits", "title_text", "nps_score"),
    with_mentions(
        """select response_id, theme, cast(count(*) as int) as hits, title_text, nps_score
        from mentions group by all"""
    ),
)


def _dictionary(t):
    synonyms = t.spark.createDataFrame(ref.synonym_pairs(), "synonym string, canonical string")
    rows = themes.assignments_with_dictionary(t.responses, t.enrichment, synonyms)
    return rows.groupBy("theme").agg(
        F.sum("hits").alias("mentions"), F.count(F.lit(1)).alias("responses"),
        F.count_if("lead").alias("leads"),
    )


add(
    "theme_rows_synonym_table", "THM-2 JN-4",
    lambda t: _dictionary(t).drop("leads"),
    with_mentions(
        """select theme, count(*) as mentions, count(distinct response_id) as responses
        from mentions group by theme"""
    ),
)

# Overview with tail collapse. Tail metrics are means of per-theme metrics
# held to nine decimals.
_METRICS = {
    "pct_promoters": ("p", "mentions", 1),
    "pct_passives": ("s", "mentions", 1),
    "pct_detractors": ("d", "mentions", 1),
    "pct_pos_sentiment": ("pos", "mentions", 1),
    "pct_neg_sentiment": ("neg", "mentions", 1),
    "avg_sentiment": ("mood", "moods", 100),
    "avg_nps": ("score", "mentions", 1),
}
_PER_THEME = f"""per_theme as (
  select theme, count(*) as mentions, {P} as p, {S} as s, {D} as d,
    count(*) filter (where sentiment_score > 0) as pos,
    count(*) filter (where sentiment_score < 0) as neg,
    coalesce(sum({HUNDREDTHS}), 0) as mood, count(sentiment_score) as moods,
    sum(nps_score) as score from mentions group by theme)"""


def _overview_sql(k):
    head = ", ".join(
        f"{ratio(n, f'{d} * {m}', 4)} as {out}" for out, (n, d, m) in _METRICS.items()
    )
    nine = ", ".join(
        f"cast(round({ratio(n, f'{d} * {m}', 9)} * 1000000000) as bigint) as {out}"
        for out, (n, d, m) in _METRICS.items()
    )
    tail = ", ".join(
        f"{ratio(f'sum({out})', f'count({out}) * 1000000000', 4)} as {out}" for out in _METRICS
    )
    return f""", {_PER_THEME}
      select theme, mentions, {head} from per_theme where mentions >= {k}
      union all
      select 'Other (cluster)', cast(sum(mentions) as bigint), {tail} from
        (select mentions, {nine} from per_theme where mentions < {k}) having count(*) > 0"""


add(
    "theme_overview", "THM-3 THM-4 SET-2 SRT-7",
    lambda t: themes.overview(t.assignments, min_mentions=3),
    with_mentions(_overview_sql(3)),
)
add(
    "theme_overview_k5", "THM-4",
    lambda t: themes.overview(t.assignments, min_mentions=5),
    with_mentions(_overview_sql(5)),
)
add(
    "theme_overview_all", "THM-3",
    lambda t: themes.overview(t.assignments, min_mentions=None),
    with_mentions(
        f", {_PER_THEME} select theme, mentions, "
        + ", ".join(f"{ratio(n, f'{d} * {m}', 4)} as {o}" for o, (n, d, m) in _METRICS.items())
        + " from per_theme"
    ),
)
add(
    "theme_tail_breakdown", "THM-5",
    lambda t: themes.tail_breakdown(t.assignments),
    with_mentions("select theme, count(*) as mentions from mentions group by theme having count(*) < 3"),
)
add(
    "theme_overview_counts", "THM-6",
    lambda t: themes.overview_counts(t.assignments),
    with_mentions(
        f"""select theme, count(*) as mentions, {mean_score(1)} as avg_nps, {PSD},
        {percent(P, 'count(*)')} as pct_promoters, {percent(S, 'count(*)')} as pct_passives,
        {percent(D, 'count(*)')} as pct_detractors from mentions group by theme"""
    ),
)


def _aggregate_sql(where):
    body = THEME_AGGREGATE.replace("from mentions", f"from mentions where {where}")
    return with_mentions(
        f""", a as ({body}) select theme, count_responses,
        {percent('count_responses', '(select sum(count_responses) from a)')} as share_pct,
        avg_sentiment, avg_nps from a"""
    )


add(
    "theme_aggregate", "THM-7 JN-6 Q3",
    lambda t: themes.aggregate(t.assignments),
    _aggregate_sql("true"),
)
add(
    "theme_aggregate_filtered", "THM-7 FLT-1 FLT-2 FLT-5",
    lambda t: themes.aggregate(
        t.assignments, **YEARS, survey="3-MEDIUM", title="NATION_4", bucket="detractor"
    ),
    _aggregate_sql(
        """created_at >= date '1996-01-01' and created_at < date '1999-01-01'
        and survey_name = '3-MEDIUM' and title_text = 'NATION_4' and nps_score <= 6"""
    ),
)
add(
    "theme_aggregate_raw", "THM-7 THM-1",
    lambda t: themes.aggregate(
        themes.assignments(t.responses, t.enrichment, raw=True), bucket="promoter"
    ),
    with_mentions(
        f""", a as (select raw_theme as theme, count(distinct response_id) as count_responses,
          {ratio(f'sum({HUNDREDTHS})', 'count(sentiment_score) * 100', 3)} as avg_sentiment,
          {mean_score(1)} as avg_nps from mentions where nps_score >= 9 group by raw_theme)
        select theme, count_responses,
        {percent('count_responses', '(select sum(count_responses) from a)')} as share_pct,
        avg_sentiment, avg_nps from a"""
    ),
)
add(
    "theme_promoter_detractor", "THM-8",
    lambda t: themes.promoter_detractor(t.assignments, **YEARS),
    with_mentions(
        """select theme, count(distinct case when nps_score >= 9 then response_id end) as promoters,
        count(distinct case when nps_score <= 6 then response_id end) as detractors
        from mentions where created_at >= date '1996-01-01' and created_at < date '1999-01-01'
        group by theme"""
    ),
)
add(
    "theme_sentiment_by_survey", "THM-9",
    lambda t: themes.sentiment_by_survey(
        themes.assignments(t.responses, t.enrichment, raw=True)
    ),
    with_mentions(
        f"""select survey_name, raw_theme as theme, count(*) as theme_count,
        {ratio(f'sum({HUNDREDTHS})', 'count(sentiment_score) * 100', 3)} as avg_sentiment,
        count(*) filter (where sentiment_label = 'positive') as positive_count,
        count(*) filter (where sentiment_label = 'negative') as negative_count,
        count(*) filter (where sentiment_label = 'neutral') as neutral_count
        from mentions where processing_status = 'completed' group by all"""
    ),
)


def _top_sql(count, theme, where):
    return with_mentions(
        f""", a as (select {theme} as theme, {count} as n, count(*) as m,
          coalesce(sum({HUNDREDTHS}), 0) as mood, sum(nps_score) as score, {PSD}
          from mentions where {where} group by {theme})
        select theme, n as count_responses,
          {percent('n', '(select sum(n) from a)', 2)} as share_pct,
          {ratio('mood', 'm * 100', 3)} as avg_sentiment, {ratio('score', 'm', 2)} as avg_nps,
          promoters, detractors from a order by n desc, theme limit 10"""
    )


add(
    "theme_top_mentions", "THM-10",
    lambda t: themes.top_themes(themes.assignments(t.responses, t.enrichment, raw=True)),
    _top_sql("count(*)", "raw_theme", "true"),
)
add(
    "theme_top_responses", "THM-11",
    lambda t: themes.top_themes(
        themes.assignments(t.responses, t.enrichment, raw=True),
        distinct_responses=True, title="NATION_9", **YEARS,
    ),
    _top_sql("count(distinct response_id)", "raw_theme", f"title_text = 'NATION_9' and {RANGE}"),
)


def _list_sql(where, with_metrics):
    metrics = f""", coalesce({ratio('p * 100', 'm', 0)}, 0.0) as pct_promoters,
      coalesce({ratio('s * 100', 'm', 0)}, 0.0) as pct_passives,
      coalesce({ratio('d * 100', 'm', 0)}, 0.0) as pct_detractors,
      coalesce({ratio('pos * 100', 'm', 0)}, 0.0) as pct_pos_sentiment,
      coalesce({ratio('neg * 100', 'm', 0)}, 0.0) as pct_neg_sentiment,
      coalesce({ratio('mood', 'moods * 100', 2)}, 0.0) as avg_sentiment,
      coalesce({ratio('score', 'm', 1)}, 0.0) as avg_nps"""
    agg = f"""select theme, count(*) as m, {P} as p, {S} as s, {D} as d,
      count(*) filter (where sentiment_score > 0) as pos,
      count(*) filter (where sentiment_score < 0) as neg,
      coalesce(sum({HUNDREDTHS}), 0) as mood, count(sentiment_score) as moods,
      sum(nps_score) as score from mentions"""
    base = f"""theme, m as count_responses,
      {percent('m', '(select sum(m) from kept)')} as share_pct,
      {ratio('m', '(select sum(m) from kept)', 6)} as frequency,
      case when theme in ({BASE}) then 'base' else 'ai' end as source,
      case when m >= 100 then 'high' when m < 10 then 'low' else 'medium' end as business_relevance,
      case when theme in ({BASE}) then 1.0::double else 0.8::double end as confidence"""
    if with_metrics:
        return with_mentions(
            f", kept as ({agg} where {where} group by theme) select {base}{metrics} from kept"
        )
    return with_mentions(
        f""", kept as ({agg} where {where} group by theme),
        whole as (select theme{metrics} from ({agg} group by theme having count(*) >= 3))
        select l.*, w.* exclude (theme) from (select {base} from kept) l
        join whole w on w.theme = l.theme"""
    )


add(
    "theme_list", "THM-12 THM-13 THM-14 Q7",
    lambda t: themes.theme_list(t.assignments, title="NATION_1", **YEARS),
    _list_sql(f"title_text = 'NATION_1' and {RANGE}", True),
)
add(
    "theme_list_global_metrics", "THM-12 JN-13",
    lambda t: themes.theme_list(t.assignments, global_metrics=True, survey="5-LOW"),
    _list_sql("survey_name = '5-LOW'", False),
)

KPIS = f"""select coalesce({net(2)}, 0.0) as current_nps, count(*) as total_responses, {PSD},
  coalesce({mean_score(2)}, 0.0) as avg_score from mentions"""
add(
    "theme_kpis", "THM-15",
    lambda t: themes.theme_kpis(
        themes.assignments(t.responses, t.enrichment, theme="pricing"), "pricing", **YEARS
    ),
    with_mentions(f"{KPIS} where theme = 'pricing' and {RANGE}"),
)
add(
    "theme_titles", "THM-16",
    lambda t: themes.theme_titles(
        themes.assignments(t.responses, t.enrichment, theme="bezorging"), "bezorging", **YEARS
    ),
    with_mentions(
        f"""select title_text as title, count(*) as total, {PSD}, {net()} as nps,
        {mean_score(2)} as avg_score from mentions where theme = 'bezorging' and {RANGE}
        group by title_text order by total desc, title nulls last limit 10"""
    ),
)


def _title_theme_sql(high, medium):
    rel = (
        f"case when n >= {high} then 'high' when n < {medium} then 'low' else 'medium' end"
        if medium
        else f"case when n >= {high} then 'high' else 'low' end"
    )
    return with_mentions(
        f"""select theme, n as title_mentions, promoters, passives, detractors, nps, avg_score,
        case when score >= 7 * n then 0.5::double when score >= 5 * n then 0.0::double
          else -0.5::double end as avg_sentiment,
        case when theme in ({words(ref.TITLE_BASE_THEMES)}) then 'base' else 'ai' end as source,
        {rel} as business_relevance
        from (select theme, count(*) as n, {PSD}, {net()} as nps, {mean_score(2)} as avg_score,
          sum(nps_score) as score from mentions where title_text = 'NATION_8' and {RANGE}
          group by theme order by n desc, theme limit 10)"""
    )


add(
    "title_themes", "THM-17 CLN-19",
    lambda t: themes.title_themes(t.assignments, "NATION_8", **YEARS),
    _title_theme_sql(5, 3),
)
add(
    "title_themes_two_classes", "THM-17 THM-13",
    lambda t: themes.title_themes(t.assignments, "NATION_8", high=5, medium=None, **YEARS),
    _title_theme_sql(5, None),
)
add(
    "theme_counts_from_percentages", "THM-18",
    lambda t: themes.counts_from_percentages(themes.overview(t.assignments, min_mentions=3)),
    with_mentions(
        f""", o as (select * from ({_overview_sql(3).replace(', per_theme as', 'with per_theme as', 1)}))
        select theme,
        cast({ratio('cast(round(pct_promoters * 10000) as bigint) * mentions', '10000', 0)} as bigint) as promoters,
        cast({ratio('cast(round(pct_detractors * 10000) as bigint) * mentions', '10000', 0)} as bigint) as detractors
        from o"""
    ),
)
add(
    "theme_share_sparklines", "THM-19 Q18",
    lambda t: themes.share_sparklines(t.assignments, **YEARS),
    with_mentions(
        f""", top as (select theme from mentions group by theme order by count(*) desc, theme limit 5),
        kept as (select *, strftime(creation_date, '%Y-%m') as month from mentions where {RANGE}),
        totals as (select month, count(distinct response_id) as n from kept group by month)
        select top.theme, t.month,
          {percent('(select count(distinct response_id) from kept k where k.month = t.month and k.theme = top.theme)', 't.n', 2)} as share_pct
        from totals t, top"""
    ),
)
add(
    "theme_distribution", "THM-20",
    lambda t: themes.distribution(t.assignments, k=15),
    with_mentions(
        f"""select theme, n as mentions, {percent('n', '(select count(*) from mentions)')} as percentage
        from (select theme, count(*) as n from mentions group by theme order by n desc, theme limit 15)"""
    ),
)
add(
    "theme_share_of_enrichment", "THM-21",
    lambda t: themes.share_of_enrichment(t.enrichment),
    with_enrichment(
        f"""select 'overige' as theme, n as mentions,
        {percent('n', '(select count(*) from enrichment)')} as percentage
        from (select count(*) as n from enrichment e, unnest(e.themes) as u(t) where u.t = 'overige')"""
    ),
)
add(
    "theme_vocabulary", "THM-22",
    lambda t: themes.vocabulary(t.enrichment),
    with_enrichment("select distinct u.t as theme from enrichment e, unnest(e.themes) as u(t)"),
)

_RULES = values(
    "rules", "position, category, keyword",
    [(i, c, w) for i, (c, ws) in enumerate(ref.BUSINESS_CATEGORY_RULES) for w in ws],
)
_ORDER = values("category_order", "category, position", [(c, i + 1) for i, c in enumerate(ref.BUSINESS_CATEGORY_ORDER)])
add(
    "theme_category_summary", "THM-23",
    lambda t: themes.category_summary(t.listing),
    with_mentions(
        f""", a as ({THEME_AGGREGATE}), {_RULES}, {_ORDER},
        placed as (select a.*, coalesce((select arg_min(r.category, r.position) from rules r
          where contains(lower(a.theme), r.keyword)), 'Other') as category from a)
        select p.category, any_value(o.position)::int as position, count(*) as total_themes,
          cast(sum(count_responses) as bigint) as total_responses,
          {ratio('sum(cast(round(avg_nps * 10) as bigint))', 'count(*) * 10', 2)} as avg_nps,
          {ratio('sum(cast(round(coalesce(avg_sentiment, 0) * 100) as bigint))', 'count(*) * 100', 3)} as avg_sentiment,
          first(theme order by count_responses desc, theme) as top_theme
        from placed p join category_order o on o.category = p.category group by p.category"""
    ),
)
add(
    "theme_listing_counts", "THM-24",
    lambda t: themes.listing_counts(themes.theme_list(t.assignments)),
    with_mentions(
        f"""select count(*) as themes, count(*) filter (where theme in ({BASE})) as base_themes,
        count(*) filter (where theme not in ({BASE})) as ai_themes,
        count(*) filter (where n >= 100) as high_relevance,
        count(*) filter (where n between 10 and 99) as medium_relevance,
        count(*) filter (where n < 10) as low_relevance
        from (select theme, count(*) as n from mentions group by theme)"""
    ),
)
add(
    "theme_sample_quotes", "THM-25",
    lambda t: themes.sample_quotes(t.referenced_assignments, comments=t.with_comments),
    with_commented_mentions(
        """select * from (select theme, bucket, creation_date, response_id, quote,
          cast(row_number() over (partition by theme, bucket
            order by creation_date desc, response_id) as int) as rank
          from (select distinct theme,
            case when nps_score >= 9 then 'promoter' when nps_score <= 6 then 'detractor' end as bucket,
            creation_date, response_id, nps_explanation as quote
            from mentions where nps_explanation <> '') where bucket is not null) where rank <= 3"""
    ),
)
add(
    "theme_array_sets", "THM-26",
    lambda t: themes.array_sets(t.enrichment).select(
        bindings.joined("themes").alias("themes"), "count"
    ),
    with_enrichment(
        """select array_to_string(themes, '|') as themes, count(*) as count from enrichment
        where list_contains(themes, 'overige') group by all"""
    ),
)
add(
    "theme_samples", "SRT-5",
    lambda t: browse.theme_samples(
        themes.assignments(t.commented, t.enrichment, theme="merkvertrouwen"),
        "merkvertrouwen", title="NATION_6",
    ),
    with_commented_mentions(
        """select distinct response_id, nps_score, nps_explanation, title_text, creation_date
        from mentions where theme = 'merkvertrouwen' and title_text = 'NATION_6'
          and nps_explanation is not null order by creation_date desc, response_id limit 5"""
    ),
)
add(
    "theme_extremes", "SRT-6",
    lambda t: browse.theme_extremes(
        themes.assignments(t.commented, t.enrichment, theme="app_ux"), "app_ux", **YEARS
    ),
    with_commented_mentions(
        f"""select * from (select *, cast(row_number() over (partition by bucket
            order by creation_date desc, response_id) as int) as rank
          from (select distinct response_id, nps_score, nps_explanation, creation_date,
            case when nps_score >= 9 then 'promoter' else 'detractor' end as bucket
            from mentions where theme = 'app_ux' and nps_explanation <> ''
              and (nps_score >= 9 or nps_score <= 6) and {RANGE})) where rank <= 5"""
    ),
)


def _findings(t):
    rows = themes.assignments(t.commented, t.enrichment, theme="pricing")
    return nps.impact_findings(
        themes.theme_kpis(rows, "pricing"),
        themes.theme_titles(rows, "pricing"),
        text.key_words(rows.filter(F.col("title_text") == "NATION_3")),
    )


add(
    "theme_impact_findings", "AGG-16",
    _findings,
    with_commented_mentions(
        f""", k as (select {net()} as net, {percent(D, 'count(*)')} as share, {D} as d,
          count(*) as n from mentions where theme = 'pricing'),
        w as (select word, count(*) as n from (select unnest(regexp_split_to_array(
            regexp_replace(lower(nps_explanation), '[.,!?;:()\\[\\]]', ' ', 'g'), '\\s+')) as word
          from (select distinct response_id, nps_explanation from mentions
            where theme = 'pricing' and title_text = 'NATION_3'))
          where length(word) > 3 and word not in ({words(ref.DUTCH_STOP_WORDS)})
            and not regexp_matches(word, '^[0-9]+$')
          group by word order by n desc, word limit 3)
        select 'impact' as type, printf('%.1f', share) || '%' as subject, d as measure from k
          where d * 100 > n * 50
        union all select 'nps', printf('%.1f', net), d from k where net < 0
        union all select 'scope', * from (select title_text, count(*) from mentions
          where theme = 'pricing' group by title_text order by 2 desc, 1 limit 1)
        union all select 'content', string_agg(word, ', ' order by n desc, word),
          cast(sum(n) as bigint) from w"""
    ),
)
