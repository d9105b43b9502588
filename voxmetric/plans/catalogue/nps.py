"""Score metrics, filters and browsing."""

from pyspark.sql import functions as F

from ...functions import cleaning, scores
from ...operators import browse, filters, nps, rollup, themes
from .. import bindings
from .base import (
    D, P, PSD, S, add, mean_score, net, percent, ratio, stamp, with_commented,
    with_commented_enrichment, with_enrichment, with_mentions, with_responses,
)

METRICS = f"{net()} as nps_score, count(*) as total_responses, {PSD}"

add(
    "score_class", "CLN-1 CLN-20",
    lambda t: t.responses.select(
        "id", scores.category(F.col("nps_score")).alias("nps_category"),
        *scores.flags(F.col("nps_score")),
    ),
    with_responses(
        """select id, nps_category, nps_score >= 9 as promoter_flag,
        nps_score between 7 and 8 as passive_flag, nps_score <= 6 as detractor_flag
        from responses"""
    ),
)
add(
    "nps_summary", "AGG-1 AGG-2 CLN-2",
    lambda t: nps.summary(t.responses),
    with_responses(
        f"select count(*) as total_responses, {net()} as nps_score, {PSD}, "
        f"{mean_score(1)} as avg_score from responses"
    ),
)
add(
    "nps_survey_metrics", "AGG-3",
    lambda t: nps.survey_metrics(t.responses),
    with_responses(
        f"""select survey_name, count(*) as total_responses, {PSD},
        {mean_score(2)} as average_score, {net()} as nps_score,
        min(creation_date) as first_response, max(creation_date) as last_response
        from responses group by survey_name"""
    ),
)
add(
    "nps_survey_metrics_one", "AGG-3 Q19",
    lambda t: nps.survey_metrics(t.responses, survey="2-HIGH"),
    with_responses(
        f"""select survey_name, count(*) as total_responses, {PSD},
        {mean_score(2)} as average_score, {net()} as nps_score,
        min(creation_date) as first_response, max(creation_date) as last_response
        from responses where survey_name = '2-HIGH' group by survey_name"""
    ),
)
add(
    "nps_by_survey", "AGG-4",
    lambda t: nps.by_survey(t.responses),
    with_responses(f"select survey_name, {METRICS} from responses group by survey_name"),
)
add(
    "nps_by_title", "AGG-5 FLT-12 CLN-12",
    lambda t: nps.by_title(t.responses),
    with_responses(
        f"""select coalesce(title_text, 'Unknown') as title_text, {METRICS}
        from responses group by title_text having count(*) >= 10"""
    ),
)
add(
    "nps_by_known_title", "AGG-5",
    lambda t: nps.by_title(t.responses, min_responses=30, include_unknown=False),
    with_responses(
        f"""select title_text, {METRICS} from responses where title_text is not null
        group by title_text having count(*) >= 30"""
    ),
)
add(
    "nps_demographics", "AGG-6",
    lambda t: nps.demographics(t.responses),
    with_responses(
        f"""select survey_name, gender, age_range, years_employed,
        count(*) as response_count, {mean_score(2)} as avg_score, {net()} as nps_score
        from responses group by all"""
    ),
)
add(
    "nps_daily_trend", "AGG-7",
    lambda t: nps.daily_trend(t.responses),
    with_responses(
        f"""select survey_name, creation_date, count(*) as daily_responses,
        {P} as daily_promoters, {S} as daily_passives, {D} as daily_detractors,
        {mean_score(2)} as daily_avg_score, {net()} as daily_nps_score
        from responses group by all"""
    ),
)


def _daily_rollup(t):
    r = rollup.daily_rollup(t.responses, t.enrichment)

    def flat(c):
        return F.array_join(
            F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"], e["value"])), ","
        ).alias(c)

    return r.select(
        "survey_name", "rollup_date", "total_responses", "promoters", "passives",
        "detractors", "nps_score", flat("gender_breakdown"), flat("age_breakdown"),
        flat("employment_breakdown"), flat("sentiment_distribution"),
        F.array_join(
            F.transform("top_themes", lambda x: F.concat_ws("=", x["theme"], x["mentions"])), ","
        ).alias("top_themes"),
    )


def _breakdown(source: str, value: str, out: str) -> str:
    return f"""(select survey_name, creation_date,
      string_agg(v || '=' || n, ',' order by v) as {out}
      from (select survey_name, creation_date, {value} as v, count(*) as n from {source}
            group by all) group by all)"""


add(
    "nps_daily_rollup", "AGG-8",
    _daily_rollup,
    with_mentions(
        f""", moods as (select r.survey_name, r.creation_date, e.sentiment_label
          from responses r join enrichment e on e.response_id = r.id),
        theme_days as (select survey_name, creation_date, theme,
          count(distinct response_id) as n from mentions group by all),
        top_days as (select survey_name, creation_date,
          string_agg(theme || '=' || n, ',' order by n desc, theme) as top_themes
          from (select *, row_number() over (partition by survey_name, creation_date
            order by n desc, theme) as rn from theme_days) where rn <= 5 group by all)
        select b.*, g.gender_breakdown, a.age_breakdown, y.employment_breakdown,
          coalesce(m.sentiment_distribution, '') as sentiment_distribution,
          coalesce(t.top_themes, '') as top_themes
        from (select survey_name, creation_date as rollup_date, {METRICS}
              from responses group by all) b
        join {_breakdown('responses', "coalesce(gender, 'Unknown')", 'gender_breakdown')} g
          on g.survey_name = b.survey_name and g.creation_date = b.rollup_date
        join {_breakdown('responses', 'age_range', 'age_breakdown')} a
          on a.survey_name = b.survey_name and a.creation_date = b.rollup_date
        join {_breakdown('responses', 'years_employed', 'employment_breakdown')} y
          on y.survey_name = b.survey_name and y.creation_date = b.rollup_date
        left join {_breakdown('moods', 'sentiment_label', 'sentiment_distribution')} m
          on m.survey_name = b.survey_name and m.creation_date = b.rollup_date
        left join top_days t
          on t.survey_name = b.survey_name and t.creation_date = b.rollup_date"""
    ),
)

KPI_SQL = f"""select {net(1)} as nps, count(*) as responses, {PSD},
  coalesce({mean_score(2)}, 0.0) as avg_score from responses"""
add(
    "nps_kpis_filtered", "AGG-9 FLT-1 FLT-4",
    lambda t: nps.kpis(
        t.responses, start="1997-01-01", end="1998-06-30", survey="1-URGENT", title="NATION_3"
    ),
    with_responses(
        KPI_SQL + """ where creation_date between date '1997-01-01' and date '1998-06-30'
        and survey_name = '1-URGENT' and title_text = 'NATION_3'"""
    ),
)
add(
    "nps_kpis_empty", "AGG-9 CLN-2",
    lambda t: nps.kpis(t.responses, survey="no such survey"),
    with_responses(KPI_SQL + " where survey_name = 'no such survey'"),
)
add(
    "nps_kpis_promoters", "FLT-5",
    lambda t: nps.kpis(t.responses, bucket="passive", title="NATION_7"),
    with_responses(KPI_SQL + " where nps_score between 7 and 8 and title_text = 'NATION_7'"),
)
add(
    "nps_period_change", "AGG-10",
    lambda t: nps.period_change(t.responses, "2001-07-20"),
    with_responses(
        f"""select
          coalesce({ratio('(dc * np - dp * nc) * 100', 'abs(dp) * nc', 4)}, 0.0) as nps_change,
          coalesce({ratio('(nc - np) * 100', 'np', 4)}, 0.0) as responses_change,
          coalesce({ratio('(pc - pp) * 100', 'pp', 4)}, 0.0) as promoters_change,
          coalesce({ratio('(xc - xp) * 100', 'xp', 4)}, 0.0) as detractors_change
        from (select nc, np, pc, pp, xc, xp, pc - xc as dc, pp - xp as dp from (select
          count(*) filter (where m = 7) as nc, count(*) filter (where m = 6) as np,
          count(*) filter (where m = 7 and nps_score >= 9) as pc,
          count(*) filter (where m = 6 and nps_score >= 9) as pp,
          count(*) filter (where m = 7 and nps_score <= 6) as xc,
          count(*) filter (where m = 6 and nps_score <= 6) as xp
          from (select *, month(creation_date) as m from responses
            where creation_date between date '2001-06-01' and date '2001-07-20')))"""
    ),
)
BOARD = f"""select title_text as title, count(*) as responses, {PSD}, {net(1)} as nps,
  {mean_score(2)} as avg_score from responses where title_text is not null"""
add(
    "title_leaderboard", "AGG-11",
    lambda t: nps.title_leaderboard(t.responses),
    with_responses(BOARD + " group by title_text"),
)
add(
    "title_leaderboard_by_score", "AGG-12",
    lambda t: nps.title_leaderboard(
        t.responses, min_responses=10, by="nps", start="1996-01-01", end="1996-12-31"
    ),
    with_responses(
        BOARD + """ and creation_date between date '1996-01-01' and date '1996-12-31'
        group by title_text having count(*) >= 10"""
    ),
)
add(
    "nps_category_shares", "AGG-13",
    lambda t: nps.category_shares(t.responses, "survey_name"),
    with_responses(
        f"""select survey_name, count(*) as total_responses,
        {percent(P, 'count(*)')} as pct_promoters, {percent(S, 'count(*)')} as pct_passives,
        {percent(D, 'count(*)')} as pct_detractors from responses group by survey_name"""
    ),
)
add(
    "filter_options_title", "AGG-14 SET-4",
    lambda t: nps.filter_options(t.responses, "title_text"),
    with_responses("select distinct title_text as option from responses where title_text is not null"),
)
add(
    "filter_options_survey", "AGG-14",
    lambda t: nps.filter_options(t.responses, "survey_name"),
    with_responses("select distinct survey_name as option from responses"),
)


def _priority(t):
    s = nps.category_shares(t.responses, "title_text")
    m = nps.by_title(t.responses, min_responses=1).select("title_text", "nps_score")
    return (
        s.select(cleaning.or_unknown(F.col("title_text")).alias("title_text"), "pct_detractors")
        .join(m, "title_text")
        .select(
            "title_text", "nps_score", "pct_detractors",
            scores.priority_level(F.col("nps_score"), F.col("pct_detractors")).alias("priority"),
        )
    )


add(
    "title_priority", "AGG-15",
    _priority,
    with_responses(
        f"""select *, case when nps_score < -20 or pct_detractors > 60 then 'critical'
          when nps_score < 0 or pct_detractors > 40 then 'high'
          when nps_score < 20 or pct_detractors > 25 then 'medium' else 'low' end as priority
        from (select coalesce(title_text, 'Unknown') as title_text, {net()} as nps_score,
          {percent(D, 'count(*)')} as pct_detractors from responses group by title_text)"""
    ),
)
add(
    "month_week_year_keys", "CLN-22 CLN-23 CLN-24",
    lambda t: t.responses.select(
        "id",
        cleaning.month_text(F.col("creation_date")).alias("month_text"),
        cleaning.month_start(F.col("creation_date")).alias("month_start"),
        cleaning.week_start_sunday(F.col("creation_date")).alias("week_start"),
        F.year("creation_date").cast("bigint").alias("year"),
    ),
    with_responses(
        """select id, strftime(creation_date, '%Y-%m') as month_text,
        cast(date_trunc('month', creation_date) as date) as month_start,
        cast(creation_date - cast(dayofweek(creation_date) as int) as date) as week_start,
        year(creation_date) as year from responses"""
    ),
)

# ----------------------------------------------------------------- filters

add(
    "filter_end_day_on_timestamp", "FLT-2 Q21",
    lambda t: filters.apply_filters(
        t.responses, start="1998-03-01", end="1998-03-31", date_col="created_at"
    ).select("id", "creation_date"),
    with_responses(
        """select id, creation_date from responses
        where created_at >= date '1998-03-01' and created_at < date '1998-04-01'"""
    ),
)
add(
    "filter_whole_months", "FLT-3",
    lambda t: filters.month_range(t.responses, "1998-02-10", "1998-03-05").select("id", "creation_date"),
    with_responses(
        """select id, creation_date from responses where date_trunc('month', creation_date)
        between date '1998-02-01' and date '1998-03-01'"""
    ),
)
add(
    "filter_text_search", "FLT-6",
    lambda t: filters.text_search(t.commented, "BEZORGING").select("id", "nps_score"),
    with_commented("select id, nps_score from commented where nps_explanation ilike '%bezorging%'"),
)
add(
    "filter_has_theme", "FLT-7 ARR-1",
    lambda t: filters.has_theme(t.enrichment, "overige").select(
        "response_id", F.size("themes").alias("n_themes")
    ),
    with_enrichment(
        """select response_id, cast(len(themes) as int) as n_themes from enrichment
        where list_contains(themes, 'overige')"""
    ),
)
add(
    "filter_comment_classes", "FLT-8 FLT-9 FLT-11",
    lambda t: t.commented.agg(
        F.count_if(filters.is_verbatim(F.col("nps_explanation"))).alias("verbatim"),
        F.count_if(filters.has_comment(F.col("nps_explanation"))).alias("commented"),
        F.count_if(filters.is_long_text(F.col("nps_explanation"))).alias("long_text"),
    ),
    with_commented(
        """select
        count(*) filter (where length(trim(nps_explanation)) > 2
          and not contains(lower(nps_explanation), 'n.v.t.')
          and not contains(lower(nps_explanation), 'nvt')) as verbatim,
        count(*) filter (where nps_explanation <> '') as commented,
        count(*) filter (where length(trim(nps_explanation)) > 10) as long_text
        from commented"""
    ),
)
add(
    "filter_trailing_days", "FLT-10",
    lambda t: filters.trailing(t.responses, "created_at", "2001-07-31 12:00:00", 30).select("id"),
    with_responses(
        """select id from responses
        where created_at >= timestamp '2001-07-31 12:00:00' - interval 30 days"""
    ),
)

# ---------------------------------------------------------------- browsing

add(
    "recent_responses", "SRT-1",
    lambda t: browse.recent(t.commented, 25).withColumn("created_at", bindings.string_stamp("created_at")),
    with_commented(
        f"""select id, nps_score, nps_explanation, survey_name,
        coalesce(title_text, 'Unknown') as title_text, nps_category, creation_date,
        {stamp('created_at')} as created_at
        from (select * from commented order by created_at desc, id limit 25)"""
    ),
)
add(
    "last_days_with_enrichment", "SRT-2 JN-1 ING-18",
    lambda t: browse.last_days(t.responses, t.enrichment, "2001-07-31", 30).select(
        "id", "nps_score", bindings.joined("themes").alias("themes"), "sentiment_label", "summary",
        bindings.joined("keywords").alias("keywords"),
    ),
    with_enrichment(
        """select r.id, r.nps_score, array_to_string(e.themes, '|') as themes,
        e.sentiment_label, e.summary, array_to_string(e.keywords, '|') as keywords
        from responses r left join enrichment e on e.response_id = r.id
        where r.created_at >= timestamp '2001-07-31' - interval 30 days"""
    ),
)
add(
    "response_summary", "JN-1 ING-17",
    lambda t: browse.summary_rows(t.responses, t.enrichment).select(
        "id", "survey_name", "nps_score", "nps_category",
        bindings.joined("themes").alias("themes"),
        F.col("sentiment_score").cast("double").alias("sentiment_score"),
        "sentiment_label", "processing_status",
    ),
    with_enrichment(
        """select r.id, r.survey_name, r.nps_score, r.nps_category,
        array_to_string(e.themes, '|') as themes,
        cast(e.sentiment_score as double) as sentiment_score, e.sentiment_label,
        e.processing_status
        from responses r left join enrichment e on e.response_id = r.id"""
    ),
)
add(
    "response_page", "SRT-3 FLT-5 FLT-6",
    lambda t: browse.page(
        t.commented, t.enrichment, search="Klantenservice", bucket="detractor",
        start="1996-01-01", end="2000-12-31", limit=20, offset=10,
    ).select(
        "id", bindings.string_stamp("created_at").alias("created_at"), "title_text", "nps_score",
        "nps_explanation", bindings.joined("themes").alias("themes"), "sentiment_label",
    ),
    with_commented_enrichment(
        f"""select r.id, {stamp('r.created_at')} as created_at, r.title_text, r.nps_score,
        r.nps_explanation, array_to_string(e.themes, '|') as themes, e.sentiment_label
        from (select * from commented where nps_explanation ilike '%klantenservice%'
          and nps_score <= 6 and created_at >= date '1996-01-01' and created_at < date '2001-01-01'
          order by created_at desc, id limit 20 offset 10) r
        left join enrichment e on e.response_id = r.id"""
    ),
)
add(
    "response_page_by_theme", "SRT-3 FLT-7",
    lambda t: browse.page(t.commented, t.enrichment, theme="overige", title="NATION_5", limit=15).select(
        "id", "nps_score", bindings.joined("themes").alias("themes")
    ),
    with_enrichment(
        """select r.id, r.nps_score, array_to_string(e.themes, '|') as themes
        from responses r join enrichment e on e.response_id = r.id
        where list_contains(e.themes, 'overige') and r.title_text = 'NATION_5'
        order by r.created_at desc, r.id limit 15"""
    ),
)
add(
    "unenriched_batch", "SRT-4 JN-10",
    lambda t: browse.unenriched_batch(t.referenced, t.enrichment, 40, last=500, comments=t.with_comments).select(
        "id", F.length("nps_explanation").alias("n_chars")
    ),
    with_commented_enrichment(
        """select id, cast(length(nps_explanation) as int) as n_chars from commented r
        where nps_explanation is not null and id > 500
          and not exists (select 1 from enrichment e where e.response_id = r.id)
        order by id limit 40"""
    ),
)
add(
    "title_samples", "SRT-5",
    lambda t: browse.samples(t.commented, title="NATION_2", start="1997-01-01", end="1999-12-31"),
    with_commented(
        """select id, nps_score, nps_explanation, creation_date, title_text from commented
        where title_text = 'NATION_2' and nps_explanation <> ''
          and creation_date between date '1997-01-01' and date '1999-12-31'
        order by creation_date desc, id limit 10"""
    ),
)
