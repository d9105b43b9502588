"""Trends, movement and stability."""

from pyspark.sql import functions as F

from ...operators import nps, themes, trends
from .base import (
    D, P, PSD, S, add, mean_score, net, percent, ratio, with_mentions, with_responses,
)

SURVEYS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
END = "2001-07-31"
MONTH = "cast(date_trunc('month', creation_date) as date)"
TENTHS = f"cast(round({net(1)} * 10) as bigint)"


def _series(where="true"):
    """Month series per title with tenths of a point and the previous month."""
    return f""", series as (select *, lag(tenths) over w as prev, lag(responses) over w as prev_n
      from (select {MONTH} as month, title_text as title, count(*) as responses, {TENTHS} as tenths
        from responses where {where} group by all)
      window w as (partition by title order by month))"""


add(
    "monthly_rows", "WIN-1 CLN-22",
    lambda t: trends.monthly(t.responses),
    with_responses(
        f"select {MONTH} as month, title_text as title, survey_name as survey_type, nps_score from responses"
    ),
)
add(
    "trend_by_title", "WIN-2 FLT-3 CLN-3",
    lambda t: trends.trend_by_title(t.responses, start="1996-02-15", end="1999-03-10", survey="1-URGENT"),
    with_responses(
        f"""select {MONTH} as month, title_text as title, count(*) as responses, {PSD}, {net(1)} as nps
        from responses where creation_date between date '1996-02-01' and date '1999-03-31'
          and survey_name = '1-URGENT' group by all"""
    ),
)
add(
    "trend_by_title_change", "WIN-3",
    lambda t: trends.trend_by_title_with_change(t.responses),
    with_responses(
        f"""{_series()} select month, title, responses, tenths / 10.0::double as nps,
        (tenths - prev) / 10.0::double as mom_delta from series"""
    ),
)
_LATEST = """latest as (select * from series where month = (select max(month) from series)
  and responses >= 5 and prev is not null)"""
add(
    "top_title_moves", "WIN-4 JN-7 SET-1",
    lambda t: trends.top_title_moves(t.responses, end=END, min_responses=5),
    with_responses(
        f"""{_series(f"creation_date <= date '{END}'")}, {_LATEST},
        shown as (select month, title, responses, tenths / 10.0::double as nps,
          (tenths - prev) / 10.0::double as mom_delta from latest)
        select *, 'up' as move from (from shown order by mom_delta desc, responses desc, title nulls last limit 5)
        union all
        select *, 'down' as move from (from shown order by mom_delta, responses desc, title nulls last limit 5)"""
    ),
)
add(
    "title_movers", "WIN-5",
    lambda t: trends.title_movers(t.responses, end=END, min_responses=5, top_k=8),
    with_responses(
        f"""{_series(f"creation_date <= date '{END}'")}, {_LATEST}
        select title as title_text, tenths / 10.0::double as current_nps, prev / 10.0::double as previous_nps,
          (tenths - prev) / 10.0::double as delta, responses as current_responses, prev_n as previous_responses
        from latest order by abs(tenths - prev) desc, responses desc, title nulls last limit 8"""
    ),
)
add(
    "title_moves_latest_months", "WIN-6 JN-9",
    lambda t: trends.title_moves_between_latest_months(t.responses, end=END, min_responses=5, top_k=10),
    with_responses(
        f""", m as (select coalesce(title_text, 'Unknown') as title_text, {MONTH} as month,
            cast(round({net(2)} * 100) as bigint) as net, count(*) as n
          from responses where creation_date <= date '{END}' group by title_text, 2 having count(*) >= 5),
        cur as (from m where month = (select max(month) from m)),
        prv as (from m where month = (select max(month) from m where month < (select max(month) from m)))
        select c.title_text, c.net / 100.0::double as current_nps, coalesce(p.net, 0) / 100.0::double as previous_nps,
          (c.net - coalesce(p.net, 0)) / 100.0::double as mom_delta, c.n as current_responses,
          coalesce(p.n, 0) as previous_responses
        from cur c left join prv p on p.title_text = c.title_text
        order by mom_delta desc, title_text limit 10"""
    ),
)
add(
    "theme_share_change", "WIN-7 JN-8",
    lambda t: trends.theme_share_change(t.assignments, "NATION_11"),
    with_mentions(
        f""", c as (select {MONTH} as month, theme, count(distinct response_id) as n
          from mentions where title_text = 'NATION_11' group by all),
        s as (select month, theme, n, cast(round({ratio('n * 100', 'sum(n) over (partition by month)', 2)} * 100) as bigint) as cents from c)
        select month, theme, n as count_responses, cents / 100.0::double as share_pct,
          (cents - lag(cents) over (partition by theme order by month)) / 100.0::double as mom_share_delta from s"""
    ),
)
add(
    "theme_share_change_survey", "WIN-7",
    lambda t: trends.theme_share_change(
        themes.assignments(t.responses, t.enrichment, raw=True), "NATION_2", "2-HIGH", "created_at"
    ),
    with_mentions(
        f""", c as (select cast(date_trunc('month', created_at) as date) as month, raw_theme as theme,
            count(distinct response_id) as n
          from mentions where title_text = 'NATION_2' and survey_name = '2-HIGH' group by all),
        s as (select month, theme, n, cast(round({ratio('n * 100', 'sum(n) over (partition by month)', 2)} * 100) as bigint) as cents from c)
        select month, theme, n as count_responses, cents / 100.0::double as share_pct,
          (cents - lag(cents) over (partition by theme order by month)) / 100.0::double as mom_share_delta from s"""
    ),
)


def _monthly_sql(digits, keys, where="true"):
    names = ", survey_name" if keys else ""
    return with_responses(
        f"""select strftime(creation_date, '%Y-%m') as month{names}, {net(digits)} as nps_score,
        count(*) as total_responses, {PSD} from responses where {where} group by 1{names}"""
    )


add("trend_monthly", "WIN-8", lambda t: trends.monthly_trend(t.responses), _monthly_sql(2, False))
add(
    "trend_monthly_filtered", "WIN-9 Q13 Q19",
    lambda t: trends.monthly_trend(
        t.responses, digits=1, start="1997-01-01", end="1997-12-31", title="NATION_10"
    ),
    _monthly_sql(
        1, False,
        "creation_date between date '1997-01-01' and date '1997-12-31' and title_text = 'NATION_10'",
    ),
)
add(
    "trend_by_survey", "WIN-10",
    lambda t: trends.monthly_trend(t.responses, digits=1, by_survey=True),
    _monthly_sql(1, True),
)
add(
    "trend_survey_pivot", "WIN-11",
    lambda t: trends.survey_pivot(t.responses, SURVEYS),
    with_responses(
        "select strftime(creation_date, '%Y-%m') as month, "
        + ", ".join(
            f"""{ratio(f"(count(*) filter (where nps_score >= 9 and survey_name = '{s}') - count(*) filter (where nps_score <= 6 and survey_name = '{s}')) * 100", f"count(*) filter (where survey_name = '{s}')", 1)} as "{s}" """
            for s in SURVEYS
        )
        + " from responses group by 1"
    ),
)
add(
    "title_trend", "WIN-12",
    lambda t: trends.title_trend(t.responses, "NATION_0"),
    with_responses(
        f"""select strftime(creation_date, '%Y-%m') as month, {mean_score(2)} as avg_score,
        count(*) as responses, {PSD} from responses where title_text = 'NATION_0' group by 1"""
    ),
)
add(
    "trend_direction", "WIN-13",
    lambda t: trends.trend_direction(t.responses, end=END),
    with_responses(
        f""", m as (select {MONTH} as month, {TENTHS} as v from responses
          where creation_date <= date '{END}' group by 1)
        select f / 10.0::double as first_nps, l / 10.0::double as last_nps,
          case when l > f then 'up' when l < f then 'down' else 'flat' end as direction,
          {ratio('s', 'n * 10', 2)} as mean_nps, n as months
        from (select arg_min(v, month) as f, arg_max(v, month) as l, sum(v) as s, count(*) as n from m)"""
    ),
)
add(
    "trend_true_counts", "WIN-14",
    lambda t: trends.counts_by_month(t.responses, survey="3-MEDIUM"),
    with_responses(
        f"""select {MONTH} as month, count(*) as responses, {P} as promoters, {D} as detractors
        from responses where survey_name = '3-MEDIUM' group by 1"""
    ),
)
add(
    "trend_rebuilt_counts", "WIN-14",
    lambda t: trends.approximate_counts(trends.trend_by_title(t.responses)),
    with_responses(
        f"""select month, cast(sum(n) as bigint) as responses,
        cast(sum({ratio('n * (v + 1000)', '2000', 0)}) as bigint) as promoters,
        cast(sum({ratio('n * (1000 - v)', '2000', 0)}) as bigint) as detractors
        from (select {MONTH} as month, title_text, count(*) as n, {TENTHS} as v
          from responses group by all) group by month"""
    ),
)
add(
    "trend_top_titles", "WIN-15",
    lambda t: trends.top_title_trends(t.responses),
    with_responses(
        f""", top as (select title_text as title, count(*) as title_total from responses
          where title_text is not null group by 1 order by 2 desc, 1 limit 6)
        select {MONTH} as month, r.title_text as title, count(*) as responses, {net(1)} as nps,
          any_value(title_total) as title_total
        from responses r join top on top.title = r.title_text group by all"""
    ),
)
add(
    "month_coverage", "WIN-17",
    lambda t: trends.month_coverage(t.responses),
    with_responses(
        f""", m as (select {MONTH} as month, count(*) as responses, count(distinct title_text) as titles
          from responses group by 1)
        select *, case when month = (select max(month) from m) then 'LATEST'
          when month = (select max(month) from m) - interval 1 month then 'PREVIOUS' end as label from m"""
    ),
)
add(
    "weekly_stability", "WIN-18 CLN-23",
    lambda t: trends.weekly_stability(t.visits, as_of="2024-01-31"),
    """select case when count(*) > 1 then round(stddev_pop(m), 6) end as wow_stddev, count(*) as weeks,
        cast(sum(n) as bigint) as total_n from (
      select cast(ts as date) - cast(dayofweek(ts) as int) as week, count(*) as n,
        cast(sum((event_id * 7 + user_id) % 11) as double) / count(*) as m from events
      where cast(ts as date) >= timestamp '2024-01-31' - interval 84 days group by 1)""",
)
add(
    "weekly_stability_orders", "WIN-18",
    lambda t: trends.weekly_stability(t.responses, as_of="2001-08-01"),
    with_responses(
        """select case when count(*) > 1 then round(stddev_pop(m), 6) end as wow_stddev, count(*) as weeks,
        cast(sum(n) as bigint) as total_n from (
      select creation_date - cast(dayofweek(creation_date) as int) as week, count(*) as n,
        cast(sum(nps_score) as double) / count(*) as m from responses
      where creation_date >= timestamp '2001-08-01' - interval 84 days group by 1)"""
    ),
)
