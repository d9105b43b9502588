"""Coverage, profiles, constraints, repair and audit."""

from pyspark.sql import functions as F

from ...operators import audit, quality
from .. import bindings
from .base import (
    D, P, add, net, percent, quote, ratio, stamp, with_commented, with_commented_enrichment,
    with_enrichment, with_mentions, with_responses,
)

add(
    "data_coverage", "DQ-1",
    lambda t: quality.data_coverage(t.commented, t.enrichment, start="1996-01-01", end="2001-12-31"),
    with_commented_enrichment(
        f""", c as (select count(*) as n, count(nps_explanation) as m from commented
          where creation_date between date '1996-01-01' and date '2001-12-31'),
        e as (select count(*) as n from enrichment where themes is not null and sentiment_score is not null)
        select c.n as total, {percent('c.m', 'c.n', 0)} as with_comments_pct,
          {percent('e.n', 'c.m', 0)} as enriched_pct from c, e"""
    ),
)
add(
    "enrichment_coverage", "DQ-1",
    lambda t: quality.enrichment_coverage(t.commented, t.enrichment).withColumn(
        "last_run", bindings.string_stamp("last_run")
    ),
    with_commented_enrichment(
        f""", c as (select count(*) as n, count(*) filter (where nps_explanation <> '') as m from commented),
        e as (select count(*) as n, max(created_at) as last from enrichment)
        select c.n as total_responses, c.m as responses_with_comments, e.n as enriched_responses,
          {percent('e.n', 'c.m', 0)} as enrichment_percentage, {stamp('e.last')} as last_run from c, e"""
    ),
)
add(
    "title_coverage", "DQ-2",
    lambda t: quality.title_coverage(t.commented, t.enrichment, start="1996-01-01", end="1999-12-31"),
    with_commented_enrichment(
        f""", x as (select r.title_text as title, count(*) as total,
            count(*) filter (where r.nps_explanation <> '') as with_comments,
            count(distinct e.response_id) as enriched
          from commented r left join enrichment e on e.response_id = r.id
          where r.creation_date between date '1996-01-01' and date '1999-12-31' group by 1)
        select *, {percent('with_comments', 'total')} as pct_with_comments,
          {percent('enriched', 'with_comments')} as pct_enriched from x"""
    ),
)
add(
    "enrichment_stats", "DQ-3",
    lambda t: quality.enrichment_stats(t.commented, t.enrichment).withColumn(
        "last_enrichment", bindings.string_stamp("last_enrichment")
    ),
    with_commented_enrichment(
        f""", c as (select count(*) as n, count(*) filter (where nps_explanation <> '') as m from commented),
        v as (select count(distinct u.t) as n from enrichment e, unnest(e.themes) as u(t)),
        e as (select count(*) as n, {ratio('sum(cast(sentiment_score * 100 as bigint))', 'count(sentiment_score) * 100', 3)} as s,
          max(created_at) as last from enrichment)
        select c.n as total_responses, e.n as enriched_responses, greatest(0, c.m - e.n) as pending_responses,
          v.n as themes_found, e.s as avg_sentiment, {stamp('e.last')} as last_enrichment from c, v, e"""
    ),
)
for _unit, _fmt in (("year", "%Y"), ("month", "%Y-%m")):
    add(
        f"counts_per_{_unit}", "DQ-4 DQ-5 CLN-24",
        lambda t, u=_unit: quality.period_counts(t.responses, u),
        with_responses(
            f"select strftime(creation_date, '{_fmt}') as period, count(*) as responses from responses group by 1"
        ),
    )
add(
    "newest_dates", "DQ-4",
    lambda t: quality.newest_dates(t.responses),
    with_responses(
        """select id, creation_date, title_text, survey_name from responses
        order by creation_date desc, id limit 10"""
    ),
)
add(
    "date_span", "DQ-5",
    lambda t: quality.date_span(t.responses),
    with_responses(
        "select min(creation_date) as earliest, max(creation_date) as latest, count(creation_date) as dated from responses"
    ),
)
add(
    "column_date_coverage", "DQ-6 SET-3",
    lambda t: quality.column_date_coverage(
        t.responses.withColumn("title_date", F.when(F.col("title_text").isNotNull(), F.col("creation_date"))),
        ["creation_date", "created_at", "title_date"],
    ),
    with_responses(
        """select 'creation_date' as column_name, min(creation_date) as earliest, max(creation_date) as latest,
          count(creation_date) as non_null from responses
        union all select 'created_at', cast(min(created_at) as date), cast(max(created_at) as date), count(created_at) from responses
        union all select 'title_date', min(creation_date), max(creation_date), count(*) from responses
          where title_text is not null"""
    ),
)
_TEXT_COLUMNS = {"o_orderstatus": "string", "o_orderpriority": "string", "stamp": "string", "o_orderkey": "bigint"}


def _profile(t):
    o = bindings.table(t.spark, t.sf_dir, "orders").select(
        "o_orderkey", "o_orderstatus", "o_orderpriority",
        F.when(
            F.col("o_orderkey") % 3 != 0,
            F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"),
        ).alias("stamp"),
    )
    return quality.field_profile(o)


add(
    "field_profile", "DQ-7",
    _profile,
    "with o as (select o_orderkey, o_orderstatus, o_orderpriority, case when o_orderkey % 3 <> 0 "
    "then strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') end as stamp from orders) "
    + " union all ".join(
        f"select '{c}' as column_name, '{ty}' as data_type, count({c}) as non_null, "
        + (
            f"count(*) filter (where contains({c}, '-') and contains({c}, 'T'))"
            if ty == "string" else "0::bigint"
        )
        + " as date_like from o"
        for c, ty in _TEXT_COLUMNS.items()
    ),
)
add(
    "title_counts", "DQ-8",
    lambda t: quality.title_counts(t.responses),
    with_responses(
        "select title_text, count(*) as responses from responses group by 1 order by 2 desc, 1 nulls last limit 10"
    ),
)
add(
    "title_theme_check", "DQ-8",
    lambda t: quality.title_theme_check(t.responses, t.assignments, min_mentions=3),
    with_mentions(
        f""", tails as (select theme from mentions group by theme having count(*) < 3),
        m as (select title_text, count(*) as n, count(*) filter (where theme in (select theme from tails)) as tail
          from mentions group by 1),
        r as (select title_text, count(*) as n from responses group by 1)
        select r.title_text as title, r.n as responses, coalesce(m.n, 0) as mentions,
          coalesce(m.n, 0) - r.n as difference, {percent('coalesce(m.tail, 0)', 'r.n')} as tail_pct
        from r left join m on m.title_text is not distinct from r.title_text"""
    ),
)


def _broken(t):
    """Responses with faults sprinkled in."""
    key = F.col("id")
    return t.responses.withColumns(
        {
            "nps_score": F.when(key % 97 == 0, 12).when(key % 89 == 0, F.lit(None)).otherwise(F.col("nps_score")),
            "nps_category": F.when(key % 83 == 0, "fan").otherwise(F.col("nps_category")),
        }
    )


_BROKEN = """broken as (select * replace (
    case when id % 97 = 0 then 12 when id % 89 = 0 then null else nps_score end as nps_score,
    case when id % 83 = 0 then 'fan' else nps_category end as nps_category) from responses)"""
_CLASS = "case when nps_score >= 9 then 'promoter' when nps_score >= 7 then 'passive' when nps_score is not null then 'detractor' end"
_CHECKS = {
    "score_missing": "nps_score is null",
    "score_range": "nps_score not between 0 and 10",
    "category_values": "nps_category not in ('promoter', 'passive', 'detractor')",
    "category_matches_score": f"nps_category is distinct from {_CLASS}",
    "survey_missing": "survey_name is null",
    "date_missing": "creation_date is null",
}
add(
    "response_checks", "DQ-9 CLN-5",
    lambda t: quality.check_report(_broken(t), quality.response_rules()),
    with_responses(
        f", {_BROKEN} "
        + " union all ".join(
            f"select '{n}' as rule, count(*) filter (where {c}) as violations, count(*) as checked from broken"
            for n, c in _CHECKS.items()
        )
    ),
)
_E_CHECKS = {
    "response_missing": "response_id is null",
    "status_values": "processing_status not in ('pending', 'processing', 'completed', 'failed')",
    "sentiment_range": "abs(sentiment_score) > 1",
    "label_values": "sentiment_label not in ('positive', 'negative', 'neutral')",
    "confidence_range": "confidence not between 0 and 1",
}
add(
    "enrichment_checks", "DQ-9",
    lambda t: quality.check_report(
        t.enrichment.withColumn("confidence", F.col("confidence") * 1.5), quality.enrichment_rules()
    ),
    with_enrichment(
        ", e as (select * replace (confidence * 1.5::double as confidence) from enrichment) "
        + " union all ".join(
            f"select '{n}' as rule, count(*) filter (where {c}) as violations, count(*) as checked from e"
            for n, c in _E_CHECKS.items()
        )
    ).replace("with ", "with ", 1),
)
_VERSIONS = """versions as (select case when l_partkey % 10 = 0 then -l_orderkey - 1 else l_orderkey end as response_id,
  l_orderkey * 1000000 + l_partkey * 10 + l_linenumber as row_id, cast(l_quantity as int) as version,
  l_shipdate as created_at from lineitem)"""


def _versions(t):
    return bindings.enrichment_versions(t.spark, t.sf_dir)


add(
    "duplicate_keys", "DQ-9",
    lambda t: quality.duplicate_keys(_versions(t), ["response_id"], "enrichment_response"),
    f"""with {_VERSIONS} select 'enrichment_response' as rule, count(*) as duplicate_keys,
      cast(sum(n - 1) as bigint) as surplus_rows
      from (select count(*) as n from versions group by response_id having count(*) > 1)""",
)
add(
    "orphan_rows", "DQ-9 JN-11",
    lambda t: quality.orphans(_versions(t), t.responses, "response_id", "id").select("row_id", "response_id"),
    f"with {_VERSIONS} select row_id, response_id from versions where response_id not in (select o_orderkey from orders)",
)
add(
    "newest_enrichment", "WIN-16",
    lambda t: quality.newest_per_key(_versions(t), "response_id", "created_at", "row_id").select(
        "response_id", "row_id", "version"
    ),
    f"""with {_VERSIONS} select response_id, row_id, version from (select *, row_number() over (
      partition by response_id order by created_at desc, row_id desc) as rn from versions) where rn = 1""",
)
add(
    "repaired_enrichment", "DQ-10 JN-11 WIN-16",
    lambda t: quality.repair_enrichment(_versions(t), t.responses, "row_id").select(
        "response_id", "row_id", "version"
    ),
    f"""with {_VERSIONS} select response_id, row_id, version from (select *, row_number() over (
      partition by response_id order by created_at desc, row_id desc) as rn from versions
      where response_id in (select o_orderkey from orders)) where rn = 1""",
)


def _upsert(t):
    rows = quality.newest_per_key(_versions(t), "response_id", "created_at", "row_id")
    current = rows.filter(F.col("version") < 30)
    incoming = rows.filter((F.col("version") % 2) == 0).withColumn("version", F.col("version") + 100)
    return quality.upsert(current, incoming, "response_id", t.responses).select(
        "response_id", "row_id", "version"
    )


def _upsert_repeats(t):
    """Every incoming key comes three times; the newest version of it wins."""
    rows = quality.newest_per_key(_versions(t), "response_id", "created_at", "row_id")
    current = rows.filter(F.col("version") < 30)
    times = F.explode(F.array(*[F.lit(x) for x in (200, 300, 100)])).alias("plus")
    incoming = rows.filter((F.col("version") % 2) == 0).select("*", times)
    incoming = incoming.withColumn("version", F.col("version") + F.col("plus")).drop("plus")
    return quality.upsert(current, incoming, "response_id", t.responses, newest=["version"]).select(
        "response_id", "row_id", "version"
    )


_UPSERTED = f"""with {_VERSIONS}, n as (select * from (select *, row_number() over (
        partition by response_id order by created_at desc, row_id desc) as rn from versions) where rn = 1),
      incoming as (select * from n where version % 2 = 0 and response_id in (select o_orderkey from orders))
      select response_id, row_id, version + 300 as version from incoming
      union all select response_id, row_id, version from n
        where version < 30 and response_id not in (select response_id from incoming)"""
add("upsert_repeated_keys", "DQ-11", _upsert_repeats, _UPSERTED)
add(
    "upsert_enrichment", "DQ-11 JN-11",
    _upsert,
    f"""with {_VERSIONS}, n as (select * from (select *, row_number() over (
        partition by response_id order by created_at desc, row_id desc) as rn from versions) where rn = 1),
      incoming as (select * from n where version % 2 = 0 and response_id in (select o_orderkey from orders))
      select response_id, row_id, version + 100 as version from incoming
      union all select response_id, row_id, version from n
        where version < 30 and response_id not in (select response_id from incoming)""",
)

# --------------------------------------------------------------------- audit


def _inputs(t):
    return audit.audit_inputs(
        t.visits, "2024-01-31", date_col="creation_date", user_col="user_id", invites=5000,
        segment_col="event_type", completion_col="value", have_events=True, have_devices=True,
    )


_Q = "cast(ts as date) >= timestamp '2024-01-31' - interval 90 days"
_M = "cast(ts as date) >= timestamp '2024-01-31' - interval 30 days"
_VISITS = f"""visits as (select *, (event_id * 7 + user_id) % 11 as nps_score,
    case when event_id % 3 <> 0 then 'value ' || props end as nps_explanation,
    case event_type when 'click' then 'in_app' when 'view' then 'in_app' when 'purchase' then 'email'
      when 'signup' then 'web' else 'sms' end as channel from events),
  q as (select count(*) as total_responses, count(nps_explanation) as verbatim,
    count(*) filter (where channel = 'in_app') as in_app, count(*) filter (where channel = 'email') as email,
    {P} as promoters, {D} as detractors, avg(value) as completion_time from visits where {_Q}),
  m as (select count(*) as responses_30d from visits where {_M}),
  f as (select count(*) as fatigued from (select user_id from visits where {_M} group by 1 having count(*) >= 2)),
  g as (select count(*) as low from (select event_type from visits where {_Q} group by 1
    having count(*) * 100 < (select total_responses from q) * 10)),
  wk as (select case when count(*) > 1 then round(stddev_pop(a), 6) end as sd, cast(sum(n) as bigint) as n from
    (select cast(ts as date) - cast(dayofweek(ts) as int) as w, count(*) as n, cast(sum(nps_score) as double) / count(*) as a
     from visits where cast(ts as date) >= timestamp '2024-01-31' - interval 84 days group by 1))"""


def _case(value, good, fair, op):
    return f"case when {value} {op} {good} then 'pass' when {value} {op} {fair} then 'warn' else 'fail' end"


_NET = ratio("(promoters - detractors) * 100", "total_responses", 1)
_RULES = f"""rules(key, title, category, status, metric) as (
  select 'response_rate', 'Response Rate (30 days)', 'data_quality', {_case('responses_30d / 5000', '0.20', '0.10', '>=')},
    printf('%.1f%%', {percent('responses_30d', '5000')}) from m
  union all select 'verbatim_share', 'Verbatim Comment Rate (90 days)', 'data_quality',
    {_case('verbatim / total_responses', '0.55', '0.35', '>=')}, printf('%.1f%%', {percent('verbatim', 'total_responses')}) from q
  union all select 'fatigue', 'Survey Fatigue (30 days)', 'strategy', {_case('fatigued', '0', '5', '<=')},
    fatigued || ' users ≥2 surveys' from f
  union all select 'channel_mix', 'Channel Mix', 'strategy', {_case('in_app / total_responses', '0.5', '0.3', '>=')},
    printf('In-app %.0f%%, Email %.0f%%', {percent('in_app', 'total_responses', 0)}, {percent('email', 'total_responses', 0)}) from q
  union all select 'stability', 'NPS Stability (Week-over-Week)', 'signal',
    case when sd is null then 'skip' when sd <= 8 then 'pass' when n < 100 then 'warn' else 'fail' end,
    case when sd is not null then printf('σ=%.1f (n=%d)', sd, n) end from wk
  union all select 'completion_time', 'Survey Completion Time', 'data_quality', {_case('completion_time', '25', '45', '<=')},
    printf('%.1fs average', completion_time) from q
  union all select 'segment_coverage', 'Segment Coverage', 'strategy', {_case('low', '0', '2', '<=')},
    low || ' segments <10% coverage' from g
  union all select 'touchpoints', 'Touchpoint Coverage', 'technical', 'pass', null
  union all select 'device_locale', 'Device/Locale Coverage', 'technical', 'warn', null
  union all select 'data_volume', 'Data Volume', 'data_quality', {_case('total_responses', '1000', '500', '>=')},
    format('{{:,}}', total_responses) || ' responses' from q
  union all select 'nps_distribution', 'NPS Score Distribution', 'signal', {_case(_NET, '0', '-10', '>=')},
    printf('Average: %.1f', {_NET}) from q),
audit_rows as (select *, case status when 'fail' then 'critical' when 'warn' then 'warning' else 'info' end as severity from rules)"""
add(
    "audit_inputs", "AUD-1 WIN-18",
    lambda t: _inputs(t).select(
        "total_responses", "verbatim", "in_app", "email", "promoters", "detractors",
        F.round("completion_time", 4).alias("completion_time"), "responses_30d", "fatigued_users",
        "wow_stddev", "stability_n", "low_segments",
    ),
    f"""with {_VISITS} select total_responses, verbatim, in_app, email, promoters, detractors,
      round(completion_time, 4) as completion_time, responses_30d, fatigued as fatigued_users,
      sd as wow_stddev, n as stability_n, low as low_segments from q, m, f, wk, g""",
)
add(
    "audit_rules", "AUD-2 AUD-3 AUD-4 AUD-5 AUD-6 AUD-7 AUD-8 AUD-9 AUD-10 AUD-11 AUD-12 Q16",
    lambda t: audit.run_audit(_inputs(t)),
    f"with {_VISITS}, {_RULES} select * from audit_rows",
)


def _bare(t):
    return audit.run_audit(audit.audit_inputs(t.commented, "2001-07-31"))


add(
    "audit_without_optional_inputs", "AUD-12 Q16",
    lambda t: _bare(t).select("key", "status", "severity"),
    with_commented(
        f""", q as (select count(*) as n, count(*) filter (where length(trim(nps_explanation)) > 2
            and not contains(lower(nps_explanation), 'n.v.t.') and not contains(lower(nps_explanation), 'nvt')) as v,
          {P} - {D} as d from commented where creation_date >= timestamp '2001-07-31' - interval 90 days),
        wk as (select stddev_pop(a) as sd, sum(n) as n, count(*) as c from (select
            creation_date - cast(dayofweek(creation_date) as int) as w, count(*) as n, avg(nps_score) as a from commented
          where creation_date >= timestamp '2001-07-31' - interval 84 days group by 1)),
        s(key, status) as (select 'response_rate', 'skip' union all select 'fatigue', 'skip'
          union all select 'completion_time', 'skip' union all select 'segment_coverage', 'skip'
          union all select 'touchpoints', 'warn' union all select 'device_locale', 'warn'
          union all select 'channel_mix', 'fail'
          union all select 'verbatim_share', {_case('v / n', '0.55', '0.35', '>=')} from q
          union all select 'stability', case when c <= 1 then 'skip' when sd <= 8 then 'pass' when n < 100 then 'warn' else 'fail' end from wk
          union all select 'data_volume', {_case('n', '1000', '500', '>=')} from q where n > 0
          union all select 'nps_distribution', {_case('coalesce(' + ratio('d * 100', 'n', 1) + ', 0)', '0', '-10', '>=')} from q)
        select key, status, case status when 'fail' then 'critical' when 'warn' then 'warning' else 'info' end as severity from s"""
    ),
)
_SCORE = f"""count(*) filter (where status <> 'skip') as rules, count(*) filter (where status = 'pass') as passed,
  coalesce({ratio("count(*) filter (where status = 'pass') * 100", "count(*) filter (where status <> 'skip')", 0)}, 0.0) as score,
  count(*) filter (where severity = 'critical' and status <> 'pass') as critical_issues,
  count(*) filter (where severity = 'warning' and status <> 'pass') as warning_issues"""
add(
    "audit_score", "AUD-13",
    lambda t: audit.audit_score(audit.run_audit(_inputs(t))),
    f"with {_VISITS}, {_RULES} select {_SCORE} from audit_rows",
)
add(
    "audit_score_by_category", "AUD-13",
    lambda t: audit.audit_score(audit.run_audit(_inputs(t)), by_category=True),
    f"with {_VISITS}, {_RULES} select category, {_SCORE} from audit_rows group by category",
)
