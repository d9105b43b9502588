"""Ad-hoc survey analysis."""

from pyspark.sql import functions as F

from ...functions import cleaning
from ...operators import survey
from ...sources import upload
from .. import bindings
from .base import add, percent, quote, ratio, words, with_answers

SEP = "¦"


def _flat(df, *columns):
    return df.withColumns({c: F.array_join(c, SEP) for c in columns})


add(
    "survey_validated", "SVY-1",
    lambda t: survey.validated(t.answers).select(
        "survey_id", "row_number", "question_order", "sentiment_label", "sentiment_score",
        F.array_join("themes", SEP).alias("themes"),
    ),
    with_answers(
        f"""select survey_id, row_number, question_order, sentiment_label,
        tenths / 10.0::double as sentiment_score, array_to_string(themes, '{SEP}') as themes from checked"""
    ),
)
add(
    "survey_display_names", "CLN-15 CLN-17 Q11",
    lambda t: survey.answer_themes(t.answers).select(
        "theme", cleaning.question_label(F.col("question_text")).alias("question")
    ).distinct(),
    with_answers(
        """select distinct theme, case when question_order < 4 then 'Feedback'
        else 'Question ' || (question_order + 1) || ' Feedback' end as question from answer_mentions"""
    ),
)
add(
    "survey_theme_aggregate", "SVY-2",
    lambda t: survey.theme_aggregate(t.answers),
    with_answers(
        f"""select survey_id, theme, count(*) as mentions,
        count(*) filter (where sentiment_label = 'negative') as negative_count,
        cast(sum(tenths) * 1000 as double) / 10000.0::double as sentiment_sum,
        {ratio('sum(tenths)', 'count(*) * 10', 4)} as avg_sentiment
        from answer_mentions group by all"""
    ),
)
# Distinct answers per theme, with reading order.
_ONCE = """once as (select distinct survey_id, theme, row_number, question_order, question_text,
    response_text, sentiment_label, tenths from answer_mentions)"""
_RECORDS = f"""{_ONCE},
  records as (select m.survey_id, m.theme as theme_name, m.mention_count, o.sentiment_score, o.samples from
    (select survey_id, theme, count(*) as mention_count from answer_mentions group by all) m
    join (select survey_id, theme, {ratio('sum(tenths)', 'count(*) * 10', 4)} as sentiment_score,
        list(response_text order by row_number, question_order)[1:3] as samples from once group by all) o
      on o.survey_id = m.survey_id and o.theme = m.theme)"""
add(
    "survey_theme_records", "SVY-3 Q14",
    lambda t: _flat(survey.theme_records(t.answers), "sample_responses"),
    with_answers(
        f""", {_RECORDS} select survey_id, theme_name, mention_count, sentiment_score,
        array_to_string(samples, '{SEP}') as sample_responses from records"""
    ),
)
_SEVERITY = f"""{_ONCE},
  totals as (select survey_id, count(*) as total from checked group by 1),
  sums as (select m.survey_id, m.theme, t.total, count(*) as mentions,
    count(*) filter (where sentiment_label = 'positive') as positive,
    count(*) filter (where sentiment_label = 'negative') as negative,
    sum(tenths) * 1000 as units from answer_mentions m join totals t on t.survey_id = m.survey_id group by all),
  parts as (select *, negative / mentions as share,
    case when total <= 30 then sqrt(mentions) when total <= 200 then pow(mentions, 0.75)
      else cast(mentions as double) end as volume,
    abs(0.5::double - case when units = 0 then 0.5::double else units / (mentions * 10000.0::double) end) as distance
    from sums),
  severity as (select *, round(share, 6) as negative_share,
    round(volume * (0.7::double * case when share > 0.5 then share else 1 - share end
      + 0.3::double * (1 + distance)), 6) as severity,
    (select count(*) from once o where o.survey_id = p.survey_id and o.theme = p.theme) as answers
    from parts p),
  ranked as (select *, cast(row_number() over (partition by survey_id order by severity desc, theme) as int) as rank
    from severity)"""
add(
    "survey_severity", "SVY-4",
    lambda t: survey.severity(t.answers),
    with_answers(
        f""", {_SEVERITY} select survey_id, theme, total, mentions, answers, positive, negative,
        cast(units as bigint) as unit_sum, negative_share, severity from severity"""
    ),
)
add(
    "survey_satisfaction", "SVY-5",
    lambda t: survey.satisfaction(t.answers),
    with_answers(
        f"""select survey_id, count(*) as total,
        count(*) filter (where sentiment_label = 'positive') as positive_count,
        count(*) filter (where sentiment_label = 'negative') as negative_count,
        cast({percent("count(*) filter (where sentiment_label = 'positive')", 'count(*)', 0)} as int) as satisfaction_rate
        from checked group by 1"""
    ),
)
_INSIGHTS = f"""{_SEVERITY},
  quotes as (select survey_id, theme, list(left(response_text, 150) || '...'
      order by row_number, question_order) as qs from answer_mentions group by all),
  tops as (select r.*, q.qs, least(case when total <= 30 then 1 when total <= 200 then 2 else 3 end, answers) as want
    from ranked r join quotes q on q.survey_id = r.survey_id and q.theme = r.theme where rank <= 5),
  pick(survey_id, rank, used, chosen) as (
    select distinct survey_id, 0, cast([] as varchar[]), cast([] as varchar[]) from tops
    union all
    select survey_id, rank, list_concat(used, chosen), chosen from (
      select p.survey_id, t.rank, p.used,
        list_slice(list_filter(t.qs, lambda q: not list_contains(p.used, q)), 1, t.want) as chosen
      from pick p join tops t on t.survey_id = p.survey_id and t.rank = p.rank + 1)),
  insights as (select t.survey_id, t.rank, t.theme, t.mentions,
    cast({percent('t.negative', 't.mentions', 0)} as int) as negative_pct,
    cast(case when units = 0 then 50 else {ratio('units * 100', 't.mentions * 10000', 0)} end as int) as sentiment_pct,
    array_to_string(p.chosen, '{SEP}') as quotes, round(least(t.severity / 10, 1.0::double), 6) as impact
    from tops t join pick p on p.survey_id = t.survey_id and p.rank = t.rank)"""


def _recursive(body):
    return with_answers(body).replace("with ", "with recursive ", 1)


add(
    "survey_theme_insights", "SVY-6 CLN-21",
    lambda t: _flat(survey.theme_insights(t.answers), "quotes"),
    _recursive(f", {_INSIGHTS} select * from insights"),
)


def _nth(label, n):
    return f"list(response_text order by row_number, question_order) filter (where sentiment_label = '{label}')[{n}]"


_ACTION_CASE = "case " + " ".join(
    "when " + " or ".join(f"contains(lower(theme), '{w}')" for w in ws) + f" then {quote(n)}"
    for n, ws in survey.NEGATIVE_ACTIONS
) + " else 'find_root_cause' end"
_ACTIONS = f"""{_SEVERITY},
  firsts as (select survey_id, theme, {_nth('positive', 1)} as p1, {_nth('positive', 2)} as p2,
    {_nth('negative', 1)} as n1, {_nth('negative', 2)} as n2 from once group by all),
  actions as (select r.survey_id, rank, r.theme, mentions, positive as positive_count, negative as negative_count,
    severity, cast({percent('negative', 'mentions', 0)} as int) as negative_pct,
    left(p1, 200) as positive_quote, left(n1, 200) as negative_quote,
    case when n1 is null then left(p2, 150) || '...' end as second_positive_quote,
    case when p1 is null then left(n2, 150) || '...' end as second_negative_quote,
    case when negative > 0 and positive > 0 then 'maintain_and_fix' when negative > 0 then {_ACTION_CASE.replace('theme', 'r.theme')}
      when positive > 0 then 'amplify' else 'monitor' end as action,
    case when negative > 0 and positive > 0
      then 'Maintain: ' || left(p1, 50) || '... | Fix: ' || left(n1, 50) || '...' end as action_detail,
    case when mentions >= 3 then 'significant' when mentions >= 2 then 'worth_investigating'
      else 'early_signal' end as importance
    from ranked r left join firsts f on f.survey_id = r.survey_id and f.theme = r.theme where rank <= 3)"""
add(
    "survey_actions", "SVY-7",
    lambda t: survey.action_rows(t.answers),
    with_answers(f", {_ACTIONS} select * from actions"),
)


def _one_line(df):
    """Plans with one line per quote, as the stored text has them."""
    quotes = ("positive_quote", "negative_quote", "action_detail")
    return df.withColumns({c: F.regexp_replace(c, r"\s+", " ") for c in quotes})


add(
    "survey_action_plan", "SVY-17",
    lambda t: survey.parse_action_plan(
        survey.action_plan_text(_one_line(survey.action_rows(t.answers)))
    ),
    with_answers(
        f""", {_ACTIONS}, flat as (select * replace (
            regexp_replace(positive_quote, '\\s+', ' ', 'g') as positive_quote,
            regexp_replace(negative_quote, '\\s+', ' ', 'g') as negative_quote,
            regexp_replace(action_detail, '\\s+', ' ', 'g') as action_detail) from actions)
        select survey_id, rank as section, theme as title,
          '• Mentioned by ' || mentions || ' customers (' || positive_count || ' positive, '
            || negative_count || ' negative)' as metrics,
          coalesce('"' || positive_quote || '"', '') as positive_feedback,
          coalesce('"' || negative_quote || '"', '') as issue_reported,
          trim(coalesce(action_detail, action)) as action, importance as why_matters from flat"""
    ),
)
add(
    "survey_question_summary", "SVY-8",
    lambda t: survey.question_summary(t.answers),
    with_answers(
        f"""select *, case when sentiment_rate >= 70 then 'positive' when sentiment_rate <= 30 then 'concerns'
          else 'mixed' end as analysis from (select survey_id, question_text, count(*) as total,
          count(*) filter (where sentiment_label = 'positive') as positive,
          count(*) filter (where sentiment_label = 'negative') as negative,
          cast({percent("count(*) filter (where sentiment_label = 'positive')", 'count(*)', 0)} as int) as sentiment_rate
        from checked group by all)"""
    ),
)
add(
    "survey_question_insights", "SVY-8",
    lambda t: survey.question_insights(t.answers),
    with_answers(
        f""", {_ONCE}, c as (select survey_id, question_text, theme, count(*) as mentions
            from answer_mentions group by all),
        r as (select *, cast(row_number() over (partition by survey_id, question_text
            order by mentions desc, theme) as int) as rank from c),
        q as (select survey_id, question_text, theme, {_nth('positive', 1)} as p, {_nth('negative', 1)} as n
          from once group by all)
        select r.survey_id, r.question_text, rank, r.theme, cast(mentions as bigint) as mentions,
          left(p, 150) || '...' as positive_quote, left(n, 150) || '...' as negative_quote
        from r left join q on q.survey_id = r.survey_id and q.question_text = r.question_text
          and q.theme = r.theme where rank <= 3"""
    ),
)
_TOP5 = """(select survey_id, array_to_string(list(theme order by m desc, theme)[1:5], '¦') as top_themes
  from (select survey_id, theme, count(*) as m from answer_mentions group by all) group by 1)"""
add(
    "survey_overall", "SVY-9",
    lambda t: _flat(survey.overall_summary(t.answers), "top_themes"),
    with_answers(
        f"""select c.*, t.top_themes from (select survey_id, count(*) as total,
          count(distinct question_text) as questions,
          count(*) filter (where sentiment_label = 'positive') as positive,
          count(*) filter (where sentiment_label = 'negative') as negative from checked group by 1) c
        left join {_TOP5} t on t.survey_id = c.survey_id"""
    ),
)


def _insight_rows(t):
    i = survey.theme_insights(t.answers)
    rows = i.select(
        "survey_id",
        F.when(F.col("negative_pct") > 50, "problem").otherwise("success").alias("type"),
        F.concat("theme", F.lit(" Analysis")).alias("title"),
        F.concat(F.col("mentions").cast("string"), F.lit(" mentions")).alias("content"),
        F.array("theme").alias("themes"),
        "impact",
    )
    overall = survey.satisfaction(t.answers).select(
        "survey_id", F.lit("summary").alias("type"), F.lit("").alias("title"),
        F.col("satisfaction_rate").cast("string").alias("content"),
        F.array().cast("array<string>").alias("themes"), F.lit(None).cast("double").alias("impact"),
    )
    return survey.insight_records(rows.unionByName(overall))


add(
    "survey_insight_records", "SVY-10",
    lambda t: _insight_rows(t).drop("supporting_data"),
    _recursive(
        f""", {_INSIGHTS}
        select survey_id, 'theme' as insight_type, theme || ' Analysis' as title, mentions || ' mentions' as description,
          cast(floor(case when impact = 0 then 0.5::double else impact end * 10 + 0.5::double) as int) as priority
        from insights
        union all select survey_id, 'summary', 'summary', cast(cast(
          {percent("count(*) filter (where sentiment_label = 'positive')", 'count(*)', 0)} as int) as varchar), 5
        from checked group by survey_id"""
    ),
)


def _reruns(t):
    """Theme rows of a survey processed eight times, later times in upper case.

    Only the last time brings a sample that the others do not have.
    """
    r = survey.theme_records(t.answers)
    runs = F.explode(F.array(*[F.lit(x) for x in "abcdefgh"])).alias("run")
    later = F.col("run") > "a"
    new = F.when(F.col("run") == "h", F.array(F.concat(F.lit("nieuw "), F.lower("theme_name"))))
    return r.select("*", runs).withColumns(
        {
            "id": F.concat_ws(":", "run", "survey_id", "theme_name"),
            "sample_responses": F.concat(
                "sample_responses", F.coalesce(new, F.array().cast("array<string>"))
            ),
            "mention_count": F.col("mention_count") + later.cast("int"),
            "theme_name": F.when(later, F.upper("theme_name")).otherwise(F.col("theme_name")),
        }
    ).drop("run")


add(
    "survey_merged_themes", "SVY-11",
    lambda t: _flat(survey.merge_theme_records(_reruns(t)), "sample_responses"),
    with_answers(
        f""", {_RECORDS}
        select survey_id, 'a:' || survey_id || ':' || theme_name as id, theme_name,
          cast(8 * mention_count + 7 as bigint) as mention_count,
          {ratio('cast(round(sentiment_score * 10000) as bigint) * (8 * mention_count + 7)', '(8 * mention_count + 7) * 10000', 4)} as sentiment_score,
          array_to_string(list_concat(list_filter(samples, lambda x, i: list_position(samples, x) = i),
            ['nieuw ' || lower(theme_name)])[:5], '{SEP}') as sample_responses from records"""
    ),
)
add(
    "survey_detail_answers", "SVY-12",
    lambda t: _flat(survey.detail_answers(t.answers), "themes"),
    with_answers(
        f"""select survey_id, row_number, question_order, response_text,
          case when analysed and a_tenths <> 0 then a_tenths / 10.0::double else 0.5::double end as sentiment_score,
          case when analysed then a_label else 'neutral' end as sentiment_label,
          case when analysed then array_to_string(a_themes, '{SEP}') else '' end as themes, question_text
        from (select *, row_number() over (partition by survey_id order by row_number, question_order) as rn
          from answers) where rn <= 10"""
    ),
)
_HEADERS = """headers as (select conv_id, 'survey_' || conv_id as id, 'Survey ' || conv_id as name,
  count(*) as total_responses, case when conv_id % 3 = 0 then 'processing' when conv_id % 3 = 1 then 'completed'
    else 'failed' end as status, timestamp '2023-11-14 22:13:20' + to_seconds(conv_id * 60) as created_at,
  timestamp '2023-11-14 22:13:20' + to_seconds(conv_id * 61) as updated_at from conversations group by conv_id)"""
add(
    "survey_progress", "SVY-13 Q15",
    lambda t: survey.progress(t.analyses, t.conversation_answers),
    with_answers(
        f""", {_HEADERS} select h.id as survey_id, h.name, h.status,
        count(*) filter (where a.analysed) as processed, count(*) as total,
        cast({percent('count(*) filter (where a.analysed)', 'count(*)', 0)} as int) as percentage
        from headers h join answers a on a.conv_id = h.conv_id group by all"""
    ),
)


def _summary(t):
    answers = t.conversation_answers
    insights = survey.theme_insights(answers)
    return survey.survey_summary(t.analyses, answers, survey.theme_records(answers), insights)


add(
    "survey_summary", "SVY-14 JN-14 Q6",
    _summary,
    with_answers(
        f""", {_HEADERS}, t as (select conv_id, count(distinct theme) as n from answer_mentions group by 1)
        select h.id as survey_id, h.name, h.total_responses, h.status, h.total_responses as processed_responses,
          coalesce(t.n, 0) as theme_count, least(coalesce(t.n, 0), 5) as insight_count
        from headers h left join t on t.conv_id = h.conv_id"""
    ),
)
_MOODS = """count(*) filter (where sentiment_label = 'positive') as positive,
  count(*) filter (where sentiment_label = 'negative') as negative,
  count(*) filter (where sentiment_label = 'neutral') as neutral"""
_MOOD_PCT = f"""cast({percent('positive', 'positive + negative + neutral', 0)} as int) as positive_pct,
  cast({percent('negative', 'positive + negative + neutral', 0)} as int) as negative_pct"""
add(
    "survey_sentiment", "SVY-15",
    lambda t: survey.sentiment_distribution(t.answers),
    with_answers(f"select *, {_MOOD_PCT} from (select survey_id, {_MOODS} from checked group by all)"),
)
add(
    "survey_sentiment_by_question", "SVY-15",
    lambda t: survey.sentiment_distribution(t.answers, by_question=True),
    with_answers(
        f"select *, {_MOOD_PCT} from (select survey_id, question_text, {_MOODS} from checked group by all)"
    ),
)
add(
    "survey_cross_question_themes", "SVY-15",
    lambda t: survey.cross_question_themes(survey.theme_records(t.answers)),
    with_answers(
        """select * from (select survey_id, theme as theme_name, count(*) as mention_count,
          cast(row_number() over (partition by survey_id order by count(*) desc, theme) as int) as rank
        from answer_mentions group by survey_id, theme) where rank <= 5"""
    ),
)
_STOP = words(__import__("voxmetric.sources.reference_data", fromlist=["x"]).ENGLISH_STOP_WORDS)
add(
    "survey_narratives", "SVY-16",
    lambda t: _flat(survey.narratives(t.answers), "top_themes", "top_words"),
    with_answers(
        f""", m as (select *, {_MOOD_PCT} from (select survey_id, question_text, {_MOODS} from checked group by all)),
        th as (select survey_id, question_text, array_to_string(list(theme order by n desc, theme)[1:3], '{SEP}') as top_themes
          from (select survey_id, question_text, theme, count(*) as n from answer_mentions group by all) group by all),
        w as (select survey_id, question_text, array_to_string(list(word order by n desc, word)[1:3], '{SEP}') as top_words
          from (select survey_id, question_text, word, count(*) as n from (select survey_id, question_text,
              unnest(regexp_split_to_array(lower(response_text), '\\s+')) as word from answers)
            where length(word) >= 3 and word not in ({_STOP}) group by all) group by all)
        select m.survey_id, m.question_text, positive_pct, negative_pct,
          case when top_themes is null then 'diverse' when positive_pct >= 70 then 'praise'
            when negative_pct >= 50 then 'critical' when positive_pct > negative_pct then 'mixed'
            else 'complex' end as narrative, top_themes, top_words
        from m left join th on th.survey_id = m.survey_id and th.question_text = m.question_text
          left join w on w.survey_id = m.survey_id and w.question_text = m.question_text"""
    ),
)
AS_OF = "2023-11-14 23:40:00"
add(
    "survey_latest", "SVY-18",
    lambda t: survey.latest_surveys(t.analyses).withColumns(
        {c: bindings.string_stamp(c) for c in ("created_at", "updated_at")}
    ),
    f"""with {_HEADERS} select id, name, status, total_responses,
      strftime(created_at, '%Y-%m-%d %H:%M:%S') as created_at, strftime(updated_at, '%Y-%m-%d %H:%M:%S') as updated_at
      from (from headers order by created_at desc, id limit 5)""",
)
add(
    "survey_processing", "SVY-19",
    lambda t: survey.processing_surveys(t.analyses, AS_OF),
    f"""with {_HEADERS} select id, name, total_responses,
      round(cast(epoch_us(timestamp '{AS_OF}') - epoch_us(updated_at) as double) / 60000000, 4) as minutes_since_update
      from headers where status = 'processing'""",
)
add(
    "survey_reset_stuck", "SVY-19",
    lambda t: survey.reset_stuck(t.analyses, AS_OF).select(
        "id", "status", "was_reset", bindings.string_stamp("updated_at").alias("updated_at")
    ),
    f"""with {_HEADERS}, s as (select *, status = 'processing'
        and updated_at < timestamp '{AS_OF}' - interval 10 minutes as was_reset from headers)
      select id, case when was_reset then 'failed' else status end as status, was_reset,
        strftime(case when was_reset then timestamp '{AS_OF}' else updated_at end, '%Y-%m-%d %H:%M:%S') as updated_at from s""",
)

# ------------------------------------------------------------------- upload

def _header_row(t):
    n = bindings.question_count(t.spark, t.sf_dir)
    return ["participant_id", *[f"question_{i + 1}_feedback" for i in range(n)], "segment", "size"]


def _upload_long(t):
    raw = upload.tidy(bindings.wide_upload(t.spark, t.sf_dir), keep=("survey_id", "file_order"))
    long = upload.to_long(raw, upload.detect_structure(_header_row(t)))
    return long.withColumn(
        "metadata",
        F.array_join(
            F.transform(F.map_entries("metadata"), lambda e: F.concat_ws("=", e["key"], e["value"])), ","
        ),
    )


_LONG = """turns as (select conv_id, turn, case when conv_id % 7 = 3 then 'kort'
    else regexp_replace(text, '^\\s+|\\s+$', '', 'g') end as txt from conversations),
  people as (select conv_id, 'survey_' || (conv_id % 2) as survey_id, max(role) as segment, count(*) as n
    from conversations group by conv_id),
  kept as (select p.*, row_number() over (partition by survey_id order by conv_id) + 1 as row_number
    from people p where exists (select 1 from turns t where t.conv_id = p.conv_id and length(t.txt) > 10)),
  long as (select k.survey_id, cast(k.row_number as bigint) as row_number, t.txt as response_text,
    'question_' || (t.turn + 1) || '_feedback' as question_text, cast(t.turn as int) as question_order,
    'participant_id=p' || k.conv_id || case when k.conv_id % 3 <> 0 then ',segment=' || k.segment else '' end
      || ',size=' || k.n as metadata
    from kept k join turns t on t.conv_id = k.conv_id where length(t.txt) > 10)"""
add(
    "upload_long", "ING-12 ING-13 ING-14 ING-15",
    _upload_long,
    f"with {_LONG} select * from long",
)
add(
    "upload_counts", "ING-13 ING-14",
    lambda t: _upload_long(t).groupBy("survey_id").agg(
        F.count(F.lit(1)).alias("answers"), F.max("row_number").alias("last_row"),
        F.count_distinct("row_number").alias("respondents"),
    ),
    f"""with {_LONG} select survey_id, count(*) as answers, max(row_number) as last_row,
      count(distinct row_number) as respondents from long group by 1""",
)
