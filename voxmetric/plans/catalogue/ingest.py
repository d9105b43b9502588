"""Export rows to responses."""

from pyspark.sql import functions as F

from ...functions import cleaning
from ...sources import ingest, tables
from .. import bindings
from .base import add, remark, with_responses

# The export rows as SQL, then what normalisation makes of them.
_EXPORT = f"""export as (select *,
    case when id % 47 <> 0 then survey_name || ' ' else '' end as x_survey,
    case when id % 19 = 0 then 'abc' when id % 23 = 0 then '11'
      when id % 3 = 0 then nps_score || '.9' else ' ' || nps_score end as x_score,
    case when id % 41 = 0 then '' when id % 43 = 0 then '31/31/2000' when id % 6 = 0 then strftime(creation_date, '%d/%m/%Y')
      when id % 6 = 1 then strftime(creation_date, '%Y-%m-%d') when id % 6 = 2 then strftime(creation_date, '%-d-%-m-%Y')
      when id % 6 = 3 then strftime(creation_date, '%-d.%-m.%Y')
      when id % 6 = 4 then strftime(creation_date, '%-d/%-m/%Y') || ' 0:00:00'
      else strftime(creation_date, '%d/%m/%y') end as x_date,
    case when id % 6 in (0, 1) then null else {remark('id', '0')} end as x_comment,
    coalesce(nullif(case when id % 8 <> 0 then title_text else '' end, ''), 'alt_' || (id % 4)) as x_title
  from responses),
  normal as (select *, case when id % 47 = 0 then 'Missing SURVEY'
      when id % 19 = 0 or id % 23 = 0 then 'Invalid NPS: ' || x_score
      when id % 41 = 0 or id % 43 = 0 then 'Invalid CREATIE_DT: ' || x_date end as error from export)"""
_FIELDS = """survey_name, nps_score, x_comment as nps_explanation, gender, age_range, creation_date,
  x_title as title_text, nps_category"""


def _normal(t):
    return ingest.normalize(t.export)


add(
    "ingest_valid", "ING-3 ING-4 ING-5 CLN-4 CLN-5 CLN-7 CLN-8 CLN-9",
    lambda t: ingest.valid_rows(_normal(t)).select(
        "row_number", "survey_name", "nps_score", "nps_explanation", "gender", "age_range",
        "creation_date", "title_text", "nps_category",
    ),
    with_responses(f", {_EXPORT} select id as row_number, {_FIELDS} from normal where error is null"),
)
add(
    "ingest_rejected", "ING-5 ING-6",
    lambda t: ingest.rejected_rows(_normal(t)).drop("raw_data"),
    with_responses(
        f""", {_EXPORT} select id as row_number, error, 'Row ' || id || ': ' || error as message
        from normal where error is not null"""
    ),
)
add(
    "ingest_report", "ING-6",
    lambda t: ingest.ingest_report(_normal(t)),
    with_responses(
        f""", {_EXPORT} select count(*) filter (where error is null) as inserted,
        count(error) as skipped, count(*) filter (where error is null) as raw_saved from normal"""
    ),
)
add(
    "ingest_reject_reasons", "ING-6",
    lambda t: ingest.reject_reasons(_normal(t)),
    with_responses(
        f""", {_EXPORT} select string_split(error, ':')[1] as reason, count(*) as rows
        from normal where error is not null group by 1"""
    ),
)
add(
    "ingest_raw_json", "ING-7",
    lambda t: _normal(t).select(
        "row_number", F.get_json_object("raw_data", "$.NPS").alias("raw_score"),
        F.get_json_object("raw_data", "$.CREATIE_DT").alias("raw_date"),
        F.get_json_object("raw_data", "$.SURVEY").alias("raw_survey"),
    ),
    with_responses(
        f""", {_EXPORT} select id as row_number, x_score as raw_score, x_date as raw_date,
        x_survey as raw_survey from normal"""
    ),
)
add(
    "ingest_responses", "ING-10 CLN-10 CLN-11 Q10",
    lambda t: ingest.load_responses(t.export).select(
        "row_number", "nps_category", "word_count", "has_explanation"
    ),
    with_responses(
        f""", {_EXPORT} select id as row_number, nps_category,
        cast(case when x_comment is null then 0 else len(string_split(x_comment, ' ')) end as int) as word_count,
        x_comment is not null as has_explanation from normal where error is null"""
    ),
)
add(
    "ingest_loose", "ING-9",
    lambda t: ingest.load_responses(t.export, strict=False).groupBy("survey_name").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("nps_score").alias("score_sum"),
        F.sum("word_count").alias("words"), F.count_if("has_explanation").alias("explained"),
        F.count("creation_date").alias("dated"),
    ),
    with_responses(
        f""", {_EXPORT} select x_survey as survey_name, count(*) as rows, cast(sum(nps_score) as bigint) as score_sum,
        cast(sum(case when id % 6 in (0, 1) then 1 else len(string_split({remark('id', '0')}, ' ')) end) as bigint) as words,
        count(*) as explained,
        count(*) filter (where id % 41 <> 0 and id % 43 <> 0) as dated
        from export where id % 19 <> 0 and id % 23 <> 0 group by 1"""
    ),
)


def _sniffed(t):
    return t.commented.select(
        "id",
        cleaning.word_count(F.col("nps_explanation")).alias("word_count"),
        cleaning.has_explanation(F.col("nps_explanation")).alias("has_explanation"),
        cleaning.is_empty_comment(F.col("nps_explanation")).alias("is_empty"),
    )


def _commented(body):
    from .base import with_commented

    return with_commented(body)


add(
    "comment_measures", "CLN-7 CLN-10 CLN-11",
    _sniffed,
    _commented(
        """select id, cast(case when trim(nps_explanation) is null then 0 else
          len(regexp_split_to_array(regexp_replace(nps_explanation, '^\\s+|\\s+$', '', 'g'), '\\s+')) end as int) as word_count,
        nps_explanation is not null as has_explanation,
        nps_explanation is null or lower(trim(nps_explanation)) = 'n.v.t.' as is_empty from commented"""
    ),
)
add(
    "yes_no_values", "CLN-6",
    lambda t: t.responses.select(
        "id",
        cleaning.yes_no(
            F.element_at(
                F.array(*map(F.lit, (" Ja", "NEE", "true", "0", "misschien", "1", "no"))),
                (F.col("id") % 7 + 1).cast("int"),
            )
        ).alias("flag"),
    ),
    with_responses("select id, [true, false, true, false, null, true, false][id % 7 + 1] as flag from responses"),
)
add(
    "pruned_scan", "ING-17 FLT-4",
    lambda t: tables.scan(
        t.spark, f"{t.sf_dir}/orders.parquet", ["o_orderkey", "o_orderpriority"],
        F.col("o_orderdate") >= "1999-01-01", F.col("o_orderstatus") == "F",
    ),
    """select o_orderkey, o_orderpriority from orders
      where o_orderdate >= date '1999-01-01' and o_orderstatus = 'F'""",
)
