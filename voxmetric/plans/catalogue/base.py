"""Catalogue entries and the shared pieces of their SQL twins.

An entry pairs a Spark query over the benchmark tables with SQL that computes
the same result by other means: it counts raw mentions and distinct responses
where the operators work on packed arrays.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ...operators import themes
from ...sources import reference_data as ref
from .. import bindings


class Tables:
    """Derived tables of one benchmark folder, built on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def _bind(self, build: Callable, **options) -> DataFrame:
        return build(self.spark, self.sf_dir, **options)

    @cached_property
    def responses(self) -> DataFrame:
        return self._bind(bindings.responses)

    @cached_property
    def commented(self) -> DataFrame:
        return self._bind(bindings.responses, comments=True)

    @cached_property
    def referenced(self) -> DataFrame:
        return self._bind(bindings.referenced)

    def with_comments(self, rows: DataFrame) -> DataFrame:
        return self._bind(bindings.with_comments, rows=rows)

    @cached_property
    def enrichment(self) -> DataFrame:
        return self._bind(bindings.enrichment)

    @cached_property
    def assignments(self) -> DataFrame:
        return themes.assignments(self.responses, self.enrichment)

    @cached_property
    def commented_assignments(self) -> DataFrame:
        return themes.assignments(self.commented, self.enrichment)

    @cached_property
    def referenced_assignments(self) -> DataFrame:
        return themes.assignments(self.referenced, self.enrichment)

    @cached_property
    def listing(self) -> DataFrame:
        return bindings.theme_listing(self.assignments)

    @cached_property
    def answers(self) -> DataFrame:
        return self._bind(bindings.answers)

    @cached_property
    def analyses(self) -> DataFrame:
        return self._bind(bindings.analyses)

    @cached_property
    def conversation_answers(self) -> DataFrame:
        return self._bind(bindings.conversation_answers)

    @cached_property
    def export(self) -> DataFrame:
        return self._bind(bindings.export)

    @cached_property
    def visits(self) -> DataFrame:
        return self._bind(bindings.visits)

    @cached_property
    def embeddings(self) -> DataFrame:
        return self._bind(bindings.embeddings)


@dataclass(frozen=True)
class Entry:
    ids: str
    run: Callable[[Tables], DataFrame]
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def add(name: str, ids: str, run: Callable[[Tables], DataFrame], sql: str | None = None) -> None:
    if name in ENTRIES:
        raise ValueError(f"duplicate entry {name}")
    ENTRIES[name] = Entry(ids, run, sql)


# ------------------------------------------------------------ SQL fragments


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(name: str, columns: str, rows) -> str:
    body = ", ".join(
        "(" + ", ".join(quote(v) if isinstance(v, str) else str(v) for v in row) + ")"
        for row in rows
    )
    return f"{name}({columns}) as (values {body})"


def words(items) -> str:
    return ", ".join(quote(i) for i in items)


def ratio(num: str, den: str, digits: int) -> str:
    """num/den rounded half away from zero; NULL for an empty denominator."""
    d = f"nullif(cast({den} as hugeint), 0)"
    n = f"cast({num} as hugeint)"
    return (
        f"(cast(sign({n}) * ((2 * abs({n}) * {10**digits} + {d}) // (2 * {d})) as double)"
        f" / cast({10**digits} as double))"
    )


P = "count(*) filter (where nps_score >= 9)"
S = "count(*) filter (where nps_score between 7 and 8)"
D = "count(*) filter (where nps_score <= 6)"
PSD = f"{P} as promoters, {S} as passives, {D} as detractors"


def net(digits: int = 2) -> str:
    return f"coalesce({ratio(f'(({P}) - ({D})) * 100', 'count(*)', digits)}, 0.0)"


def mean_score(digits: int) -> str:
    return ratio("sum(nps_score)", "count(nps_score)", digits)


def percent(part: str, whole: str, digits: int = 1) -> str:
    return f"coalesce({ratio(f'({part}) * 100', whole, digits)}, 0.0)"


_REMARKS = "[" + words(bindings.REMARKS) + "]"


def remark(key: str, shift: str) -> str:
    return f"list_extract({_REMARKS}, cast(({key} * 13 + {shift}) % {len(bindings.REMARKS)} as int) + 1)"


RESPONSES = """
base_responses as (
  select o_orderkey as id, o_custkey as cust, o_orderpriority as survey_name,
    cast((o_orderkey * 7 + o_custkey * 3) % 11 as integer) as nps_score,
    case when o_orderkey % 29 <> 0 then c_mktsegment end as gender,
    'band_' || (o_orderkey % 5) as age_range, o_orderstatus as years_employed,
    cast(o_orderdate as date) as creation_date,
    case when o_orderkey % 37 <> 0 then n_name end as title_text,
    o_orderdate + to_seconds(o_orderkey % 86400) as created_at
  from orders left join customer on o_custkey = c_custkey
    left join nation on c_nationkey = n_nationkey),
responses as (
  select *, case when nps_score >= 9 then 'promoter' when nps_score >= 7 then 'passive'
    else 'detractor' end as nps_category
  from base_responses)"""

COMMENTED = RESPONSES + f""",
commented as (
  select r.*, case when id % 5 = 0 then null when id % 31 = 0 then ' n.v.t. '
    else d.text || ' ' || {remark('id', 'cust')} end as nps_explanation
  from responses r left join documents d
    on d.doc_id = r.id % (select count(*) from documents))"""

LABEL = (
    "case when sentiment_score > 0.1 then 'positive' "
    "when sentiment_score < -0.1 then 'negative' else 'neutral' end"
)

ENRICHMENT = f"""
{values('part_themes', 'word, theme', bindings.PART_THEMES.items())},
per_order as (
  select l_orderkey as response_id, list_sort(list_distinct(list(t.theme))) as names,
    list_sort(list_distinct(list(lower(p_brand)))) as keywords
  from lineitem join part on l_partkey = p_partkey
    left join part_themes t on t.word = split_part(p_name, ' ', l_linenumber % 2 + 1)
  group by 1),
base_enrichment as (
  select *, case when response_id % 101 <> 0 then names ||
      case when response_id % 499 = 0 then ['niche_' || (response_id // 998)] else [] end
    end as themes,
    case when response_id % 13 <> 0
      then cast((response_id % 201 - 100) / 100.0 as decimal(3,2)) end as sentiment_score
  from per_order),
enrichment as (
  select *, {LABEL} as sentiment_label, themes[1] as primary_theme,
    cast(response_id % 100 as double) / 100.0 as confidence,
    case when response_id % 17 = 0 then 'failed' else 'completed' end as processing_status,
    {remark('response_id', '5')} as summary,
    timestamp '2001-09-09 01:46:40' + to_seconds(response_id) as created_at
  from base_enrichment)"""

_SYNONYMS = values("synonyms", "synonym, canonical", ref.synonym_pairs())


def _mentions(source: str, text: str) -> str:
    return f"""
{_SYNONYMS},
raw_mentions as (
  select e.*, u.theme as raw_theme
  from (select response_id, sentiment_score, sentiment_label, processing_status, themes
        from enrichment) e, unnest(e.themes) as u(theme)),
mentions as (
  select m.response_id, m.sentiment_score, m.sentiment_label, m.processing_status, m.raw_theme,
    coalesce(s.canonical, lower(trim(m.raw_theme))) as theme,
    r.survey_name, r.title_text, r.nps_score, r.creation_date, r.created_at{text}
  from raw_mentions m join {source} r on r.id = m.response_id
    left join synonyms s on s.synonym = lower(trim(m.raw_theme)))"""


MENTIONS = ENRICHMENT + "," + _mentions("responses", "")
COMMENTED_MENTIONS = ENRICHMENT + "," + _mentions("commented", ", r.nps_explanation")
HUNDREDTHS = "cast(sentiment_score * 100 as bigint)"


def with_responses(body: str) -> str:
    return f"with {RESPONSES} {body}"


def with_commented(body: str) -> str:
    return f"with {COMMENTED} {body}"


def with_enrichment(body: str) -> str:
    return f"with {RESPONSES}, {ENRICHMENT} {body}"


def with_commented_enrichment(body: str) -> str:
    return f"with {COMMENTED}, {ENRICHMENT} {body}"


def with_mentions(body: str) -> str:
    return f"with {RESPONSES}, {MENTIONS} {body}"


def with_commented_mentions(body: str) -> str:
    return f"with {COMMENTED}, {COMMENTED_MENTIONS} {body}"


THEME_AGGREGATE = f"""
  select theme, count(distinct response_id) as count_responses,
    {ratio(f'sum({HUNDREDTHS})', 'count(sentiment_score) * 100', 3)} as avg_sentiment,
    {mean_score(1)} as avg_nps
  from mentions group by theme"""

STAMP = "strftime({0}, '%Y-%m-%d %H:%M:%S')"


def stamp(col: str) -> str:
    return STAMP.format(col)


ANSWERS = f"""
answers as (
  select 'survey_' || (conv_id % 5) as survey_id, conv_id, conv_id + 2 as row_number,
    'question_' || (turn + 1) || '_feedback' as question_text,
    cast(turn as int) as question_order, text as response_text,
    (conv_id * 3 + turn) % 11 <> 0 as analysed,
    case when (conv_id * 3 + turn) % 5 < 2 then 'positive'
      when (conv_id * 3 + turn) % 5 < 4 then 'negative' else 'neutral' end as a_label,
    cast((conv_id * 7 + turn * 3) % 11 as int) as a_tenths,
    list_transform([0, 1, 3][1:cast((conv_id * 3 + turn) % 4 as int)],
      lambda i: list_extract([{words(bindings.ANSWER_THEMES)}],
        cast((conv_id + turn * 2 + i) % {len(bindings.ANSWER_THEMES)} as int) + 1)) as a_themes
  from conversations),
checked as (
  select *, (analysed and a_tenths <> 0) as valid,
    case when analysed and a_tenths <> 0 then a_label else 'neutral' end as sentiment_label,
    case when analysed and a_tenths <> 0 then a_tenths else 0 end as tenths,
    case when analysed and a_tenths <> 0 then a_themes else [] end as themes
  from answers),
answer_mentions as (
  select c.survey_id, c.conv_id, c.row_number, c.question_text, c.question_order,
    c.response_text, c.sentiment_label, c.tenths,
    list_aggregate(list_transform(string_split(trim(replace(regexp_replace(u.t,
      '^(question_[0-9]+_|response_text_)', ''), '_', ' ')), ' '),
      lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') as theme
  from checked c, unnest(c.themes) as u(t))"""


def with_answers(body: str) -> str:
    return f"with {ANSWERS} {body}"
