"""Key words, keyword themes, model output and vector similarity."""

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ...operators import enrichment, similarity, text, themes, vector_cells, vector_index
from ...session import scratch, staging_root
from ...sources import reference_data as ref
from .. import bindings
from .base import (
    add, ratio, values, with_answers, with_commented,
    with_commented_enrichment, with_commented_mentions, with_enrichment, words,
)

DUTCH = words(ref.DUTCH_STOP_WORDS)


def _words_sql(source, k):
    return f"""select word, count(*) as count from (
        select unnest(regexp_split_to_array(regexp_replace(lower(nps_explanation),
          '[.,!?;:()\\[\\]]', ' ', 'g'), '\\s+')) as word from {source})
      where length(word) > 3 and word not in ({DUTCH}) and not regexp_matches(word, '^[0-9]+$')
      group by word order by 2 desc, 1 limit {k}"""


add(
    "key_words", "TXT-1",
    lambda t: text.key_words(t.commented),
    with_commented(_words_sql("commented", 10)),
)
add(
    "key_words_theme", "TXT-1",
    lambda t: text.key_words(
        t.with_comments(themes.assignments(t.referenced, t.enrichment, theme="stability")), k=20
    ),
    with_commented_mentions(
        ", picked as (select distinct response_id, nps_explanation from mentions where theme = 'stability') "
        + _words_sql("picked", 20)
    ),
)
add(
    "keyword_hints", "TXT-2",
    lambda t: text.keyword_hints(t.referenced_assignments, comments=t.with_comments).select(
        "theme", bindings.joined("keywords", ",").alias("keywords")
    ),
    with_commented_mentions(
        f""", picked as (select * from (select *, row_number() over (partition by theme
            order by creation_date desc, response_id) as rn
          from (select distinct theme, creation_date, response_id, nps_explanation
            from mentions where nps_explanation <> '')) where rn <= 5),
        found as (select theme, rn, u.w as word, u.ord as pos from (select theme, rn,
            regexp_extract_all(lower(nps_explanation), '[a-z0-9_]{{3,}}') as ws from picked) p,
          unnest(p.ws) with ordinality as u(w, ord)),
        firsts as (select theme, word, min(rn * 1000000 + pos) as first_at from found
          where word not in ({words(ref.HINT_STOP_WORDS)}) group by all)
        select t.theme, coalesce(string_agg(word, ',' order by first_at), '') as keywords
        from (select distinct theme from picked) t left join
          (select *, row_number() over (partition by theme order by first_at) as n from firsts) w
            on w.theme = t.theme and n <= 5 group by t.theme"""
    ),
)
add(
    "top_words_per_question", "TXT-3",
    lambda t: text.top_words_per_question(t.answers),
    with_answers(
        f"""select * from (select *,
          cast(row_number() over (partition by question_text order by count desc, word) as int) as rank
        from (select question_text, word, count(*) as count
          from (select question_text, unnest(regexp_split_to_array(lower(response_text), '\\s+')) as word
            from answers)
          where length(word) >= 3 and word not in ({words(ref.ENGLISH_STOP_WORDS)})
          group by all)) where rank <= 5"""
    ),
)

FREQUENT = [*ref.FREQUENCY_KEYWORDS, "delivery", "storing"]
_KEYWORDS = values(
    "theme_words", "theme, keyword",
    [(t, k) for t in FREQUENT for k in ref.FREQUENCY_KEYWORDS.get(t, (t,))],
)
add(
    "theme_frequency", "TXT-4",
    lambda t: text.theme_frequency(t.commented, FREQUENT),
    with_commented(
        f""", {_KEYWORDS},
        hits as (select w.theme, count(distinct c.id) as matches from commented c
          join theme_words w on contains(lower(c.nps_explanation), w.keyword) group by 1),
        n as (select count(*) as responses from commented)
        select w.theme, coalesce(h.matches, 0) as matches, n.responses,
          {ratio('coalesce(h.matches, 0)', 'n.responses', 6)} as frequency
        from (select distinct theme from theme_words) w cross join n
          left join hits h on h.theme = w.theme"""
    ),
)
DISCOVERED = (
    ("abonnement_beheer", 0.9, "Subscription"),
    ("mobiele_app", 0.8, "App"),
    ("delivery", 0.7, "Delivery"),
    ("storing", 0.6, "Outages"),
    ("nieuws_actualiteit", 0.5, "News"),
    ("onbekend_woord", 0.5, "Nothing"),
)
_CANDIDATES = values(
    "candidates", "position, name, source, confidence, explanation",
    [
        *((i, n, "base", 1.0, "Predefined business category") for i, n in enumerate(ref.BASE_THEMES)),
        *((i + len(ref.BASE_THEMES), n, "ai_discovered", c, e) for i, (n, c, e) in enumerate(DISCOVERED)),
    ],
)
_NAMES = list(dict.fromkeys([*ref.BASE_THEMES, *(d[0] for d in DISCOVERED)]))
_ALL_WORDS = values(
    "theme_words", "theme, keyword",
    [(t, k) for t in _NAMES for k in ref.FREQUENCY_KEYWORDS.get(t, (t,))],
)
add(
    "generate_themes", "TXT-5 TXT-6 TXT-7",
    lambda t: text.generate_themes(t.commented, DISCOVERED),
    with_commented(
        f""", {_CANDIDATES}, {_ALL_WORDS},
        hits as (select w.theme, count(distinct c.id) as m from commented c
          join theme_words w on contains(lower(c.nps_explanation), w.keyword) group by 1),
        rated as (select c.*, {ratio('coalesce(h.m, 0)', '(select count(*) from commented)', 6)} as frequency,
            case when source = 'base' or name in ({words(ref.HIGH_RELEVANCE_THEMES)}) then 'high'
              when name in ({words(ref.MEDIUM_RELEVANCE_THEMES)}) then 'medium' else 'low' end as business_relevance
          from candidates c left join hits h on h.theme = c.name)
        select name, source, frequency, cast(confidence as double) as confidence, explanation, business_relevance
        from rated where frequency >= 0.05
        order by case business_relevance when 'high' then 3 when 'medium' then 2 else 1 end + frequency desc,
          position limit 8"""
    ),
)

# ----------------------------------------------------------------- enrichment

_TAXONOMY = values(
    "taxonomy", "position, label, keyword",
    [(i, label, k) for i, (label, ks) in enumerate(ref.COMMENT_TAXONOMY) for k in ks],
)
_LABELLED = f"""{_TAXONOMY},
  cleaned as (select id, nps_score, case when lower(trim(nps_explanation)) in ('', 'n.v.t.', 'nvt')
    then null else nps_explanation end as txt from commented),
  labels_found as (select id, array_to_string(list(label order by position), '|') as themes from
    (select distinct c.id, t.position, t.label from cleaned c join taxonomy t
      on contains(lower(c.txt), t.keyword)) group by id)"""
add(
    "comment_taxonomy", "TXT-8 CLN-7",
    lambda t: t.commented.select(
        "id", bindings.tidy_comment("nps_explanation").alias("c")
    ).filter(F.col("c").isNotNull()).select(
        "id", bindings.joined(text.classify_comment(F.col("c"))).alias("themes")
    ),
    with_commented(
        f""", {_LABELLED} select c.id, coalesce(l.themes, 'overige') as themes
        from cleaned c left join labels_found l on l.id = c.id where c.txt is not null"""
    ),
)


def _records(t):
    return enrichment.enrich(t.with_comments(enrichment.pending(t.referenced, t.enrichment)))


_RECORDS = f"""{_LABELLED},
  open_rows as (select c.*, l.themes as found from cleaned c left join labels_found l on l.id = c.id
    where not exists (select 1 from enrichment e where e.response_id = c.id))"""
add(
    "enrich_pending", "TXT-13 TXT-14 JN-10 CLN-18",
    lambda t: _records(t).select(
        "response_id", bindings.joined("themes").alias("themes"), "primary_theme",
        "sentiment_label", "promoter_flag", "passive_flag", "detractor_flag", "summary",
        "processing_status", "language",
    ),
    with_commented_enrichment(
        f""", {_RECORDS} select id as response_id,
          case when txt is not null then coalesce(found, 'overige') end as themes,
          case when txt is not null then string_split(coalesce(found, 'overige'), '|')[1] end as primary_theme,
          'neutral' as sentiment_label, nps_score >= 9 as promoter_flag,
          nps_score between 7 and 8 as passive_flag, nps_score <= 6 as detractor_flag,
          'Analyse van ' || case when txt is null then 0
            else len(string_split(coalesce(found, 'overige'), '|')) end || ' thema''s' as summary,
          case when txt is null then 'skipped' else 'completed' end as processing_status,
          'nl' as language from open_rows"""
    ),
)
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _length_scorer(comments):
    """Scores a comment by its length and refuses some lengths."""
    size = comments.str.len()
    if (size % 7 == 3).any():
        raise ValueError("refused")
    return pd.DataFrame(
        {
            "themes": [["lang"] if n % 2 == 0 else ["kort", "anders"] for n in size],
            "sentiment_score": [(n % 21 - 10) / 10 for n in size],
            "keywords": [[] for _ in size],
        }
    )


def _scored(t):
    rows = t.with_comments(enrichment.pending(t.referenced, t.enrichment))
    return enrichment.enrich_with(rows, _length_scorer, "length")


_SCORED = f"""{_RECORDS}, sized as (select id, txt, case when txt is null then 'skipped'
    when length(trim(txt, {_BLANKS})) % 7 = 3 then 'failed' else 'completed' end as processing_status,
    length(trim(txt, {_BLANKS})) as n from open_rows)"""
add(
    "enrich_with_scorer", "TXT-14 TXT-13",
    lambda t: _scored(t).select(
        "response_id", bindings.joined("themes").alias("themes"), "sentiment_label", "processing_status"
    ),
    with_commented_enrichment(
        f""", {_SCORED} select id as response_id,
          case when processing_status = 'completed' then case when n % 2 = 0 then 'lang' else 'kort|anders' end end as themes,
          case when processing_status <> 'completed' then 'neutral' when n % 21 - 10 > 1 then 'positive'
            when n % 21 - 10 < -1 then 'negative' else 'neutral' end as sentiment_label,
          processing_status from sized"""
    ),
)
add(
    "enrich_scorer_counters", "TXT-14",
    lambda t: enrichment.batch_counters(_scored(t)),
    with_commented_enrichment(
        f""", {_SCORED} select count(*) filter (where processing_status = 'completed') as processed,
          count(*) filter (where processing_status = 'skipped') as skipped,
          count(*) filter (where processing_status = 'failed') as failed from sized"""
    ),
)
add(
    "enrich_counters", "TXT-14",
    lambda t: enrichment.batch_counters(_records(t)),
    with_commented_enrichment(
        f""", {_RECORDS} select count(txt) as processed,
        count(*) filter (where txt is null) as skipped, 0::bigint as failed from open_rows"""
    ),
)
add(
    "sentiment_labels", "CLN-18",
    lambda t: t.enrichment.groupBy("sentiment_label").agg(F.count(F.lit(1)).alias("n")),
    with_enrichment("select sentiment_label, count(*) as n from enrichment group by 1"),
)

# --------------------------------------------------------------- model output

_ANSWER_FIELDS = """fields as (select response_id as id, response_id,
  coalesce(primary_theme, '') as primary_theme, coalesce(themes, []) as themes,
  sentiment_label as sentiment, cast(response_id % 100 as double) / 100.0 as confidence,
  case when response_id % 10 = 0 then 'Nieuw  Thema ' || (response_id % 20) end as new_theme
  from enrichment),
parsed as (select response_id,
  case when id % 7 = 0 then '' else primary_theme end as primary_theme,
  case when id % 7 = 0 then [] else themes end as themes,
  case when id % 7 = 0 then 'neutral' else sentiment end as sentiment,
  case when id % 7 in (0, 2) then 0.6::double else confidence end as confidence,
  case when id % 7 = 0 then null else new_theme end as new_theme from fields)"""


def _parsed(t):
    return bindings.model_answers(t.spark, t.sf_dir).select(
        "response_id", text.parse_answer(F.col("answer")).alias("a")
    ).select("response_id", "a.*")


add(
    "parse_model_answers", "TXT-9",
    lambda t: _parsed(t).withColumn("themes", bindings.joined("themes")),
    with_enrichment(
        f", {_ANSWER_FIELDS} select * replace (array_to_string(themes, '|') as themes) from parsed"
    ),
)
_KNOWN = values("known", "name", [(n,) for n in bindings.KNOWN_THEMES])


def _slug(col):
    return f"trim(regexp_replace(lower({col}), '[^a-z0-9]+', '-', 'g'), '-')"


# Every step is materialised and unnested by itself: no correlated or repeated part.
_RECONCILED = f"""{_ANSWER_FIELDS}, {_KNOWN},
  dim as materialized (select {_slug('name')} as slug, min(name) as known from known group by 1),
  tidy as materialized (select response_id, sentiment, confidence, trim(primary_theme) as prim,
      trim(coalesce(new_theme, '')) as proposed,
      list_filter(list_transform(themes, lambda x: trim(x)), lambda x: x <> '') as themes from parsed),
  decided as materialized (select *, proposed <> '' and (lower(prim) = lower(proposed)
      or prim not in ({words(bindings.KNOWN_THEMES)})) as adopted from tidy),
  packed as materialized (select response_id, case when adopted then list_prepend(proposed, themes)
      when len(themes) = 0 then ['overige'] else themes end as names, case when adopted then 2 else 1 end as skip from decided),
  entries as materialized (select response_id, generate_subscripts(names, 1) - skip as pos, unnest(names) as name from packed),
  slugs as materialized (select name, {_slug('name')} as slug, min(response_id * 1000 + pos) as first_at from entries group by name),
  uses as materialized (select slug, arg_min(name, first_at) as used from slugs group by slug),
  canon as materialized (select s.name, s.slug, coalesce(d.known, u.used) as canonical, d.known is null as new
    from slugs s join uses u on u.slug = s.slug left join dim d on d.slug = s.slug),
  fresh as (select distinct canonical as name, slug from canon where new),
  named as materialized (select e.*, c.canonical from entries e join canon c on c.name = e.name),
  grouped as materialized (select response_id, max(canonical) filter (where pos = -1) as proposal,
      coalesce(list(name) filter (where pos >= 0), []) as names,
      coalesce(list(canonical order by pos) filter (where pos >= 0), []) as listed from named group by response_id),
  merged as materialized (select response_id, proposal, case when proposal is not null
      and not list_contains(names, proposal) then list_prepend(proposal, listed) else listed end as every from grouped),
  listed as materialized (select response_id, proposal, list_filter(every, lambda x, i: list_position(every, x) = i) as themes
    from merged)"""
add(
    "reconcile_themes", "TXT-12 CLN-13",
    lambda t: enrichment.reconcile(_parsed(t), bindings.theme_dimension(t.spark)).withColumn(
        "themes", bindings.joined("themes")
    ),
    with_enrichment(
        f""", {_RECONCILED}
        select d.response_id, coalesce(l.proposal, nullif(d.prim, ''), l.themes[1]) as primary_theme,
          array_to_string(l.themes, '|') as themes, d.sentiment, d.confidence
        from decided d join listed l on l.response_id = d.response_id"""
    ),
)
add(
    "reconcile_new_themes", "TXT-12 CLN-13",
    lambda t: enrichment.new_themes(_parsed(t), bindings.theme_dimension(t.spark)),
    with_enrichment(f", {_RECONCILED} select name, slug from fresh"),
)


def _lists(t):
    texts = bindings.theme_list_texts(t.spark, t.sf_dir)
    parsed = text.parse_theme_list(text.strip_code_fence(F.col("answer")))
    return texts.select(
        "response_id",
        F.array_join(
            F.transform(parsed, lambda x: F.concat_ws(":", x["name"], x["confidence"], x["business_relevance"])),
            "|",
        ).alias("themes"),
    )


add(
    "parse_theme_lists", "TXT-10 TXT-11 CLN-16",
    _lists,
    with_enrichment(
        """, forms as (select response_id, response_id % 4 as form, coalesce(themes, []) as names,
            cast(response_id % 30 as double) / 10.0 as c from enrichment),
        items as (select f.response_id, f.form, u.ord, case when f.form = 2
              then case when regexp_matches(u.n, '[0-9]') then 'x'
                else regexp_replace(lower(trim(u.n)), ' ', '_', 'g') end
              else regexp_replace(lower(u.n), '\\s+', '_', 'g') end as name,
            case when f.form = 2 then 0.7::double when f.form = 1 and c = 0 then 0.7::double else c end as c
          from forms f, unnest(f.names) with ordinality as u(n, ord)),
        kept as (select response_id, name, c, min(ord) as ord from items
          where c <> 0 group by response_id, name, c)
        select f.response_id, coalesce(string_agg(k.name || ':' || least(1.0::double, k.c) || ':medium', '|'
          order by k.ord), '') as themes
        from forms f left join kept k on k.response_id = f.response_id group by f.response_id"""
    ),
)

# ----------------------------------------------------------------- similarity

_SIM = "round(list_cosine_similarity(cast(e.embedding as double[]), cast(q.embedding as double[])), 6)"


def _rounded(hits):
    return hits.withColumn("similarity", F.round("similarity", 6))


add(
    "similar_to_vector", "VEC-1",
    lambda t: _rounded(
        similarity.nearest_to_vector(t.embeddings, similarity.vector_of(t.embeddings, 7), 15)
    ),
    f"""select e.vec_id as response_id, {_SIM} as similarity from embeddings e, embeddings q
      where q.vec_id = 7 order by 2 desc, 1 limit 15""",
)
add(
    "similar_to_response", "VEC-2",
    lambda t: similarity.with_responses(
        _rounded(similarity.nearest_to_response(t.embeddings, 42, 10)),
        t.responses, "nps_score", "title_text",
    ),
    f"""with n as (select e.vec_id as response_id, {_SIM} as similarity from embeddings e, embeddings q
      where q.vec_id = 42 and e.vec_id <> 42 order by 2 desc, 1 limit 10)
      select n.*, cast((o_orderkey * 7 + o_custkey * 3) % 11 as int) as nps_score,
        case when o_orderkey % 37 <> 0 then n_name end as title_text
      from n join orders on o_orderkey = n.response_id join customer on c_custkey = o_custkey
        join nation on n_nationkey = c_nationkey""",
)
WIDTH = 64
add(
    "similar_to_many", "VEC-2",
    lambda t: _rounded(
        similarity.nearest_to_many(t.embeddings, t.embeddings.filter(F.col("label") == 3), WIDTH, 5)
    ),
    f"""select query_id, response_id, similarity, cast(rank as int) as rank from (
      select q.vec_id as query_id, e.vec_id as response_id, {_SIM} as similarity,
        row_number() over (partition by q.vec_id order by {_SIM} desc, e.vec_id) as rank
      from embeddings e, embeddings q where q.label = 3 and e.vec_id <> q.vec_id) where rank <= 5""",
)

# An index whose centroids are the first embeddings, so that SQL can assign too.
_LISTS, _PROBES = 20, 5
_INDEX = f"""c as (select vec_id as list_id, embedding from embeddings where vec_id < {_LISTS}),
  listed as (select e.vec_id, arg_min(c.list_id, (-{_SIM.replace('q.', 'c.').replace(', 6)', ', 12)')}, c.list_id)) as list_id
    from embeddings e, c group by e.vec_id),
  probed as (select c.list_id from c, embeddings q where q.vec_id = 7
    order by {_SIM.replace('e.', 'c.').replace(', 6)', ', 12)')} desc, c.list_id limit {_PROBES})"""


def _centroids(t):
    rows = t.embeddings.filter(F.col("response_id") < _LISTS).orderBy("response_id").collect()
    return np.asarray([r.embedding for r in rows], dtype="float64")


def _index(t):
    """The index written to the shared folder and read back."""
    path = f"{staging_root(t.spark)}/lists-{uuid.uuid4().hex}"
    similarity.write_lists(similarity.assign_lists(t.embeddings, _centroids(t)), path)
    return t.spark.read.parquet(path)


add(
    "similar_lists", "VEC-3",
    lambda t: similarity.assign_lists(t.embeddings, _centroids(t)).select("response_id", "list_id"),
    f"with {_INDEX} select vec_id as response_id, cast(list_id as int) as list_id from listed",
)
add(
    "similar_all_lists", "VEC-3",
    lambda t: _rounded(
        similarity.nearest_in_lists(
            _index(t), _centroids(t), similarity.vector_of(t.embeddings, 7), k=15, probes=_LISTS
        )
    ),
    f"""select e.vec_id as response_id, {_SIM} as similarity from embeddings e, embeddings q
      where q.vec_id = 7 order by 2 desc, 1 limit 15""",
)
add(
    "similar_probed_lists", "VEC-3",
    lambda t: _rounded(
        similarity.nearest_in_lists(
            _index(t), _centroids(t), similarity.vector_of(t.embeddings, 7), k=15, probes=_PROBES
        )
    ),
    f"""with {_INDEX} select e.vec_id as response_id, {_SIM} as similarity
      from embeddings e join listed l on l.vec_id = e.vec_id join probed p on p.list_id = l.list_id, embeddings q
      where q.vec_id = 7 order by 2 desc, 1 limit 15""",
)


def _found(exact, near):
    """Counts of the exact neighbours, and of those that a search found."""
    hits = exact.join(near.withColumn("hit", F.lit(1)), exact.columns, "left")
    return hits.agg(F.count("hit").alias("found"), F.count(F.lit(1)).alias("wanted"))


def _recall(t):
    """Share of the exact nearest responses that the probed lists hold."""
    vector = similarity.vector_of(t.embeddings, 7)
    exact = similarity.nearest_to_vector(t.embeddings, vector, 15).select("response_id")
    near = similarity.nearest_in_lists(_index(t), _centroids(t), vector, k=15, probes=_PROBES)
    return _found(exact, near.select("response_id"))


add(
    "similar_recall", "VEC-3",
    _recall,
    f"""with {_INDEX}, exact as (select e.vec_id, l.list_id from embeddings e
        join listed l on l.vec_id = e.vec_id, embeddings q where q.vec_id = 7 order by {_SIM} desc, 1 limit 15)
      select count(p.list_id) as found, count(*) as wanted from exact left join probed p on p.list_id = exact.list_id""",
)


# An index with fitted centroids and codes, asked for every 50th response.
_K, _FOLDED = 15, "response_id % 50 = 0"


def _fitted(t):
    """(index, its queries, fitted probes): fitted, written and loaded again."""
    path = scratch(t.spark, "index")
    vector_index.Index.create(t.embeddings, path, vector_index.fit(t.embeddings, WIDTH))
    index = vector_index.Index.load(t.spark, path)
    return index, t.embeddings.filter(_FOLDED), index.fit_probes(t.embeddings, k=_K)


def _index_search(t):
    index, queries, probes = _fitted(t)
    return _rounded(index.search(queries, k=_K, probes=probes))


def _index_recall(t):
    """Whether nine tenths of the exact neighbours of all queries are found."""
    index, queries, probes = _fitted(t)
    exact = similarity.nearest_to_many(t.embeddings, queries, WIDTH, _K).select("query_id", "response_id")
    near = index.search(queries, k=_K, probes=probes).select("query_id", "response_id")
    return _found(exact, near).select("wanted", (F.col("found") >= 0.9 * F.col("wanted")).alias("reached"))


def _index_exact(t):
    """All lists probed and all rows compared: the exact neighbours."""
    index, queries, _ = _fitted(t)
    lists = len(index.model.centroids)
    return _rounded(index.search(queries, k=_K, probes=lists, depth=1 << 30))


_EVERY_50TH = f"""select query_id, response_id, similarity, cast(rank as int) as rank from (
      select q.vec_id as query_id, e.vec_id as response_id, {_SIM} as similarity,
        row_number() over (partition by q.vec_id order by {_SIM} desc, e.vec_id) as rank
      from embeddings e, embeddings q where q.vec_id % 50 = 0 and e.vec_id <> q.vec_id) where rank <= {_K}"""

add(
    "similar_to_many_bounded", "VEC-2",
    lambda t: _rounded(vector_cells.Cells(t.embeddings, WIDTH).search(t.embeddings.filter(_FOLDED), _K)),
    _EVERY_50TH,
)
add("similar_index", "VEC-3", _index_search)
add("similar_index_all", "VEC-3", _index_exact, _EVERY_50TH)
add("similar_index_recall", "VEC-3", _index_recall, f"select count(*) as wanted, true as reached from ({_EVERY_50TH})")
