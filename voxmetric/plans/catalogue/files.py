"""Files, tables and streams: written from the tables, read back, compared."""

from pyspark.sql import functions as F

from ...operators import quality
from ...session import scratch
from ...sources import csv_blocks, ingest, skipping, snapshots, tables, upload
from ...streaming import jobs, maintained
from .. import bindings
from .base import add, with_commented, with_commented_enrichment, with_responses
from .ingest import _EXPORT, _FIELDS
from .quality import _UPSERTED, _versions

_TO_CSV = {
    "header": True, "quoteAll": True, "quote": '"', "escape": '"', "emptyValue": "",
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}


# Rows of a written file: a task writes one, and reads one where it cannot be split.
_ROWS = 1_000_000


def _files(t, least):
    """Number of files for a row per order; a million rows are some 120 MB of text."""
    return max(least, -(-bindings.table(t.spark, t.sf_dir, "orders").count() // _ROWS))


def _exports(t):
    """A folder with export files of both separators, several of each."""
    path = scratch(t.spark, "exports")
    for part, sep in enumerate((",", ";")):
        rows = t.export.filter(F.col("row_number") % 2 == part).repartition(_files(t, 3))
        rows.write.options(**_TO_CSV, sep=sep).mode("append").csv(path)
    return path


def _numbered(t):
    rows = ingest.normalize(ingest.read_csv(t.spark, _exports(t)))
    return ingest.valid_rows(rows).select(
        F.col("row_number").cast("bigint").alias("id"), "survey_name", "nps_score", "nps_explanation", "gender", "age_range",
        "creation_date", "title_text", "nps_category",
    )


add(
    "file_exports", "ING-1 ING-2 ING-5",
    _numbered,
    with_responses(f", {_EXPORT} select id, {_FIELDS} from normal where error is null"),
)
add(
    "file_row_numbers", "ING-1 ING-6",
    lambda t: ingest.number_rows(ingest.read_csv(t.spark, _exports(t)))
    .groupBy("source_file")
    .agg(F.min("row_number").alias("a"), F.max("row_number").alias("z"), F.countDistinct("row_number").alias("n"))
    .agg(
        F.sum("n").alias("rows"),
        F.count_if((F.col("a") != 1) | (F.col("z") != F.col("n"))).alias("files_with_gaps"),
    ),
    "select count(*) as rows, 0::bigint as files_with_gaps from orders",
)


def _blocks(t):
    """Rows by the reader in blocks; the export's own row number comes back as a column."""
    path = f"{scratch(t.spark, 'exports')}/t"
    t.export.withColumnRenamed("row_number", "id").repartition(_files(t, 2)).write.options(**_TO_CSV).csv(path)
    raw = csv_blocks.read_blocks(t.spark, path)
    ids = raw.select("source_file", "row_number", F.col("id").cast("bigint").alias("id"))
    rows = ingest.valid_rows(ingest.normalize(raw.drop("id")))
    return rows.join(ids, ["source_file", "row_number"]).select(
        "id", "survey_name", "nps_score", "nps_explanation", "gender", "age_range", "creation_date", "title_text", "nps_category",
    )


add(
    "file_blocks", "ING-1 ING-5",
    _blocks,
    with_responses(f", {_EXPORT} select id, {_FIELDS} from normal where error is null"),
)
add(
    "file_block_numbers", "ING-1 ING-6",
    lambda t: csv_blocks.read_blocks(t.spark, _exports(t))
    .groupBy("source_file")
    .agg(F.min("row_number").alias("a"), F.max("row_number").alias("z"), F.countDistinct("row_number").alias("n"))
    .agg(
        F.sum("n").alias("rows"),
        F.count_if((F.col("a") != 1) | (F.col("z") != F.col("n"))).alias("files_with_gaps"),
    ),
    "select count(*) as rows, 0::bigint as files_with_gaps from orders",
)


def _appended(t):
    path = f"{scratch(t.spark, 'responses')}/t"
    rows = t.responses.select("id", "survey_name", "nps_score", "creation_date")
    for part in (0, 1):
        tables.append_responses(rows.filter(F.col("id") % 2 == part), path)
    return t.spark.read.parquet(path)


add(
    "table_append", "ING-8",
    _appended,
    with_responses(
        """select id, survey_name, nps_score, creation_date,
        strftime(creation_date, '%Y-%m') as creation_month from responses"""
    ),
)


def _upserted(t):
    """Repeated keys go into a stored table; only their buckets are rewritten."""
    rows, incoming = _versions_in_two(t)
    path = f"{scratch(t.spark, 'keyed')}/t"
    tables.write_keyed(rows, path, "response_id", 8)
    tables.upsert_table(incoming, path, "response_id", 8, t.responses, newest=["version"])
    return t.spark.read.parquet(path).select("response_id", "row_id", "version")


def _versions_in_two(t):
    """A first state of a table, and rows that change it."""
    rows = quality.newest_per_key(_versions(t), "response_id", "created_at", "row_id").select(
        "response_id", "row_id", "version"
    )
    times = F.explode(F.array(*[F.lit(x) for x in (200, 300, 100)])).alias("plus")
    incoming = rows.filter((F.col("version") % 2) == 0).select("*", times)
    incoming = incoming.withColumn("version", F.col("version") + F.col("plus")).drop("plus")
    return rows.filter(F.col("version") < 30), incoming


def _snapshots(t):
    """The same by commits: rows go into deltas, which a read merges by key."""
    rows, incoming = _versions_in_two(t)
    table = snapshots.KeyedTable.create(rows, f"{scratch(t.spark, 'snapshots')}/t", "response_id", 8)
    for part in (0, 1):
        table.upsert(incoming.filter(F.col("row_id") % 2 == part), t.responses, newest=["version"])
    return table


add("table_upsert", "DQ-11 DQ-12", _upserted, _UPSERTED)
add("table_snapshot", "DQ-11 DQ-12 ING-8", lambda t: _snapshots(t).read(), _UPSERTED)


def _compacted(t):
    table = _snapshots(t)
    table.compact()
    table.vacuum()
    return table.read()


add("table_snapshot_compacted", "DQ-11 DQ-12 ING-8", _compacted, _UPSERTED)


def _indexed(t):
    """Commented responses with their themes, in a table with side tables."""
    rows = t.referenced.join(t.enrichment.withColumnRenamed("response_id", "id").select("id", "themes"), "id", "left")
    rows = t.with_comments(rows).select("id", "nps_score", "nps_explanation", "created_at", "themes")
    table = skipping.IndexedTable(
        t.spark, f"{scratch(t.spark, 'indexed')}/t", themes="themes", text="nps_explanation", stamp="created_at"
    )
    table.append(rows)
    return table


add(
    "filter_has_theme_indexed", "FLT-7 THM-11",
    lambda t: _indexed(t).has_theme("overige").select("id", F.size("themes").alias("n_themes")),
    with_commented_enrichment(
        """select c.id, cast(len(e.themes) as int) as n_themes from commented c join enrichment e on e.response_id = c.id
        where list_contains(e.themes, 'overige')"""
    ),
)
add(
    "theme_counts_indexed", "FLT-7 THM-20",
    lambda t: _indexed(t).theme_counts(),
    with_commented_enrichment(
        """select theme, count(distinct id) as n from (select c.id, unnest(e.themes) as theme
        from commented c join enrichment e on e.response_id = c.id) group by theme"""
    ),
)
add(
    "filter_text_search_indexed", "FLT-6",
    lambda t: _indexed(t).search("BEZORGING").select("id", "nps_score"),
    with_commented("select id, nps_score from commented where nps_explanation ilike '%bezorging%'"),
)
add(
    "response_page_deep", "SRT-3",
    lambda t: _indexed(t).page(1000, 40).select("id", F.unix_seconds("created_at").alias("seconds"), "nps_score"),
    with_commented(
        """select id, cast(epoch(created_at) as bigint) as seconds, nps_score from commented
        order by created_at desc nulls last, id limit 40 offset 1000"""
    ),
)


def _upload(t):
    """Wide upload files: one respondent a row, as many questions as turns."""
    path = f"{scratch(t.spark, 'upload')}/answers"
    wide = bindings.spread(bindings.wide_upload(t.spark, t.sf_dir), "file_order")
    wide.drop("survey_id", "file_order").write.options(**_TO_CSV).csv(path)
    return upload.read_upload(t.spark, path)


def _uploaded(t):
    frame, structure = _upload(t)
    long = upload.to_long(frame, structure)
    return long.groupBy("question_text", "question_order").agg(
        F.count(F.lit(1)).alias("answers"), F.sum(F.length("response_text")).alias("chars")
    )


add(
    "file_upload", "ING-11 ING-12 ING-14",
    _uploaded,
    """with turns as (select conv_id, turn, case when conv_id % 7 = 3 then 'kort'
        else regexp_replace(text, '^\\s+|\\s+$', '', 'g') end as txt from conversations)
      select 'question_' || (turn + 1) || '_feedback' as question_text, cast(turn as int) as question_order,
        count(*) as answers, cast(sum(length(txt)) as bigint) as chars
      from turns where length(txt) > 10 group by all""",
)


def _header(t):
    """The header record of the upload, appended to a table and read back."""
    frame, structure = _upload(t)
    people = upload.to_long(frame, structure).select("survey_id", "row_number").distinct().count()
    path = f"{scratch(t.spark, 'headers')}/t"
    tables.append(upload.header_record(t.spark, "u1", "answers.csv", structure, people), path)
    return t.spark.read.parquet(path).select(
        "id", "name", "original_filename", "total_responses", "is_multi_question", "status",
        F.array_join("headers", ",").alias("headers"), F.array_join("question_columns", ",").alias("question_columns"),
    )


add(
    "upload_header", "ING-16 ING-12 ING-13",
    _header,
    """with questions as (select string_agg('question_' || (turn + 1) || '_feedback', ',' order by turn) as names
        from (select unnest(generate_series(0, max(turn))) as turn from conversations)),
      people as (select count(distinct conv_id) as n from conversations
        where conv_id % 7 <> 3 and length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) > 10)
      select 'u1' as id, 'answers' as name, 'answers.csv' as original_filename, n as total_responses,
        true as is_multi_question, 'processing' as status,
        'participant_id,' || names || ',segment,size' as headers, names as question_columns
      from questions, people""",
)


def _streamed(t):
    """Dropped files as a stream, file by file, to a table and its rejects."""
    root, source = scratch(t.spark, "stream"), scratch(t.spark, "drop")
    rows = t.export
    upper = rows.toDF(*[c.strip().upper() for c in rows.columns])
    known = [f.name for f in jobs.EXPORT_SCHEMA.fields]
    text = [F.col(c) if c in upper.columns else F.lit("").alias(c) for c in known]
    upper.withColumn("SUBSCRIPTION_KEY", F.col("ROW_NUMBER").cast("string")).select(
        *[F.col("SUBSCRIPTION_KEY") if c == "SUBSCRIPTION_KEY" else x for c, x in zip(known, text)]
    ).repartition(_files(t, 4)).write.options(**_TO_CSV).mode("append").csv(source)
    stream = jobs.export_stream(t.spark, source)
    query = jobs.ingest_stream(stream, f"{root}/out", f"{root}/bad", f"{root}/checkpoint")
    query.awaitTermination()
    return root


add(
    "stream_ingest", "STR-1",
    lambda t: t.spark.read.parquet(f"{_streamed(t)}/out").select(
        "survey_name", "nps_score", "nps_explanation", "gender", "age_range", "creation_date",
        "title_text", "nps_category",
    ),
    with_responses(f", {_EXPORT} select {_FIELDS} from normal where error is null"),
)
add(
    "stream_rejects", "STR-1 ING-6",
    lambda t: t.spark.read.parquet(f"{_streamed(t)}/bad").groupBy("error").agg(F.count(F.lit(1)).alias("rows")),
    with_responses(f", {_EXPORT} select error, count(*) as rows from normal where error is not null group by error"),
)


def _daily(t):
    """A stream of responses to finished days."""
    root, source = scratch(t.spark, "daily"), scratch(t.spark, "responses")
    rows = t.responses.select("survey_name", "nps_score", "created_at")
    rows.repartition(_files(t, 4)).write.mode("append").parquet(source)
    stream = t.spark.readStream.schema(rows.schema).parquet(source)
    trend = jobs.daily_trend_stream(stream, stamp="created_at", lateness="2 days")
    jobs.write_daily_trend(trend, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{root}/out").select(
        "survey_name", "day", "daily_responses", "daily_promoters", "daily_passives", "daily_detractors"
    )


add(
    "stream_daily_trend", "STR-2",
    _daily,
    with_responses(
        """, days as (select survey_name, cast(created_at as date) as day, count(*) as daily_responses,
          count(*) filter (where nps_score >= 9) as daily_promoters,
          count(*) filter (where nps_score between 7 and 8) as daily_passives,
          count(*) filter (where nps_score <= 6) as daily_detractors from responses group by all)
        select * from days where day + interval 1 day
          <= (select max(created_at) from responses) - interval 2 days"""
    ),
)


def _corrected(t):
    """Responses, then corrected scores and deletions, as a stream of changes."""
    root, source = scratch(t.spark, "corrected"), scratch(t.spark, "changes")
    kept = ["id", "version", "deleted", "survey_name", "created_at", "nps_score"]
    rows = t.responses.select(
        "id", F.lit(1).cast("bigint").alias("version"), F.lit(False).alias("deleted"), "survey_name", "created_at", "nps_score"
    )
    later = rows.filter(F.col("id") % 3 == 0).withColumns(
        {"version": F.lit(2).cast("bigint"), "deleted": F.col("id") % 9 == 0, "nps_score": (F.col("nps_score") + 4) % 11}
    )
    for part in (rows, later):
        part.select(kept).write.mode("append").parquet(source)
    stream = t.spark.readStream.schema(maintained.CHANGE).option("maxFilesPerTrigger", 4).parquet(source)
    maintained.maintain(stream, f"{root}/t", f"{root}/checkpoint", 8).awaitTermination()
    return maintained.MaintainedTrend(t.spark, f"{root}/t").trend()


add(
    "stream_corrected_trend", "AGG-8 STR-2",
    lambda t: _corrected(t).drop("daily_nps_score", "daily_avg_score"),
    with_responses(
        """, last as (select survey_name, cast(created_at as date) as day,
            case when id % 3 = 0 then (nps_score + 4) % 11 else nps_score end as nps_score from responses where id % 9 <> 0)
        select survey_name, day, count(*) as daily_responses,
          count(*) filter (where nps_score >= 9) as daily_promoters,
          count(*) filter (where nps_score between 7 and 8) as daily_passives,
          count(*) filter (where nps_score <= 6) as daily_detractors from last group by all"""
    ),
)
