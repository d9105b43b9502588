"""Ad-hoc survey uploads: structure detection and wide-to-long conversion."""

from __future__ import annotations

import os
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import cleaning
from ..operators.filters import is_long_text

QUESTION_WORDS = ("question", "response", "feedback", "comment")
SINGLE_WORDS = ("response", "comment", "feedback", "answer", "text")
RESPONDENT = "participant_id"
_CHUNK = 100_000


@dataclass(frozen=True)
class Structure:
    """Which columns of an upload hold answers."""

    headers: tuple[str, ...]
    is_multi_question: bool
    question_columns: tuple[str, ...]
    main_column: str


def detect_structure(headers: Sequence[str]) -> Structure:
    """Answer columns from header names; no data is read."""

    def named(words):
        return [h for h in headers if any(w in h.lower() for w in words)]

    multi = len(headers) > 2
    questions = named(QUESTION_WORDS) or [h for h in headers if h != RESPONDENT]
    main = questions[0] if questions else headers[0]
    if not multi:
        main = next(iter(named(SINGLE_WORDS)), main)
    return Structure(tuple(headers), multi, tuple(questions), main)


def tidy(upload: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Trimmed values, missing ones as ''."""
    return upload.select(
        *keep,
        *[
            F.coalesce(cleaning.strip(F.col(f"`{c}`")), F.lit("")).alias(c.strip())
            for c in upload.columns
            if c not in keep
        ],
    )


def keep_answered(upload: DataFrame, structure: Structure, minimum: int = 10) -> DataFrame:
    """Respondents with at least one answer longer than ``minimum`` characters."""
    cond: Column = F.lit(False)
    for c in structure.question_columns:
        cond = cond | is_long_text(F.col(f"`{c}`"), minimum)
    return upload.filter(cond)


def dense_index(rows: DataFrame, group: str, order: str) -> DataFrame:
    """Adds ``position``: 0-based rank by ``order`` within ``group``.

    ``order`` is a row number of the file. Rows are counted per chunk of
    consecutive numbers and ranked inside their chunk, so a survey of any
    size is spread over as many tasks as it has chunks.
    """
    chunk = F.floor(F.col(order) / _CHUNK).cast("bigint")
    rows = rows.withColumn("chunk", chunk)
    sizes = rows.groupBy(group, "chunk").agg(F.count(F.lit(1)).alias("n"))
    running = Window.partitionBy(group).orderBy("chunk")
    starts = sizes.select(group, "chunk", (F.sum("n").over(running) - F.col("n")).alias("start"))
    inside = F.row_number().over(Window.partitionBy(group, "chunk").orderBy(order)) - 1
    return (
        rows.withColumn("inside", inside)
        .join(starts, [group, "chunk"])
        .withColumn("position", F.col("start") + F.col("inside"))
        .drop("chunk", "inside", "start")
    )


def _metadata(columns: Sequence[str]) -> Column:
    if not columns:
        return F.create_map().cast("map<string,string>")
    pairs = [x for c in columns for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull() & (v != ""))


def to_long(
    upload: DataFrame,
    structure: Structure,
    *,
    survey: str = "survey_id",
    order: str = "file_order",
    minimum: int = 10,
) -> DataFrame:
    """One row per answer of the kept respondents.

    Adds question_text, question_order, row_number (position among kept
    respondents + 2) and the other non-empty columns as metadata.
    """
    carried = (survey, order)
    kept = dense_index(keep_answered(upload, structure, minimum), survey, order)
    number = (F.col("position") + 2).alias("row_number")
    columns = [c for c in structure.headers if c not in carried]
    if not structure.is_multi_question:
        main = structure.main_column
        return kept.select(
            survey,
            number,
            F.col(f"`{main}`").alias("response_text"),
            F.lit(main).alias("question_text"),
            F.lit(0).alias("question_order"),
            _metadata([c for c in columns if c != main]).alias("metadata"),
        )
    questions = structure.question_columns
    answers = F.array(
        *[
            F.struct(
                F.col(f"`{c}`").alias("response_text"),
                F.lit(c).alias("question_text"),
                F.lit(i).alias("question_order"),
            )
            for i, c in enumerate(questions)
        ]
    )
    given = F.filter(answers, lambda a: is_long_text(a["response_text"], minimum))
    meta = _metadata([c for c in columns if c not in questions])
    return kept.select(survey, number, meta.alias("metadata"), F.inline(given)).select(
        survey, "row_number", "response_text", "question_text", "question_order", "metadata"
    )


def header_record(
    spark: SparkSession,
    survey_id: str,
    filename: str,
    structure: Structure,
    total_responses: int,
    status: str = "processing",
) -> DataFrame:
    """Survey header row."""
    return spark.createDataFrame(
        [
            (
                survey_id,
                os.path.splitext(filename)[0],
                filename,
                total_responses,
                structure.main_column,
                list(structure.headers),
                list(structure.question_columns),
                structure.is_multi_question,
                status,
            )
        ],
        "id string, name string, original_filename string, total_responses bigint, "
        "response_column string, headers array<string>, question_columns array<string>, "
        "is_multi_question boolean, status string",
    ).withColumns(
        {"created_at": F.current_timestamp(), "updated_at": F.current_timestamp()}
    )


def read_upload(spark: SparkSession, path: str) -> tuple[DataFrame, Structure]:
    """Upload file with survey_id and file_order columns, and its structure."""
    from .ingest import number_rows, read_csv

    raw = number_rows(read_csv(spark, path, sep=","))
    headers = [c for c in raw.columns if c not in ("source_file", "scan_order", "row_number")]
    clean = tidy(raw, keep=("source_file", "scan_order", "row_number"))
    frame = (
        clean.withColumnRenamed("source_file", "survey_id")
        .withColumnRenamed("row_number", "file_order")
        .drop("scan_order")
    )
    return frame, detect_structure([h.strip() for h in headers])
